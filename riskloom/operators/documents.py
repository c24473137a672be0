"""Document chunks, deduplication, incremental stores, embeddings and table documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.text import content_hash, split_characters, split_sentences
from riskloom.operators.similarity import SharedHits, cosine_top_k
from riskloom.plans.frames import written
from riskloom.sources.tables import upsert
from riskloom.sources.versions import Side, VersionedTable

HASH = "content_hash"


def explode_chunks(df: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, text), one row per chunk."""
    return df.select(key, F.posexplode(chunks).alias("chunk_no", "text"))


def character_chunks(
    df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 1000, overlap: int = 10, separator: str = "\n\n"
) -> DataFrame:
    return explode_chunks(df, split_characters(text, size, overlap, separator), key)


def sentence_chunks(df: DataFrame, size: int, text: str = "text", key: str = "doc_id", compat: bool = False) -> DataFrame:
    return explode_chunks(df, split_sentences(text, size, compat), key)


def with_hash(df: DataFrame, text: str = "text") -> DataFrame:
    return df if HASH in df.columns else df.withColumn(HASH, content_hash(text))


def new_documents(
    batch: DataFrame, store: DataFrame | None, order: Sequence[str] = ("doc_id", "chunk_no"), text: str = "text"
) -> DataFrame:
    """Rows of the batch whose content is neither in the store nor earlier in the batch.

    Only hashes and order keys are grouped, with partial aggregation before the shuffle, so a text
    copied into a third of all rows is one group of small partial results. The texts themselves are
    read once more and kept by a join on the unique order key, which also brings the hash back.
    """
    return _kept(batch, _first_keys(batch, order, text), store, order, text)


def _order_key(order: Sequence[str]) -> Column:
    return F.struct(*order) if len(order) > 1 else F.col(order[0])


def _first_keys(batch: DataFrame, order: Sequence[str], text: str) -> DataFrame:
    """(content_hash, __first): the least order key of every content."""
    return with_hash(batch, text).groupBy(HASH).agg(F.min(_order_key(order)).alias("__first"))


def _kept(batch: DataFrame, first: DataFrame, store: DataFrame | None, order: Sequence[str], text: str) -> DataFrame:
    """Rows of the batch with a first key whose content is not in the store."""
    if store is not None:
        known = with_hash(store, text).select(HASH).distinct()
        first = first.join(known, first[HASH].eqNullSafe(known[HASH]), "left_anti")
    rows = batch.drop(HASH).withColumn("__key", _order_key(order))
    return rows.join(first, F.col("__key") == F.col("__first")).drop("__key", "__first").select(*batch.drop(HASH).columns, HASH)


#: Content hashes of one folder of the index, and the most hex digits that name a folder.
FOLDER_HASHES, MOST_DIGITS = 100_000, 4


def hash_prefix(digits: int) -> Column:
    """The folder of a content hash: its first hex digits behind a letter, so that no reader takes them for a number."""
    return F.coalesce(F.concat(F.lit("h"), F.substring(HASH, 1, digits)), F.lit("none"))


def folder_digits(n: int) -> int:
    """Digits that name the hash folders of a segment of n rows: a folder holds about as many hashes at any size."""
    return min(MOST_DIGITS, math.ceil(math.log(max(1.0, n / FOLDER_HASHES), 16)))


def hash_index(rows: DataFrame, n: int) -> DataFrame:
    """(content_hash, prefix) of a segment."""
    return rows.select(HASH, hash_prefix(folder_digits(n)).alias("prefix"))


#: Most rows that every executor gets whole.
BROADCAST_ROWS = 1_000_000


class DocumentStore:
    """A versioned set of documents with incremental, deduplicated updates.

    Beside the rows of every segment lie their content hashes, in folders by their first hex digits. An update joins
    its batch with the folders of its own digits only: a small batch never reads the hashes of the whole store.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str] = ("doc_id", "chunk_no"), text: str = "text"):
        self.table = VersionedTable(spark, path, {"hashes": Side(hash_index, ["prefix"])})
        self.order, self.text = tuple(order), text

    def read(self) -> DataFrame | None:
        return self.table.read()

    def known_hashes(self, batch: DataFrame) -> DataFrame | None:
        """Hashes of the store in the folders that the batch's hashes fall into; None without a version."""
        marker = self.table.ready.latest()
        if marker is None:
            return None
        digits = {folder_digits(s["rows"]) for s in marker["segments"]}
        longest = with_hash(batch, self.text).select(hash_prefix(max(digits)).alias("p")).distinct()
        found = [r["p"] for r in longest.collect()]  # at most 16 ** 4
        folders = {p if p == "none" else p[: 1 + d] for p in found for d in digits}
        named = ", ".join(f"'{f}'" for f in sorted(folders)) or "''"
        return self.table.read(marker["version"], "hashes").where(F.expr(f"prefix IN ({named})")).select(HASH)

    def update(
        self,
        batch: DataFrame,
        reindex_threshold: int | None = None,
        deduplicate: bool = True,
        embed: Callable[[DataFrame], DataFrame] | None = None,
    ) -> int | None:
        """Publish one version with the batch's new documents; None when there is nothing new.

        An update costs the batch. With `reindex_threshold`, a set of more distinct documents is
        written as one set of files instead and, with `embed`, all its texts are embedded anew.
        """
        if deduplicate:
            first = written(_first_keys(batch, self.order, self.text))  # every text is hashed once
            fresh = written(_kept(batch, first, self.known_hashes(first), self.order, self.text))
        else:
            fresh = written(with_hash(batch, self.text))
        if not fresh.limit(1).collect():
            return None
        store = self.table.read() if reindex_threshold is not None else None
        if store is not None:
            ids = store.select(self.order[0]).unionByName(fresh.select(self.order[0])).distinct()
            if ids.limit(reindex_threshold + 1).count() > reindex_threshold:
                whole = store.select(*fresh.columns).unionByName(fresh)
                return self.table.write(embed(whole) if embed else whole)
        return self.table.append(embed(fresh) if embed else fresh)

    def search(
        self,
        texts: DataFrame,
        embed: Callable[[DataFrame], DataFrame],
        k: int = 3,
        key: str = "query_id",
        vector: str = "embedding",
        shared: bool = False,
    ) -> DataFrame | SharedHits:
        """(query_id, id, distance, rank, document): the k documents of the latest version nearest to each text.

        `texts` has a unique `key` and the store's text column; `embed` is the function the store was filled with. `id`
        is the text of the first order column; equal distances go by all order columns and the content hash, as text.
        Without a version there are no hits. Each text is embedded once, and texts that get the same vector are searched
        as one; if `shared`, their hits are not repeated for each of them either.
        """
        found = self._search(texts, embed, k, key, vector)
        return found if shared else found.rows()

    def _search(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int, key: str, vector: str) -> SharedHits:
        store = self.table.read()
        if store is None:
            spark = texts.sparkSession
            members = spark.createDataFrame([], T.StructType([T.StructField("query_id", texts.schema[key].dataType), T.StructField("group", T.LongType())]))
            return SharedHits(members, spark.createDataFrame([], "group long, id string, distance double, rank int, document string"))
        place = F.concat_ws(":", *[F.col(c).cast("string") for c in (*self.order, HASH)])
        base = store.select(place.alias("__place"), F.col(self.order[0]).cast("string").alias("id"), F.col(self.text).alias("document"), vector)
        asked = embed(texts.where(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), self.text))
        asked = written(asked.select("query_id", F.col(vector).alias("__vector")))
        groups = written(asked.select("__vector").distinct().select("__vector", F.monotonically_increasing_id().alias("group")))
        size = groups.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__vector")).alias("d")).first()
        few = size["n"] <= BROADCAST_ROWS and size["n"] * (size["d"] or 0) <= BROADCAST_ROWS
        members = asked.join(F.broadcast(groups) if few else groups, "__vector").select("query_id", "group")
        # the narrow hits are kept: a caller that reads them twice searches once, and no text is written
        known = base.select(F.col("__place").alias("group"), F.col(vector).alias("__vector"))
        hits = written(cosine_top_k(groups, known, k, "group", "__vector").withColumnsRenamed({"query_id": "group", "id": "__place"}))
        named = base.select("__place", "id", "document")
        places = hits.select(F.xxhash64("__place").alias("__h")).distinct()
        if size["n"] * k <= BROADCAST_ROWS:  # only documents that may be among the hits are shuffled
            named = named.join(F.broadcast(places), F.xxhash64("__place") == F.col("__h"), "left_semi")
        named = named.dropDuplicates(["__place"])
        return SharedHits(members, hits.join(named, "__place").select("group", "id", "distance", "rank", "document"))


class TextEmbedder:
    """Offline default embedding: hashed words, inverse document frequency, unit length."""

    def __init__(self, dimensions: int = 256, text: str = "text", name: str = "embedding"):
        self.dimensions, self.text, self.name = dimensions, text, name

    def fit(self, df: DataFrame) -> PipelineModel:
        stages = [
            RegexTokenizer(inputCol=self.text, outputCol="__words", pattern=r"(?U)[^\w]+"),
            HashingTF(inputCol="__words", outputCol="__tf", numFeatures=self.dimensions),
            IDF(inputCol="__tf", outputCol="__idf"),
            Normalizer(inputCol="__idf", outputCol="__unit"),
        ]
        return Pipeline(stages=stages).fit(df)

    def apply(self, model: PipelineModel, df: DataFrame) -> DataFrame:
        out = model.transform(df).withColumn(self.name, vector_to_array("__unit", "float32"))
        return out.drop("__words", "__tf", "__idf", "__unit")


#: Texts that an embedding function gets at once.
EMBED_ROWS = 512


def embed_with(
    df: DataFrame, function: Callable[[list[str]], Sequence[Sequence[float]]], text: str = "text", name: str = "embedding"
) -> DataFrame:
    """Embed by a user function from a list of texts to a list of vectors, at most `EMBED_ROWS` texts a call.

    Other columns pass as they are; no more than the texts and vectors of one call become Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, EMBED_ROWS):
                part = batch.slice(start, EMBED_ROWS)
                vectors = function(part.column(part.schema.get_field_index(text)).to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
                numbers = np.fromiter(chain.from_iterable(vectors), np.float64, ends[-1])
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)


# Document types of tables.
PARENT, ROW = "table_parent", "table_row"


def table_documents(df: DataFrame, doc_id: str | Column | None = None) -> DataFrame:
    """Only table documents, stamped with a document id and a stable `uid`."""
    kept = df.where(F.col("type").isin(PARENT, ROW))
    if doc_id is not None:
        kept = kept.withColumn("doc_id", F.lit(doc_id) if isinstance(doc_id, str) else doc_id)
    base = [F.col("doc_id").cast("string"), F.lit("tbl"), F.col("table_id").cast("string")]
    row = F.coalesce("row_index", F.lit(0)).cast("string")
    uid = F.when(F.col("type") == PARENT, F.concat_ws("::", *base, F.lit("parent"))).otherwise(
        F.concat_ws("::", *base, F.lit("row"), row)
    )
    return kept.withColumn("uid", uid)


def upsert_table_documents(store: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Re-ingest without duplicates: rows with a known `uid` are replaced."""
    return upsert(store, batch, ["uid"], order)


def fetch_table_family(
    df: DataFrame, table_ids: DataFrame | None = None, include_parent: bool = True, row_limit: int = 1000
) -> DataFrame:
    """Parent and first rows (by `row_index`) of every wanted table, numbered by `position`.

    Where the rows have a `doc_id`, documents may share table ids: a table is a (doc_id, table_id), and `table_ids` that
    names documents too wants the tables of those documents only.
    """
    kinds = [PARENT, ROW] if include_parent else [ROW]
    kept = df.where(F.col("type").isin(kinds))
    owner = [c for c in ("doc_id", "table_id") if c in df.columns]
    if table_ids is not None:
        on = [c for c in owner if c in table_ids.columns]
        kept = kept.join(table_ids.select(*on).distinct(), on, "left_semi")
    index = F.coalesce("row_index", F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*owner, "type").orderBy(index, "uid"))
    limit = F.when(F.col("type") == PARENT, F.lit(1)).otherwise(F.lit(row_limit))
    # the first condition lets the scan side keep at most row_limit rows per table and type
    first = kept.withColumn("__r", rank).where(F.col("__r") <= max(row_limit, 1)).where(F.col("__r") <= limit)
    position = F.when(F.col("type") == PARENT, F.lit(0)).otherwise(F.col("__r"))
    return first.withColumn("position", position).drop("__r")


def inspect_tables(df: DataFrame, top: int = 5) -> DataFrame:
    """Per document: parent and row counts and its tables with most rows."""
    per_table = df.where(F.col("type").isin(PARENT, ROW)).groupBy("doc_id", "table_id").agg(
        F.count_if(F.col("type") == PARENT).alias("parents"),
        F.count_if(F.col("type") == ROW).alias("rows"),
        F.max(F.when(F.col("type") == PARENT, F.col("columns"))).alias("columns"),
    )
    totals = per_table.groupBy("doc_id").agg(F.sum("parents").alias("doc_parents"), F.sum("rows").alias("doc_rows"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("rows"), "table_id"))
    best = per_table.where(F.col("rows") > 0).withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "doc_id").select("doc_id", "doc_parents", "doc_rows", "rank", "table_id", "rows", "columns")


def biggest_table_sample(df: DataFrame, sample: int = 3) -> DataFrame:
    """First rows of the biggest table of every document."""
    biggest = inspect_tables(df, 1).select("doc_id", "table_id")
    return fetch_table_family(df, biggest, include_parent=False, row_limit=sample)


def request_lines(df: DataFrame, custom_id: str, body: Sequence[str], url: str = "/v1/responses") -> DataFrame:
    """One JSON line per batch request."""
    line = F.to_json(
        F.struct(
            F.col(custom_id).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"),
            F.struct(*body).alias("body"),
        )
    )
    return df.select(line.alias("value"))


_RESULT = "struct<custom_id:string,response:struct<status_code:int,body:string>>"


def result_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """custom_id, status_code and body text of batch result lines; broken lines have no id."""
    parsed = F.from_json(line, _RESULT)
    return df.select(
        parsed["custom_id"].alias("custom_id"),
        parsed["response"]["status_code"].alias("status_code"),
        parsed["response"]["body"].alias("body"),
    )


class Collections:
    """Named document collections as catalog tables: `<base>_<provider>`."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    @staticmethod
    def name(base: str, provider: str) -> str:
        return f"{base}_{provider}"

    def _full(self, name: str) -> str:
        return f"{self.database}.{name}"

    def create(self, name: str, df: DataFrame) -> None:
        df.write.mode("errorifexists").saveAsTable(self._full(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._full(name))

    def copy(self, old: str, new: str) -> None:
        """Texts, metadata and vectors of a collection under a new name."""
        self.create(new, self.read(old))

    def rename(self, old: str, new: str) -> None:
        self.spark.sql("ALTER TABLE IDENTIFIER(:old) RENAME TO IDENTIFIER(:new)", args={"old": self._full(old), "new": self._full(new)})

    def delete(self, name: str) -> None:
        self.spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": self._full(name)})

    def list(self) -> DataFrame:
        tables = self.spark.sql("SHOW TABLES IN IDENTIFIER(:name)", args={"name": self.database}).where(~F.col("isTemporary"))
        return tables.select(F.col("tableName").alias("collection"))
