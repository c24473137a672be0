"""Chunks, hashes, deduplication, document stores, embeddings, top-k search and table documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.functions import text as tx
from riskloom.operators import documents as dc
from riskloom.operators import similarity as sm
from riskloom.plans.frames import written
from riskloom.session import shared_folder


def _folder(t) -> str:
    return shared_folder(t.spark, "documents", uuid.uuid4().hex)


_SEP = "chr(10)"


def _pack_sql(pieces: str, sep: str, width: int, size: int, overlap: int) -> str:
    """Greedy packing, piece by piece, as a recursive query: (doc_id, n, chunk)."""
    joined = f"array_to_string(open, {sep})"
    tail = f"array_to_string(open[j + 1:], {sep})"
    fits = f"length({joined}) + length(p) + CASE WHEN len(open) > 0 THEN {width} ELSE 0 END <= {size} OR len(open) = 0"
    carry = (
        f"""open[list_filter(range(1, len(open) + 1), lambda j: length({tail}) <= {overlap} AND (j = len(open)
            OR length({tail}) + length(p) + {width} <= {size}))[1] + 1:]"""
        if overlap
        else "[]::VARCHAR[]"
    )
    return f"""pieces AS ({pieces}),
        r AS (SELECT doc_id, ps, 0 AS i, []::VARCHAR[] AS open, NULL::VARCHAR AS closed FROM pieces
            UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN i >= len(ps) THEN []::VARCHAR[] WHEN {fits} THEN list_append(open, p)
                ELSE list_append({carry}, p) END,
                CASE WHEN i >= len(ps) THEN {joined} WHEN {fits} THEN NULL ELSE {joined} END
            FROM (SELECT *, ps[i + 1] AS p FROM r WHERE i < len(ps) OR (i = len(ps) AND len(open) > 0))),
        chunks AS (SELECT doc_id, i, trim(closed, chr(32) || chr(10) || chr(9) || chr(13)) AS chunk FROM r WHERE closed IS NOT NULL)"""


_LINES = f"SELECT doc_id, list_filter(string_split(text, {_SEP}), lambda p: p <> '') AS ps FROM documents"


@query(
    "tx1_character_chunks",
    f"""WITH RECURSIVE {_pack_sql(_LINES, _SEP, 1, 1000, 10)}
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_no, chunk AS text FROM chunks WHERE chunk <> ''""",
)
def _(t):
    return dc.character_chunks(t.documents, separator="\n")


_SENTENCES = r"""SELECT doc_id, CASE WHEN length(s) <= 400 THEN [s] ELSE list_filter(string_split(s, '. '), lambda p: p <> '') END AS ps
    FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) WHERE s <> ''"""


@query(
    "tx2_sentence_chunks",
    f"""WITH RECURSIVE {_pack_sql(_SENTENCES, "'. '", 2, 400, 0)}
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_no,
            md5(chunk) AS digest, length(chunk) AS characters FROM chunks""",
)
def _(t):
    out = dc.sentence_chunks(t.documents, 400)
    return out.select("doc_id", "chunk_no", F.md5(F.trim("text")).alias("digest"), F.char_length(F.trim("text")).cast("long").alias("characters"))


@query(
    "tx2_sentence_chunks_compat",
    r"""WITH RECURSIVE p AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), '. ') AS ps FROM documents),
        r AS (SELECT doc_id, ps, 0 AS i, '' AS open, NULL::VARCHAR AS closed FROM p
            UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN i < len(ps) AND length(open) + length(ps[i + 1]) > 400 THEN ps[i + 1]
                WHEN i < len(ps) THEN open || '. ' || ps[i + 1] ELSE '' END,
                CASE WHEN i >= len(ps) OR length(open) + length(ps[i + 1]) > 400 THEN open END FROM r WHERE i <= len(ps))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_no, md5(closed) AS digest FROM r WHERE closed IS NOT NULL""",
)
def _(t):
    out = dc.sentence_chunks(t.documents, 400, compat=True)
    return out.select("doc_id", "chunk_no", F.md5("text").alias("digest"))


NORMAL_SQL = r"regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{M}\p{N}_\s]', '', 'g')"


@query("tx3_normal_form", f"SELECT doc_id, {NORMAL_SQL} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normal_form("text").alias("text"))


@query("tx4_content_hash", f"SELECT doc_id, sha256({NORMAL_SQL}) AS content_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.content_hash("text").alias("content_hash"))


_HASHED = f"h AS (SELECT doc_id, sha256({NORMAL_SQL}) AS content_hash FROM documents)"


@query(
    "tx5_new_documents",
    f"""WITH {_HASHED} SELECT min(doc_id) AS doc_id, content_hash FROM h WHERE doc_id % 3 <> 0
        AND content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id % 3 = 0) GROUP BY 2""",
)
def _(t):
    docs = t.documents.select("doc_id", "text")
    out = dc.new_documents(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), ["doc_id"])
    return out.select("doc_id", "content_hash")


@query(
    "tx5_conversation_turns",
    f"""WITH h AS (SELECT conv_id, turn, sha256({NORMAL_SQL}) AS content_hash FROM conversations)
        SELECT conv_id, turn, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY conv_id, turn) AS r FROM h) WHERE r = 1""",
)
def _(t):
    out = dc.new_documents(t.conversations.select("conv_id", "turn", "text"), None, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "content_hash")


@query(
    "jn7_unknown_hashes",
    f"""WITH {_HASHED}, p AS (SELECT page_id, sha256({NORMAL_SQL.replace('text', 'html')}) AS content_hash FROM pages)
        SELECT doc_id FROM h WHERE content_hash NOT IN (SELECT content_hash FROM p)""",
)
def _(t):
    known = t.pages.select(tx.content_hash("html").alias("content_hash")).distinct()
    return t.documents.select("doc_id", tx.content_hash("text").alias("content_hash")).join(known, "content_hash", "left_anti").select("doc_id")


@query(
    "tx6_incremental_store",
    f"""WITH {_HASHED} SELECT doc_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id % 2, doc_id) AS r FROM h) WHERE r = 1""",
)
def _(t):
    store = dc.DocumentStore(t.spark, _folder(t), ["doc_id"])
    docs = t.documents.select("doc_id", "text")
    store.update(docs.where("doc_id % 2 = 0"), reindex_threshold=100)
    store.update(docs.where("doc_id % 2 = 1"), reindex_threshold=100)
    store.update(docs.where("doc_id % 2 = 1"), reindex_threshold=100)
    return store.read().select("doc_id", "content_hash")


@query(
    "tx7_default_embedding",
    r"SELECT doc_id, CAST(128 AS INT) AS dimensions, CASE WHEN regexp_matches(text, '[\pL\pN_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
)
def _(t):
    embedder = dc.TextEmbedder(128)
    docs = t.documents.select("doc_id", "text")
    out = embedder.apply(embedder.fit(docs), docs)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(norm), 4).alias("norm"))


def letters(texts):
    """A plain embedding: length and four letter counts."""
    return [[len(s), *(s.count(c) for c in "aein")] for s in texts]


def letters_sql(column: str) -> str:
    counts = ", ".join(f"length({column}) - length(replace({column}, '{c}', ''))" for c in "aein")
    return f"[length({column}), {counts}]::DOUBLE[]"


STORED = f"""{_HASHED}, stored AS (SELECT concat(doc_id, ':', content_hash) AS place, doc_id, {letters_sql('text')} AS v FROM documents JOIN h USING (doc_id)
    WHERE doc_id IN (SELECT min(doc_id) FROM h GROUP BY content_hash))"""


def letter_store(t):
    """A store of all documents with the plain embedding, filled in two updates."""
    store = dc.DocumentStore(t.spark, _folder(t), ["doc_id"])
    embed = lambda df: dc.embed_with(df, letters)
    docs = t.documents.select("doc_id", "text")
    half = docs.agg((F.max("doc_id") / 2).cast("long")).first()[0]
    for batch in (docs.where(F.col("doc_id") <= half), docs.where(F.col("doc_id") > half)):
        store.update(batch, embed=embed)
    return store, embed


@query(
    "tx6_text_search",
    f"""WITH {STORED} SELECT query_id, id, round(d, 4) AS distance, CAST(r AS INT) AS rank FROM (
            SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, place) AS r FROM (
                SELECT p_partkey AS query_id, CAST(doc_id AS VARCHAR) AS id, place, round(1 - list_cosine_similarity({letters_sql('p_name')}, v), 9) AS d FROM part, stored))
        WHERE r <= 3""",
)
def _(t):
    store, embed = letter_store(t)
    return store.search(t.part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")), embed).drop("document")


@query(
    "tx6_missing_texts",
    """SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS text FROM nation
        WHERE n_nationkey % 3 <> 0 OR n_nationkey = 0""",
)
def _(t):
    store = dc.DocumentStore(t.spark, _folder(t), ["doc_id"])
    docs = t.nation.select(F.col("n_nationkey").alias("doc_id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("text"))
    store.update(docs)
    if store.update(docs) is not None:
        raise AssertionError("nothing new may publish no version")
    return store.read().select("doc_id", "text")


@query(
    "tx7_embedding_function",
    "SELECT doc_id, length(text)::FLOAT AS characters, (length(text) - length(replace(text, 'e', '')))::FLOAT AS e FROM documents",
)
def _(t):
    out = dc.embed_with(t.documents.select("doc_id", "text"), lambda texts: [[len(s), s.count("e")] for s in texts])
    return out.select("doc_id", F.col("embedding")[0].alias("characters"), F.col("embedding")[1].alias("e"))


_PAIRS = """SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d
    FROM embeddings a, embeddings b"""


@query(
    "tx8_cosine_top_k",
    f"""SELECT query_id, id, round(d, 4) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r
        FROM ({_PAIRS} WHERE a.vec_id <> b.vec_id)) WHERE r <= 3""",
)
def _(t):
    return sm.cosine_top_k(t.embeddings, t.embeddings, 3, "vec_id", skip_same=True)


@query(
    "tx8_cosine_top_k_blocks",
    f"""SELECT query_id, id, round(d, 4) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r
        FROM ({_PAIRS})) WHERE r <= 5""",
)
def _(t):
    return sm.cosine_top_k(t.embeddings, t.embeddings, 5, "vec_id", broadcast_numbers=0)


@query(
    "tx8_cosine_top_k_approximate",
    "SELECT count(*) FILTER (vec_id % 50 = 0) * 10 AS asked, TRUE AS enough FROM embeddings",
)
def _(t):
    # the default setting, each vector's own row left out
    queries = t.embeddings.where("vec_id % 50 = 0")
    near = sm.cosine_top_k_approximate(queries, t.embeddings, 10, "vec_id", skip_same=True)
    exact = written(sm.cosine_top_k(queries, t.embeddings, 10, "vec_id", skip_same=True))
    enough = sm.recall(near, exact).first()["recall"] >= 0.9
    return exact.agg(F.count(F.lit(1)).alias("asked"), F.lit(enough).alias("enough"))


@query(
    "tx8_kept_index",
    "SELECT count(*) FILTER (vec_id % 50 = 25) * 10 AS asked, TRUE AS enough, count(*) AS indexed FROM embeddings",
)
def _(t):
    # built on one half, the other half added, opened again, asked by rows that the probes were not chosen with
    path = _folder(t)
    sm.CosineIndex.build(t.embeddings.where("vec_id % 2 = 0"), path, "vec_id").add(t.embeddings.where("vec_id % 2 = 1"), "vec_id")
    index = sm.CosineIndex(t.spark, path)
    index.calibrate()
    queries = t.embeddings.where("vec_id % 50 = 25")
    exact = written(sm.cosine_top_k(queries, t.embeddings, 10, "vec_id", skip_same=True))
    enough = sm.recall(index.search(queries, 10, "vec_id", skip_same=True), exact).first()["recall"] >= 0.9
    return exact.agg(F.count(F.lit(1)).alias("asked"), F.lit(enough).alias("enough"), F.lit(index.rows.read().count()).alias("indexed"))


@query(
    "tx8_many_neighbours",
    f"""SELECT query_id, id, round(d, 4) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r
        FROM ({_PAIRS} WHERE a.vec_id <> b.vec_id)) WHERE r <= 25""",
)
def _(t):
    return sm.cosine_top_k(t.embeddings, t.embeddings, 25, "vec_id", skip_same=True)


@query(
    "tx8_cosine_top_k_all_cells",
    f"""SELECT query_id, id, round(d, 4) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r
        FROM ({_PAIRS})) WHERE r <= 3""",
)
def _(t):
    return sm.cosine_top_k_approximate(t.embeddings, t.embeddings, 3, "vec_id", cells=8, probes=8)


@query("tx9_collections", "SELECT 'docs_other' AS collection, CAST(count(*) AS BIGINT) AS documents FROM documents")
def _(t):
    database = f"store_{uuid.uuid4().hex}"
    t.spark.sql(f"CREATE DATABASE {database} LOCATION '{_folder(t)}'")
    names = dc.Collections(t.spark, database)
    first, second, third = (names.name("docs", p) for p in ("local", "remote", "other"))
    names.create(first, t.documents.select("doc_id", "text"))
    names.copy(first, second)
    names.rename(second, third)
    names.delete(first)
    documents = names.read(third).agg(F.count(F.lit(1))).first()[0]
    listed = [(r["collection"], documents) for r in names.list().collect()]
    t.spark.sql(f"DROP DATABASE {database} CASCADE")
    return t.spark.createDataFrame(listed, "collection string, documents long")


def _table_docs(t):
    """Nations as tables of customers, one document per region, with other documents in between."""
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    rows = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("region"), F.col("n_name").alias("table_id"), F.lit("table_row").alias("type"),
        F.col("c_custkey").cast("int").alias("row_index"), F.lit(None).cast("string").alias("columns"), F.col("c_name").alias("text"),
    )
    parents = nation.select(
        F.col("n_regionkey").alias("region"), F.col("n_name").alias("table_id"), F.lit("table_parent").alias("type"),
        F.lit(None).cast("int").alias("row_index"), F.lit("name,balance").alias("columns"), F.col("n_name").alias("text"),
    )
    other = parents.withColumns({"type": F.lit("paragraph")})
    return rows.unionByName(parents).unionByName(other)


_DOCS = """docs AS (SELECT n_regionkey AS region, n_name AS table_id, 'table_row' AS type, CAST(c_custkey AS INT) AS row_index, c_name AS text,
        concat('d', n_regionkey, '::tbl::', n_name, '::row::', c_custkey) AS uid FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, n_name, 'table_parent', NULL, n_name, concat('d', n_regionkey, '::tbl::', n_name, '::parent') FROM nation)"""


def _stamped(t):
    return dc.table_documents(_table_docs(t), F.concat(F.lit("d"), "region"))


@query("tx10_table_documents", f"WITH {_DOCS} SELECT uid, concat('d', region) AS doc_id, type, text FROM docs")
def _(t):
    return _stamped(t).select("uid", "doc_id", "type", "text")


@query(
    "tx10_table_documents_again",
    f"WITH {_DOCS} SELECT uid, CASE WHEN row_index % 2 = 0 THEN 'new' ELSE text END AS text FROM docs",
)
def _(t):
    docs = _stamped(t).select("uid", "row_index", "text")
    again = docs.where("row_index % 2 = 0").withColumn("text", F.lit("new"))
    return dc.upsert_table_documents(docs, again).select("uid", "text")


@query(
    "tx11_table_family",
    f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY table_id, type ORDER BY coalesce(row_index, 0), uid) AS r FROM docs)
        SELECT table_id, uid, CAST(CASE WHEN type = 'table_parent' THEN 0 ELSE r END AS INT) AS position FROM r WHERE r <= CASE WHEN type = 'table_parent' THEN 1 ELSE 40 END""",
)
def _(t):
    return dc.fetch_table_family(_stamped(t), row_limit=40).select("table_id", "uid", "position")


@query(
    "tx12_inspect_tables",
    f"""WITH {_DOCS}, p AS (SELECT concat('d', region) AS doc_id, table_id, count(*) FILTER (type = 'table_row') AS rows, count(*) FILTER (type = 'table_parent') AS parents FROM docs GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rows DESC, table_id) AS rank, sum(parents) OVER (PARTITION BY doc_id) AS dp, sum(rows) OVER (PARTITION BY doc_id) AS dr FROM p)
        SELECT doc_id, CAST(dp AS BIGINT) AS doc_parents, CAST(dr AS BIGINT) AS doc_rows, CAST(rank AS INT) AS rank, table_id, CAST(rows AS BIGINT) AS rows, 'name,balance' AS columns FROM k WHERE rank <= 5""",
)
def _(t):
    return dc.inspect_tables(_stamped(t))


@query(
    "tx12_biggest_table_sample",
    f"""WITH {_DOCS}, p AS (SELECT region, table_id, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, table_id) AS k FROM docs WHERE type = 'table_row' GROUP BY 1, 2),
        r AS (SELECT d.uid, row_number() OVER (PARTITION BY d.region, d.table_id ORDER BY row_index) AS r FROM docs d JOIN p ON p.region = d.region AND p.table_id = d.table_id AND k = 1 WHERE type = 'table_row')
        SELECT uid, CAST(r AS INT) AS position FROM r WHERE r <= 3""",
)
def _(t):
    return dc.biggest_table_sample(_stamped(t)).select("uid", "position")


_SHARED = """docs AS (SELECT concat('d', n_regionkey) AS doc_id, c_mktsegment AS table_id, 'table_row' AS type, CAST(c_custkey AS INT) AS row_index,
        concat('d', n_regionkey, '::tbl::', c_mktsegment, '::row::', c_custkey) AS uid FROM customer JOIN nation ON c_nationkey = n_nationkey),
    sized AS (SELECT doc_id, table_id, count(*) AS n FROM docs GROUP BY 1, 2)"""


def _shared_ids(t):
    """Market segments as tables of customers, one document per region: all documents have the same table ids."""
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = places.select(
        F.concat(F.lit("d"), "n_regionkey").alias("doc_id"), F.col("c_mktsegment").alias("table_id"), F.lit("table_row").alias("type"),
        F.col("c_custkey").cast("int").alias("row_index"), F.lit(None).cast("string").alias("columns"),
    )
    return dc.table_documents(rows)


@query(
    "tx12_shared_table_ids",
    f"""WITH {_SHARED}, big AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, table_id) AS k FROM sized),
        r AS (SELECT doc_id, table_id, uid, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row_index) AS r FROM docs JOIN big USING (doc_id, table_id) WHERE k = 1)
        SELECT doc_id, table_id, uid, CAST(r AS INT) AS position FROM r WHERE r <= 3""",
)
def _(t):
    return dc.biggest_table_sample(_shared_ids(t)).select("doc_id", "table_id", "uid", "position")


@query(
    "tx11_shared_table_ids",
    f"""WITH {_SHARED}, r AS (SELECT doc_id, table_id, uid, row_number() OVER (PARTITION BY doc_id, table_id ORDER BY row_index) AS r FROM docs)
        SELECT doc_id, table_id, uid, CAST(r AS INT) AS position FROM r WHERE r <= 5""",
)
def _(t):
    return dc.fetch_table_family(_shared_ids(t), row_limit=5).select("doc_id", "table_id", "uid", "position")


@query(
    "tx13_request_lines",
    """SELECT concat('{"custom_id":"', conv_id, '-', turn, '","method":"POST","url":"/v1/responses","body":{"role":"', role, '","input":', to_json(text), '}}') AS value FROM conversations""",
)
def _(t):
    df = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("cid"), "role", F.col("text").alias("input"))
    return dc.request_lines(df, "cid", ["role", "input"])


@query(
    "tx13_result_lines",
    """SELECT CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS VARCHAR) END AS custom_id, CASE WHEN event_id % 7 <> 0 THEN CAST(200 + event_id % 3 AS INT) END AS status_code,
        CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def _(t):
    line = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("custom_id"),
            F.struct((200 + F.col("event_id") % 3).cast("int").alias("status_code"), F.col("props").alias("body")).alias("response"),
        )
    )
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(line)
    out = dc.result_lines(t.events.select(broken.alias("value")))
    return out.select("custom_id", "status_code", F.get_json_object("body", "$.k").cast("long").alias("k"))
