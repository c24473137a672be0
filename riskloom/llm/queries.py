"""Registered queries of the corpus operators: name -> query, and SQL where it can express one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import oracles
from riskloom.llm.common import bound_batches
from riskloom.session import shared_folder

#: Weights of the registered mixture, per level and value; other values weigh 1.
MIX_WEIGHTS = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4, "de": 2}, "source": {"src0": 2}}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            bound_batches(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op10_url_templates", oracles.URLS)
def op10_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.urls import template_tree

    pages = table(spark, folder, "pages").select("page_id", "url")
    return template_tree(pages).select("page_id", "host", "path", "rule", "verdict", "template", F.round("score", 6).alias("score"))


@query("op5_chat_windows", oracles.CHAT)
def op5_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.chat import chat_windows, read_windows

    says = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(says).alias("text"))
                    for i, r in enumerate(("user", "assistant"))
                ]
            )
        )
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    windows = read_windows(chat_windows(turns))
    row = F.struct("window", "turns", "loss_text", F.length("formatted").alias("n"))
    whole = windows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("w"))
    told = F.flatten(F.transform("w", lambda x: x["turns"]))
    text = F.concat_ws("", F.transform(told, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("w", lambda x: x["loss_text"]))
    return whole.select(
        "conv_id",
        F.size(told).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("formatted_chars"),
    )


@query("op3_mixture")
def op3_mixture(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.mixing import mix

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, weights=MIX_WEIGHTS).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query(
    "op8_arc_to_warc",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS h FROM pages
    ), d AS (
      SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p
    ), f AS (
      SELECT payload_digest, min(page_id) AS low FROM d WHERE payload_bytes >= 100 GROUP BY 1
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN low IS NOT NULL AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN low IS NOT NULL AND page_id <> low THEN low END AS refers_to
    FROM d LEFT JOIN f USING (payload_digest)
    """,
)
def op8_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.warc import convert_pages

    path = shared_folder(spark, "warc", uuid.uuid4().hex)
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return convert_pages(pages, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_decontaminate", oracles.DECONTAMINATE)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.decontaminate import digest, scan

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digest(scan(docs, table(spark, folder, "benchmark")))


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.quality import classify

    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_pii")
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.pii import digest, find

    return digest(find(table(spark, folder, "documents").select("doc_id", "text")))


@query("op1_minhash", oracles.MINHASH)
def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op6_embedding_grid", oracles.EMBEDDINGS)
def op6_embedding_grid(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.gridjoin import near_duplicates

    return near_duplicates(table(spark, folder, "embeddings"))


@query("op9_substrings", oracles.SUBSTRINGS)
def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.substrings import remove_repeats

    done = remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_bond_negatives", oracles.NEGATIVES)
def op11_bond_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.bond import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, lambda key: key % 100 == 0)


@query("op12_jump_shards", oracles.SHARDS)
def op12_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.shards import shard

    return shard(table(spark, folder, "documents").select("doc_id", "text"), 40)


@query("op13_spelling_trie", oracles.SPELLING)
def op13_spelling_trie(spark: SparkSession, folder: str) -> DataFrame:
    from riskloom.llm.variants import group_variants, vocabulary

    return group_variants(vocabulary(table(spark, folder, "documents").select("doc_id", "text"), noisy=True))
