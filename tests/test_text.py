import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import documents as dc
from riskloom.operators import similarity as sm


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


def merge_splits(text, size, overlap, sep):
    """Independent greedy packing with overlap."""
    pieces, done, open_, total = [p for p in text.split(sep) if p], [], [], 0
    for p in pieces:
        if total + len(p) + (len(sep) if open_ else 0) > size and open_:
            done.append(sep.join(open_))
            while total > overlap or (total + len(p) + (len(sep) if open_ else 0) > size and total > 0):
                total -= len(open_[0]) + (len(sep) if len(open_) > 1 else 0)
                open_ = open_[1:]
        open_ = [*open_, p]
        total += len(p) + (len(sep) if len(open_) > 1 else 0)
    done.append(sep.join(open_))
    return [c.strip() for c in done if c.strip()]


@pytest.mark.parametrize("size, overlap", [(20, 6), (12, 0), (5, 3), (30, 10)])
def test_character_chunks(spark, size, overlap):
    text = "alpha\n\nbe\n\nc\n\ngamma delta epsilon zeta eta\n\nd\n\n\n\ntheta\n\ni j\n\nkappa"
    assert one(spark, text, tx.split_characters("text", size, overlap)) == merge_splits(text, size, overlap, "\n\n")


def test_sentence_chunks(spark):
    text = "One two.  Three\tfour. Five six seven. \n\n Short one. X"
    assert one(spark, text, tx.split_sentences("text", 20)) == ["One two. Three four", "Five six seven.", "Short one. X"]
    assert one(spark, "aaaaaaaa. b", tx.split_sentences("text", 5, compat=True)) == ["", "aaaaaaaa", "b"][:2] + ["b"]
    assert one(spark, "a. b", tx.split_sentences("text", 50, compat=True)) == [". a. b"]
    assert one(spark, "   ", tx.split_sentences("text", 50)) == []


def test_hash_is_of_the_normal_form(spark):
    text = "  Ünïcode  Text,\n with— punctuation_1! "
    low = re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", text.lower()).strip())
    assert one(spark, text, tx.normal_form("text")) == low
    assert one(spark, text, tx.content_hash("text")) == hashlib.sha256(low.encode()).hexdigest()


def test_json_object(spark):
    assert one(spark, 'x ```json\n{"a": {"b": 1}}\n``` {', tx.json_object("text")) == '{"a": {"b": 1}}'
    assert one(spark, 'say {"a": 1} now', tx.json_object("text")) == '{"a": 1}'
    assert one(spark, "none", tx.json_object("text")) is None and one(spark, "{broken", tx.json_object("text")) is None


RECORD = "record_id string, risk_type string, territory string, industry string, limit long, premium long, broker string, prior_claims double, years_trading double"


def test_record_sentence_and_query(spark):
    df = spark.createDataFrame(
        [("NEW_0001", " Cyber", "EU", "transport", 3438000, 26904, "Meridian Re ", 1.0, 4.0), ("NEW_0002", "fire", "Mars", None, 900, 1500, "B", 7.0, None)], RECORD
    )
    a, b = df.select(tx.record_sentence("Acme Underwriting").alias("s"), tx.retrieval_query().alias("q")).collect()
    assert a["s"] == (
        "This is a cyber record covering cyber incident response and data breach liability, submitted by Meridian Re for a transport account "
        "domiciled in the EU. The insured is a recently established entity, with one prior claim on record. "
        "The policy limit is $3.4m and the quoted premium is $27k, placed with Acme Underwriting."
    )
    assert "$900 and the quoted premium is $2k" in b["s"] and "an undisclosed industry account Mars" in b["s"] and "7 prior claims" in b["s"]
    assert a["q"] == " Cyber transport company in EU with 1 prior claim(s) limit 3,438,000"
    empty = spark.createDataFrame([(None,) * 7 + (0.0, None)], RECORD)
    assert empty.select(tx.retrieval_query()).first()[0] == "insurance record"


def test_dedupe_keeps_the_first_of_a_huge_group_of_copies(spark):
    batch = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"),
        F.when(F.col("id") % 3 == 1, F.lit("Same, text")).otherwise(F.concat(F.lit("doc "), F.floor(F.col("id") / 2))).alias("text"),
    )
    store = spark.createDataFrame([(9, 9, "DOC 0")], "doc_id long, chunk_no int, text string")
    out = dc.new_documents(batch, store).toPandas()
    assert (out["text"] == "Same, text").sum() == 1 and out.loc[out["text"] == "Same, text", "doc_id"].item() == 1
    assert "doc 0" not in set(out["text"]) and out["content_hash"].is_unique


def test_store_versions(spark, tmp_path):
    store = dc.DocumentStore(spark, str(tmp_path / "store"))
    docs = lambda *texts: spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "doc_id int, chunk_no int, text string")
    assert store.read() is None
    assert store.update(docs("a", "b", "B!")) == 1 and store.update(docs("a", "b")) is None
    assert store.update(docs("c")) == 2 and store.read().count() == 3
    assert store.update(docs("a"), deduplicate=False) == 3 and store.read().count() == 4
    assert store.update(docs("d"), reindex_threshold=1) == 4  # written as one set, published once
    assert store.table.markers().where("version = 4").first()["segments"] == [4] and store.read().count() == 5
    assert store.table.read(1).count() == 2


def brute(qs, base, k, skip):
    out = set()
    for qi, q in qs:
        d = []
        for i, v in base:
            n = np.linalg.norm(q) * np.linalg.norm(v)
            if n > 0 and not (skip and i == qi):
                d.append((round(1 - float(np.dot(q, v)) / n, 9), i))
        out |= {(qi, i, round(x, 4), r + 1) for r, (x, i) in enumerate(sorted(d)[:k])}
    return out


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("skip", [True, False])
def test_top_k_with_copies_and_zero_vectors(spark, monkeypatch, limit, skip):
    monkeypatch.setattr(sm, "QUERY_BLOCK", 16)
    monkeypatch.setattr(sm, "BASE_BLOCK", 32)
    rng = np.random.default_rng(1)
    base = [(i, ([1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).round(3).tolist())) for i in range(120)]
    base[7] = (7, [0.0, 0.0, 0.0])
    df = spark.createDataFrame(base, "id long, embedding array<double>")
    got = sm.cosine_top_k(df, df, 4, skip_same=skip, broadcast_numbers=limit)
    assert {tuple(r) for r in got.collect()} == brute(base, base, 4, skip)


def test_approximate_search_with_all_cells_is_exact(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(80)], "id long, embedding array<double>")
    exact = sm.cosine_top_k(df, df, 3)
    assert sm.recall(sm.cosine_top_k_approximate(df, df, 3, cells=4, probes=4), exact).first()["recall"] == 1.0
    assert sm.cosine_top_k(df, df, 99).groupBy("query_id").count().agg(F.max("count")).first()[0] == min(99, df.count())


def test_table_family(spark):
    data = [("t", "table_parent", None, "p"), ("t", "table_row", 2, "b"), ("t", "table_row", 0, "a"), ("t", "note", 0, "x"), ("u", "table_row", 0, "c")]
    docs = dc.table_documents(spark.createDataFrame(data, "table_id string, type string, row_index int, text string").withColumn("columns", F.lit("c")), "D")
    assert {r["uid"] for r in docs.collect()} == {"D::tbl::t::parent", "D::tbl::t::row::2", "D::tbl::t::row::0", "D::tbl::u::row::0"}
    wanted = spark.createDataFrame([("t",)], "table_id string")
    got = dc.fetch_table_family(docs, wanted, row_limit=1).orderBy("position").collect()
    assert [r["text"] for r in got] == ["p", "a"]
    assert [r["text"] for r in dc.biggest_table_sample(docs, 2).orderBy("position").collect()] == ["a", "b"]


def test_embedding_function_must_return_one_vector_each(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    assert sorted(r["embedding"] for r in dc.embed_with(df, lambda x: [[len(s), 1] for s in x]).collect()) == [[1.0, 1.0]] * 2
    with pytest.raises(Exception, match="0 vectors"):
        dc.embed_with(df, lambda x: []).collect()
