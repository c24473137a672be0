"""Requests parsed once, texts hashed and embedded once, hits and evidence shared by equal vectors."""

import json

from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import documents as dc
from riskloom.operators import policy as pl
from riskloom.operators.similarity import SharedHits
from riskloom.sources.files import record_struct


def test_a_record_is_parsed_once(spark):
    texts = ['{"record_id":"a","limit":5,"premium":"x"}', '{"record":{"record_id":"b","prior_claims":2}}', '{"record":7,"record_id":"c"}', "[1]", "{", None]
    texts += ['{"\\u0072ecord":{"record_id":"d"}}', '{"x":{"record":{"record_id":"no"}},"record_id":"e"}', '{"record" : {"record_id":"f"},"record_id":"no"}']
    df = spark.createDataFrame([(t,) for t in texts], "payload string").repartition(2)
    out = df.select(record_struct("payload").alias("r")).select("r.*")
    assert out._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    got = sorted((r["record_id"], r["limit"], r["premium"], r["prior_claims"]) for r in out.where("record_id IS NOT NULL").collect())
    assert got == [("a", 5.0, None, None), ("b", None, None, 2.0), ("c", None, None, None), *((k, None, None, None) for k in "def")] and out.count() == 9


def test_squeezed_runs(spark):
    texts = ["a b", "a  b", "a\tb", " \n a  b\r\n", "a \t b\n\n c ", "", " ", " ", "a \u0085", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tx.squeeze("t").alias("s"), F.regexp_replace("t", r"(?U)\s+", " ").alias("w")).collect()
    assert all(r["s"] == r["w"] for r in got)


def test_an_update_hashes_every_text_once(spark, tmp_path, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counted(text):
        def one(t):
            calls.add(1)
            return f"{len(t):064x}"

        return F.udf(one, "string")(text)

    monkeypatch.setattr(dc, "content_hash", counted)
    store = dc.DocumentStore(spark, str(tmp_path / "store"), ["doc_id"])
    for first in (0, 40):
        store.update(spark.createDataFrame([(i, "x" * (i % 60)) for i in range(first, first + 40)], "doc_id int, text string"))
    assert calls.value == 80
    assert sorted(r["doc_id"] for r in store.read().collect()) == list(range(60))


def _store(spark, tmp_path, calls):
    def vectors(texts):
        calls.add(len(texts))
        return [[1, s.count("a"), s.count("e")] if s != "none" else [0, 0, 0] for s in texts]

    embed = lambda df: dc.embed_with(df, vectors)
    store = dc.DocumentStore(spark, str(tmp_path / "store"), ["doc_id"])
    store.update(spark.createDataFrame([(f"D{i}", "a" * (i % 4) + "e" * (i // 4) + "x" * i) for i in range(12)], "doc_id string, text string"), embed=embed)
    return store, embed


def test_texts_of_one_vector_share_their_hits(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    store, embed = _store(spark, tmp_path, calls)
    before = calls.value
    words = [f"{w}{'z' * i}" for i in range(15) for w in ("a", "ae", "eea")] + ["none"]
    texts = spark.createDataFrame([(w, w) for w in words] + [(None, "a")], "query_id string, text string")
    shared = store.search(texts, embed, 3, shared=True)
    assert isinstance(shared, SharedHits)
    hits = shared.hits.collect()
    assert len(hits) == 9 and shared.members.where("query_id <> 'none'").count() == 45
    assert calls.value - before == 46  # no text is embedded again, whatever reads the hits
    flat = store.search(texts, embed, 3).collect()
    assert len(flat) == 45 * 3 and {r["query_id"] for r in flat} == {w for w in words if w != "none"}
    one = {w: sorted((r["rank"], r["id"], r["distance"], r["document"]) for r in flat if r["query_id"] == w) for w in ("a", "azzz", "ae", "eeazz")}
    assert one["a"] == one["azzz"] and one["a"][0][1] == "D1" and one["ae"][0][1:3] == ("D5", 0.0) and one["eeazz"][0][1] == "D9"


def test_shared_evidence_is_the_evidence_of_each_request(spark, tmp_path):
    store, embed = _store(spark, tmp_path, spark.sparkContext.accumulator(0))
    rows = [(f"R{i}", t, p, i % 3 == 0) for i, (t, p) in enumerate((t, p) for t in ("a", "azz", "eea", "eeaz", "none", 'q"a\\') for p in (0.5, 0.55, 0.95, None))]
    scored = spark.createDataFrame(rows, "record_id string, words string, probability_of_loss double, is_loss_making_prediction boolean").select(
        "*", F.array(F.lit("limit")).alias("top_features"), F.array().cast("array<string>").alias("model_warnings"),
        F.when(F.col("record_id") == "R3", F.array(F.lit("optional_field_missing:broker"))).otherwise(F.array().cast("array<string>")).alias("input_quality_flags"),
        F.when(F.col("probability_of_loss").isNull(), "no prediction").alias("prediction_error"),
    )
    texts = scored.select(F.col("words").alias("query_id"), F.col("words").alias("text")).distinct()
    outcomes = spark.createDataFrame([(f"D{i}", i % 2 == 0) for i in range(12)], "record_id string, is_loss_making boolean")
    shared, flat = (
        sorted(pl.assess(scored, store.search(texts, embed, 3, shared=s), outcomes, "record_id", ["record_id", "words"], 0.9, "words").collect())
        for s in (True, False)
    )
    assert shared == flat and len(shared) == 24
    for r in shared:
        _, words, p, _ = next(x for x in rows if x[0] == r["record_id"])
        low = p is None or p < 0.6
        if words == "none" and low:
            assert r["recommendation"] == pl.RECOMMENDATION and r["evidence"] is None
            continue
        told = json.loads(r["evidence"])
        names = ["record", "prediction", "confidence_level", "risk_assessment", "second_opinion_recommended", "retrieved_records", "warnings"]
        assert list(told) == [n for n in names if low or n != "retrieved_records"]
        assert told["record"] == {"words": words} and told["warnings"] == r["warnings"]
        assert not low or [list(h) for h in told["retrieved_records"]] == [["record_id", "document", "distance"]] * 3
