"""Raw requests to assessments, text search on a store, and the helpers under them."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import documents as dc
from riskloom.operators import models as md
from riskloom.operators import policy as pl
from riskloom.operators import profiling
from riskloom.operators.assessment import assess_requests, predict_loss
from riskloom.operators.features import feature_steps
from riskloom.functions.text import record_sentence
from riskloom.plans.ranking import dense_numbers
from riskloom.sources import tables
from riskloom.streaming import monitors

FIELDS = ("risk_type", "territory", "industry", "limit", "premium", "broker", "prior_claims", "years_trading")
SCHEMA = "record_id string, risk_type string, territory string, industry string, limit double, premium double, broker string, prior_claims double, years_trading double"


def _request(key, **changed):
    base = dict(risk_type="marine", territory="Asia", industry="Shipping", limit=5e6, premium=2e5, broker="B1", prior_claims=1.0, years_trading=12.0)
    base.update(changed)
    return (key, *[base[f] for f in FIELDS])


def _embed(df):
    return dc.embed_with(df, lambda texts: [[1.0, s.count("a"), s.count("e")] for s in texts])


@pytest.fixture
def search(spark, tmp_path):
    store = dc.DocumentStore(spark, str(tmp_path / "store"), ["doc_id"])
    docs = [(f"D{i}", text) for i, text in enumerate(("aaa", "eee", "marine company in Asia", None))]
    docs = [d for d in docs if d[1]]
    store.update(spark.createDataFrame(docs, "doc_id string, text string"), embed=_embed)
    asked = []

    def run(texts):
        asked.append(sorted(r["text"] for r in texts.collect()))
        return store.search(texts, _embed, 2)

    return run, asked


def _fixed(p):
    def predict(df):
        return df.withColumns(
            {
                "probability_of_loss": F.create_map(*[F.lit(x) for kv in p.items() for x in kv])[F.col("record_id")],
                "is_loss_making_prediction": F.lit(True), "top_features": F.array(F.lit("limit")), "model_warnings": F.array().cast("array<string>"),
            }
        )

    return predict


def test_assess_requests(spark, search):
    run, asked = search
    rows = [_request("sure"), _request("unsure"), _request("holes", industry=None, limit=None), _request("failed"), _request("twin")]
    outcomes = spark.createDataFrame([(f"D{i}", False) for i in range(4)], "record_id string, is_loss_making boolean")
    out = assess_requests(spark.createDataFrame(rows, SCHEMA), _fixed({"sure": 0.95, "unsure": 0.55, "holes": 0.95, "twin": 0.45}), run, outcomes, max_distance=2.0)
    got = {r["record_id"]: r for r in out.collect()}
    assert len(got) == 5 and len(asked) == 1  # equal texts of unsure, failed and twin are searched once
    assert len(asked[0]) == 2
    assert got["sure"]["confidence_level"] == "high" and got["sure"]["tools_used"] == ["predict_loss"]
    assert got["unsure"]["conflict_detected"] and pl.CONFLICT_WARNING in got["unsure"]["warnings"]
    assert "required_field_missing:limit" in got["holes"]["warnings"] and got["holes"]["confidence_level"] == "low"
    assert got["failed"]["warnings"][0] == "Prediction failed: no prediction"
    assert got["failed"]["second_opinion_recommended"] and not got["failed"]["conflict_detected"]
    assert all(got[k]["tools_used"] == ["predict_loss", "retrieve_similar_records"] for k in ("unsure", "holes", "failed", "twin"))


def test_assess_no_requests_and_empty_store(spark, tmp_path):
    store = dc.DocumentStore(spark, str(tmp_path / "none"), ["doc_id"])
    outcomes = spark.createDataFrame([], "record_id string, is_loss_making boolean")
    run = lambda texts: store.search(texts, _embed)
    assert assess_requests(spark.createDataFrame([], SCHEMA), _fixed({"x": 0.5}), run, outcomes).count() == 0
    one = assess_requests(spark.createDataFrame([_request("x")], SCHEMA), _fixed({"x": 0.5}), run, outcomes).first()
    assert one["recommendation"] == pl.RECOMMENDATION and one["evidence"] is None


def test_predict_loss_with_a_fitted_pipeline(spark):
    rows = [_request(f"R{i}", limit=1e6 + 1e5 * (i % 7), prior_claims=float(i % 5), broker=f"B{i % 3}") + (i % 5 / 2.0, i % 5 > 2) for i in range(60)]
    train = spark.createDataFrame(rows, SCHEMA + ", loss_ratio double, is_loss_making boolean")
    steps, x = feature_steps().fit_transform(train)
    features = [c for c in x.columns if c not in ("record_id", "is_loss_making")]
    pool = {"logistic_regression": md.candidate_models("is_loss_making", "__weight")["logistic_regression"]}
    trained = md.train_candidates(x, features, "is_loss_making", "record_id", candidates=pool)
    trained.feature_columns = features
    asked = spark.createDataFrame([_request("n0", prior_claims=4.0), _request("n1", prior_claims=None, industry=None)], SCHEMA)
    got = {r["record_id"]: r for r in predict_loss(asked, steps, trained).collect()}
    assert set(got) == {"n0", "n1"} and all(0 <= r["probability_of_loss"] <= 1 and len(r["top_features"]) == 5 for r in got.values())


def test_numbers_and_inserts_by_text_key(spark):
    df = spark.createDataFrame([(f"REC_{i}", i) for i in range(200)], "k string, v int").repartition(5)
    got = [(r["k"], r["n"]) for r in dense_numbers(df, "k", "n", 1).collect()]
    assert sorted(got) == [(k, i + 1) for i, k in enumerate(sorted(f"REC_{i}" for i in range(200)))]
    assert dense_numbers(df.limit(0), "k", "n").count() == 0
    spark.sql("DROP TABLE IF EXISTS by_text")
    tables.write_table(tables.with_ids(df.where("v < 50"), "k"), "by_text")
    assert tables.bulk_insert(df.where("v >= 50"), "by_text", "k") == (51, 200)
    assert spark.table("by_text").select("id").distinct().count() == 200
    tables.drop_table(spark, "by_text")


def test_permutation_importance_by_text_key(spark):
    rows = [(f"R{i}", float(i % 10), float(i * 7919 % 13), int(i % 10 > 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, x double, noise double, y int")
    pool = {"logistic_regression": md.candidate_models("y", "__weight")["logistic_regression"]}
    trained = md.train_candidates(df, ["x", "noise"], "y", "key", candidates=pool)
    got = {r["feature"]: r["importance"] for r in md.permutation_importance(df, trained, "key").collect()}
    assert got["x"] > 0.2 and abs(got["noise"]) < 0.1


def test_class_counts_have_no_bound(spark):
    df = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("t"), (F.col("id") % 3).cast("string").alias("f"))
    out = profiling.class_counts(df, "t", ["f"])
    assert out.count() == 3000 and out.agg(F.sum("count")).first()[0] == 3000


def test_first_content_keeps_the_earliest_row(spark):
    df = spark.createDataFrame([(1, "2024-01-02", "a b"), (2, "2024-01-01", "A  b!"), (3, "2024-01-01", "a b"), (4, "2024-01-03", None)], "id int, ts string, text string")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["id"] for r in monitors.first_content(df, tie=["id"]).collect()) == [2, 4]


def test_sentence_of_an_empty_record(spark):
    row = _request("x", **{f: None for f in FIELDS})
    text = spark.createDataFrame([row, _request("y", limit=math.nan, premium=math.nan)], SCHEMA).select(record_sentence("Acme", "?").alias("s")).collect()
    assert text[0]["s"].startswith("This is a ? record covering ?, submitted by ? for a an undisclosed industry account ?")
    assert "limit is $? and the quoted premium is $?k" in text[1]["s"]
