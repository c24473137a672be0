import pytest
from pyspark.sql import functions as F

from riskloom.operators import policy as pl
from riskloom.operators import usage as us

CASES = [
    (0.85, [], [], "high"), (0.15, [], [], "high"), (0.80, [], [], "high"),
    (0.68, [], [], "medium"), (0.65, [], [], "medium"), (0.52, [], [], "low"),
    (0.68, ["optional_field_missing:broker"], [], "low"), (0.85, ["optional_field_missing:broker"], [], "medium"),
    (0.85, ["required_field_missing:limit"], [], "low"), (0.85, ["invalid_value:limit_nonpositive"], [], "low"),
    (0.85, [], ["feature_missing_after_transform:some_col"], "low"), (0.85, None, None, "high"),
]


def test_confidence_bands(spark):
    df = spark.createDataFrame([(i, p, f, w) for i, (p, f, w, _) in enumerate(CASES)], "i int, p double, f array<string>, w array<string>")
    out = df.select("i", pl.confidence_level(F.col("p"), F.col("f"), F.col("w")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in out] == [c for *_, c in CASES]


def test_labels_gate_and_escalation(spark):
    r = spark.range(1).select(
        pl.risk_label(F.lit(True), F.lit("low")).alias("a"), pl.risk_label(F.lit(True), F.lit("high")).alias("b"),
        pl.risk_label(F.lit(False), F.lit("medium")).alias("c"), pl.should_retrieve(F.lit("high"), F.lit(True)).alias("d"),
        pl.should_retrieve(F.lit("medium"), F.lit(False)).alias("e"), pl.should_escalate(F.lit("high"), F.lit(True)).alias("f"),
        pl.should_escalate(F.lit("high"), F.lit(False)).alias("g"),
    ).first()
    assert tuple(r) == ("unclear", "likely_loss", "unlikely_loss", True, False, True, False)


@pytest.mark.parametrize(
    "hits, outcomes, conflict",
    [
        ([("a", 0.1), ("b", 0.2), ("c", 0.3)], {"a": True, "b": True, "c": False}, False),
        ([("a", 0.1), ("b", 0.2), ("c", 0.3)], {"a": True, "b": False, "c": False}, True),
        ([("a", 0.6), ("b", 0.7)], {"a": False, "b": False}, False),
        ([("a", 0.1), ("b", 0.5)], {"a": True, "b": False}, True),
        ([("a", 0.1), ("x", 0.1)], {"a": True}, False),
        ([("x", 0.1)], {"a": False}, False),
    ],
)
def test_conflict(spark, hits, outcomes, conflict):
    h = spark.createDataFrame([("q", i, d) for i, d in hits], "query_id string, id string, distance double")
    o = spark.createDataFrame(list(outcomes.items()), "record_id string, is_loss_making boolean")
    q = spark.createDataFrame([("q", True)], "query_id string, pred boolean").join(pl.neighbour_votes(h, o), "query_id", "left")
    assert q.select(pl.conflict_detected(F.col("pred"), F.col("majority_loss"))).first()[0] is conflict


def test_assessment(spark):
    schema = "record_id string, probability_of_loss double, is_loss_making_prediction boolean, top_features array<string>, input_quality_flags array<string>, model_warnings array<string>, prediction_error string, retrieval_error string"
    scored = spark.createDataFrame(
        [
            ("sure", 0.9, True, ["f"], [], [], None, None),
            ("weak", 0.52, True, ["f"], ["optional_field_missing:broker"], [], None, None),
            ("fail", None, None, None, None, None, "boom", None),
            ("offline", 0.5, False, ["f"], [], [], None, "no store"),
        ],
        schema,
    )
    hits = spark.createDataFrame([("sure", "n1", 0.1, 1), ("weak", "n1", 0.1, 1), ("weak", "n2", 0.2, 2)], "query_id string, id string, distance double, rank int")
    outcomes = spark.createDataFrame([("n1", False), ("n2", False)], "record_id string, is_loss_making boolean")
    out = {r["record_id"]: r for r in pl.assess(scored, hits, outcomes).collect()}
    assert out["sure"]["tools_used"] == ["predict_loss"] and not out["sure"]["second_opinion_recommended"]
    assert out["sure"]["risk_assessment"] == "likely_loss" and out["sure"]["recommendation"] is None
    assert out["weak"]["warnings"] == ["optional_field_missing:broker", pl.CONFLICT_WARNING]
    assert out["weak"]["evidence"].count("record_id") == 2 and out["weak"]["recommendation"] is None
    assert out["fail"]["warnings"] == ["Prediction failed: boom"] and out["fail"]["recommendation"] == pl.RECOMMENDATION
    assert out["fail"]["summary"] == "Model confidence is low. Issues: Prediction failed: boom."
    assert out["offline"]["tools_used"] == ["predict_loss"] and out["offline"]["warnings"] == ["Retrieval failed: no store"]


def test_verdict(spark):
    df = spark.createDataFrame([(True, True), (True, False), (None, True)], "a boolean, c boolean")
    assert [r[0] for r in df.select(pl.verdict(F.col("a"), F.col("c"))).collect()] == [True, False, False]


BODIES = [
    '{"usage":{"input_tokens":1000000,"output_tokens":500000},"output":[{"type":"web_search_call"},{"type":"message","content":[{"type":"file_search_call"}]}]}',
    '{"usage":{"prompt_tokens":10,"completion_tokens":5},"tool_calls":[{"name":"x"},{"type":"y_call"},{"type":"z"}]}',
    '{"id":"none"}',
]


def test_usage(spark):
    df = spark.createDataFrame([(i, "gpt-5-mini-2025-08-07", b) for i, b in enumerate(BODIES)], "i int, model string, body string")
    a, b, c = us.with_usage(df, "body").orderBy("i").collect()
    assert (a["input_tokens"], a["output_tokens"], a["total_tokens"]) == (1_000_000, 500_000, 1_500_000)
    assert a["token_cost_usd"] == 1.25 and a["tool_calls"] == {"web_search": 1, "file_search": 1} and a["tool_cost_usd"] == 0.0125
    assert b["total_tokens"] == 15 and b["tool_calls"] == {"x": 1, "y": 1}
    assert c["input_tokens"] is None and c["token_cost_usd"] is None and c["cost_usd"] == 0.0
    first = us.with_usage(df, "body", compat=True).orderBy("i").first()
    assert first["token_cost_usd"] == 6.25


def test_batch_cost(spark):
    df = spark.createDataFrame([(200, BODIES[0]), (500, BODIES[0]), (200, "broken")], "status_code int, body string")
    r = us.batch_cost(df, "gpt-5-mini", discount=0.5).first()
    assert (r["total_tokens"], r["token_cost_usd"], r["tool_cost_usd"], r["tool_calls"]) == (1_500_000, 0.625, 0.0125, 2)
