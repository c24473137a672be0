"""Similarity index, early stopping, given models, silhouettes, ordered chunks, closed windows and open scores."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import clusters as km
from riskloom.operators import models as md
from riskloom.operators import similarity as sm
from riskloom.sources import tables as tb
from riskloom.streaming import monitors as mo
from riskloom.streaming import runs as rn


def vectors(spark, n=900, d=8, seed=4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.4) for c in centres[i % 12]]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, [0.0] * d), (n + 1, None)], "id long, embedding array<double>")


def test_index_reaches_recall_on_other_queries_and_grows(spark, tmp_path):
    base = vectors(spark)
    index = sm.CosineIndex.build(base.where("id % 3 < 2"), str(tmp_path / "i"))
    assert index.recall >= sm.TARGET_RECALL and 0 < index.probes < index.cells
    index.add(base.where("id % 3 = 2"))
    again = sm.CosineIndex(spark, str(tmp_path / "i"))
    again.calibrate()
    assert again.rows.read().count() == 900 and again.probes == sm.CosineIndex(spark, str(tmp_path / "i")).probes
    queries = base.where("id % 50 = 7")
    exact = sm.cosine_top_k(queries, base, 10, skip_same=True)
    assert sm.recall(again.search(queries, 10, skip_same=True), exact).first()["recall"] >= 0.9
    whole = again.search(queries, 10, probes=again.cells, skip_same=True)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))
    plan = again.rows.read().where(F.col("cell").isin([0, 1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:120]


def test_index_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError):
        sm.CosineIndex.build(vectors(spark).where("id >= 900"), str(tmp_path / "i"))
    assert sm.cosine_top_k_approximate(vectors(spark).limit(3), vectors(spark).where("id >= 900")).count() == 0


def labelled(spark, noise):
    rnd = random.Random(1)
    rows = [(i, x := rnd.random(), rnd.random(), int((rnd.random() if rnd.random() < noise else x) > 0.5), 1.0) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int, w double")


def test_boosting_stops_early_and_alike(spark):
    df = labelled(spark, 0.0)
    trees = GBTClassifier(featuresCol=md.FEATURES, labelCol="y", weightCol="w", maxIter=20, stepSize=0.8, maxDepth=2, seed=3)
    model, rounds = md.fit_boosted(df, ["a", "b"], trees, "id")
    assert 1 <= rounds < 20 and model.stages[-1].getNumTrees == rounds
    assert md.fit_boosted(df, ["a", "b"], trees, "id")[1] == rounds
    trained = md.train_candidates(df, ["a", "b"], "y", "id", candidates={"boosted_trees": trees.copy({trees.weightCol: "__weight"})})
    assert trained.model.stages[-1].getNumTrees == trained.scores[0]["rounds"] < 20 and trained.scores[0]["val_auc"] > 0.98
    assert trees.getMaxIter() == 20


def test_given_model_scores_ranks_and_is_saved(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 0.5)], "a double, b double")
    given = md.given_model({"a": 2.0, "b": -3.0}, 0.25, "y")
    want = [round(1 / (1 + math.exp(-(2 * a - 3 * b + 0.25))), 4) for a, b in ((1.0, 2.0), (-1.0, 0.5))]
    assert [r["probability_of_loss"] for r in md.score(df, given).collect()] == want
    assert md.top_features(given, 1) == [("b", 3.0)]
    given.save(str(tmp_path / "m"))
    assert [r["probability_of_loss"] for r in md.score(df, md.TrainedModel.load(str(tmp_path / "m"))).collect()] == want


def test_euclidean_silhouette_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(km, "SILHOUETTE_BLOCK", 16)
    rnd = random.Random(2)
    rows = [([rnd.gauss(i % 3, 1), rnd.gauss(0, 1)], i % 3) for i in range(90)] + [([9.0, 9.0], 7), ([0.0, 0.0], 1), ([0.0, 0.0], 1)]

    def mean(values):
        return sum(values) / len(values)

    total = 0.0
    for i, (x, c) in enumerate(rows):
        by = {k: [math.dist(x, y) for j, (y, d) in enumerate(rows) if d == k and j != i] for k in {d for _, d in rows}}
        if by[c]:
            a, b = mean(by[c]), min(mean(v) for k, v in by.items() if k != c)
            total += (b - a) / max(a, b)
    df = spark.createDataFrame(rows, "v array<double>, c int").withColumn("f", array_to_vector("v"))
    assert abs(km.euclidean_silhouette(df, "f", "c") - total / len(rows)) < 1e-9
    assert -1 <= km.euclidean_silhouette(df, "f", "c", most_rows=40) <= 1
    assert km.cluster_scores(df, "f", 2, 3, "silhouette_euclidean").where("best").count() == 1
    with pytest.raises(ValueError):
        km.euclidean_silhouette(df.where("c = 7"), "f", "c")


def test_chunks_of_any_key(spark):
    rows = [(None if i % 40 == 0 else f"k{i // 3:03d}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int")
    out = sorted((r["place"], r["chunk"], r["k"]) for r in tb.ordered_chunks(df, "k", 30, ["v"]).collect() if r["k"] is not None)
    assert [k for *_, k in out] == sorted(k for k, _ in rows if k is not None)
    assert Counter(r["chunk"] for r in tb.ordered_chunks(df, "k", 30).collect()) == Counter({i: 30 for i in range(6)} | {6: 20})
    hot = spark.createDataFrame([(float(i), 1) for i in range(50)] + [(7.0, 2)] * 100 + [(None, 3)], "k double, v int")
    bounds = tb.chunk_bounds(hot, "k", 20)
    told = [hot.where(p).count() for p in tb.range_predicates(bounds, "k")]
    assert sum(told) == 151 and max(told) >= 100 and [r["chunk"] for r in bounds.orderBy("chunk").collect()] == list(range(len(told)))
    with pytest.raises(ValueError):
        tb.ordered_chunks(df, "k", 0)


def arrive(spark, tmp_path, parts, monitor, name):
    """The stream of `parts`, one after another on one checkpoint."""
    schema = "ts timestamp, second_opinion_recommended boolean"
    for part in parts:
        df = spark.createDataFrame([(s, e) for s, e in part], "s long, e boolean").select(F.timestamp_seconds("s").alias("ts"), F.col("e").alias("second_opinion_recommended"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = rn.file_stream(spark, str(tmp_path / name / "in"), spark.createDataFrame([], schema).schema)
        out = rn.append_to(monitor(stream), str(tmp_path / name / "out"), str(tmp_path / name / "check"))
    return out


def test_closed_windows_and_late_rows_add_up(spark, tmp_path):
    t0, hour = 1_700_002_800, 3600  # a full hour
    parts = [
        [(t0 + i * 600, i % 2 == 0) for i in range(12)],
        [(t0 + 4 * hour + i * 600, True) for i in range(6)] + [(t0 + 60, True), (t0 + hour + 60, False), (t0 + 4 * hour - 60, True)],
        [(t0 + 9 * hour, False), (t0 + 30, True), (t0 + 4 * hour + 45, False)],
    ]
    halts = arrive(spark, tmp_path, parts, lambda df: mo.halt_signals(df, threshold=-1.0, size="1 hour", slide="1 hour", delay="10 minutes"), "halts")
    late = arrive(spark, tmp_path, parts, lambda df: mo.late_rows(df.select("ts"), size="1 hour", slide="1 hour", delay="10 minutes"), "late")
    want, missed, mark = Counter(), Counter(), 0
    for part in parts:
        for s, _ in part:
            start = s // hour * hour
            (missed if start + hour <= mark else want)[start] += 1
        mark = max(mark, max(s for s, _ in part) - 600)
    closed = {k: v for k, v in want.items() if k + hour <= mark}
    got = {r["s"]: r["assessments"] for r in halts.select(F.unix_seconds("window_start").alias("s"), "assessments").collect()}
    assert got == closed and halts.count() == len(closed)  # each window once
    told = late.groupBy(F.unix_seconds("window_start").alias("s")).agg(F.sum("late").alias("n")).collect()
    assert {r["s"]: r["n"] for r in told} == missed and missed


def test_open_scores_are_emitted_once_their_bound_has_passed(spark, tmp_path, rows):
    t0, day = 1_700_000_000, 86_400
    scores = spark.range(40).select(
        F.col("id").alias("record_id"), F.timestamp_seconds(t0 + F.col("id") * 600).alias("ts"), F.lit("high").alias("confidence_level"), (F.col("id") % 2 == 0).alias("is_loss_making_prediction")
    )
    outcomes = scores.where("record_id % 4 = 0").select("record_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("outcome_ts"), F.lit(True).alias("is_loss_making"))
    beat = scores.limit(1).select(F.lit(-1).cast("long").alias("record_id"), F.timestamp_seconds(F.lit(t0 + 9 * day)).alias("ts"), F.lit("low").alias("confidence_level"), F.lit(True).alias("is_loss_making_prediction"))
    end = outcomes.limit(1).select(F.lit(-2).cast("long").alias("record_id"), F.timestamp_seconds(F.lit(t0 + 9 * day)).alias("outcome_ts"), F.lit(True).alias("is_loss_making"))
    for name, df in (("scores", scores.unionByName(beat)), ("outcomes", outcomes.unionByName(end))):
        df.write.parquet(str(tmp_path / name))
    streams = [rn.file_stream(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema) for n in ("scores", "outcomes")]
    out = rn.append_to(mo.matched_outcomes(*streams, within="2 DAYS", keep_open=True), str(tmp_path / "o"), str(tmp_path / "c"))
    got = mo.calibration_with_open(out)
    want = mo.calibration_with_open(mo.matched_outcomes(scores, outcomes, within="2 DAYS", keep_open=True))
    assert rows(got) == rows(want) == [("high", 10, 10, 30, 1.0)]


def test_only_sessions_of_one_process_get_a_temporary_folder():
    from types import SimpleNamespace

    from riskloom.session import shared_folder

    def session(master):
        made = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        return SimpleNamespace(conf={}, sparkContext=context), made

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            shared_folder(session(master)[0], "tables")
    for master in ("local", "local[4]", "local[*]"):
        one, made = session(master)
        assert shared_folder(one, "tables") == f"{made[0]}/tables"
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/"}, sparkContext=None)
    assert shared_folder(named, "tables", "x") == "/shared/tables/x"
