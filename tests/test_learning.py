import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import clusters as km
from riskloom.operators import evaluation as ev
from riskloom.operators import models as md
from riskloom.operators import selection as fs
from riskloom.operators import splits as sp


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    data = [(i, round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(700)]
    return spark.createDataFrame(data, "k long, score double, y int"), pd.DataFrame(data, columns=["k", "score", "y"])


def test_auc_is_the_pair_count(scored):
    df, pdf = scored
    pos, neg = pdf[pdf["y"] == 1]["score"].to_numpy(), pdf[pdf["y"] == 0]["score"].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert ev.roc_auc(df, "y", "score").first()["auc"] == pytest.approx(want)


def test_sweep_and_confusion(scored):
    df, pdf = scored
    sweep = {r["classification_threshold"]: r for r in ev.threshold_sweep(df, "y", "score", [0.5, 2.0]).collect()}
    flag = pdf["score"] > 0.5
    assert sweep[0.5]["accuracy"] == round((flag == (pdf["y"] == 1)).mean() * 100, 2)
    assert sweep[2.0]["precision"] == 0.0 and sweep[2.0]["mcc"] == 0.0 and sweep[2.0]["recall"] == 0.0
    assert ev.confusion_table(df, "y", "score", [0.5]).first()["predicted_positives"] == flag.sum()


def test_threshold_for_risk(scored):
    df, pdf = scored
    n, pos = len(pdf), pdf["y"].sum()
    need = round(n * 0.1) / n
    want = max(s for s in pdf["score"].unique() if ((pdf["score"] >= s) & (pdf["y"] == 1)).sum() / pos >= need)
    assert ev.threshold_for_risk(df, "y", "score", 0.1).first()["threshold"] == want
    low = ev.threshold_for_risk(df, "y", "score", 0.1, "flagged").first()["threshold"]
    assert (pdf["score"] >= low).mean() <= 0.1


def test_group_split_is_disjoint_and_exact(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"))
    train, test = sp.group_split(df, "g", 0.3)
    a, b = {r["g"] for r in train.collect()}, {r["g"] for r in test.collect()}
    assert not a & b and len(b) == -(-len(a | b) * 3 // 10) and train.count() + test.count() == 1000


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    one = {r["id"] for r in sp.random_split(df, "id", 0.3)[1].collect()}
    two = {r["id"] for r in sp.random_split(df.repartition(7), "id", 0.3)[1].collect()}
    assert one == two and len(one) == 150
    train, val, test = sp.train_val_test_split(df, "id", 0.1, 0.1)
    assert (test.count(), val.count(), train.count()) == (50, 50, 400)


def test_ordered_split(spark):
    df = spark.range(10).select("id", F.expr("timestamp_seconds((id div 4) * 100)").alias("ts"))
    train, test = sp.ordered_split(df, ["ts", "id"], 0.3)
    assert sorted(r["id"] for r in test.collect()) == [7, 8, 9] and train.count() == 7
    assert sorted(r["id"] for r in sp.date_split(df, ["ts", "id"], 0.55)[0].collect()) == [0, 1, 2, 3, 4]


def test_cardinality(spark):
    df = spark.createDataFrame([(i, 1, f"c{i % 30}", None) for i in range(100)], "k int, one int, c string, gone string")
    assert fs.CardinalityFilter().fit(df).transform(df).columns == ["c", "gone"]
    low = fs.LowerCardinality(max_categories=3).fit(df).transform(df)
    assert low.select("c").distinct().count() == 4
    assert low.where("gone IS NOT NULL").count() == 0


def test_stability_drops_the_shifted_column(spark):
    train = spark.range(2000).select(F.col("id").alias("record_id"), (F.col("id") % 97).cast("double").alias("same"), (F.col("id") % 50).cast("double").alias("moved"))
    test = spark.range(5000, 6000).select(F.col("id").alias("record_id"), (F.col("id") % 97).cast("double").alias("same"), (F.col("id") % 50 + 60).cast("double").alias("moved"))
    assert fs.StabilityFilter().fit((train, test)).fitted("drop") == ["moved"]


def test_lasso_keeps_what_matters(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4)) + 1e6
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(scale=0.1, size=800)
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "record_id long, a double, b double, c double, d double, TARGET double")
    model = fs.LassoSelector(alphas=[0.2]).fit(df)
    assert model.fitted("kept") == ["a", "b"]
    assert model.fitted("weights")["a"] == pytest.approx(3 * x[:, 0].std() - 0.2, abs=0.05)
    assert model.transform(df).columns == ["record_id", "TARGET", "a", "b"]
    auto = fs.LassoSelector().fit(df)
    assert {"a", "b"} <= set(auto.fitted("kept")) and auto.fitted("alpha") < 0.2


def test_shuffled_partner_is_a_bijection(spark):
    df = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"))
    out = md.shuffled_partner(df, "k", ["x"]).toPandas()
    assert sorted(out["__other_x"]) == sorted(out["x"]) and (out["x"] == out["__other_x"]).mean() < 0.1


def test_train_score_and_reload(spark, tmp_path):
    df = spark.range(600).select(
        F.col("id").alias("record_id"), (F.col("id") % 10).cast("double").alias("a"), ((F.col("id") * 7) % 13).cast("double").alias("b"),
        (F.col("id") % 10 > 5).alias("y"),
    )
    pool = {"logistic_regression": md.candidate_models("y", "__weight")["logistic_regression"]}
    trained = md.train_candidates(df, ["a", "b"], "y", "record_id", candidates=pool)
    assert trained.scores[0]["val_auc"] > 0.99 and md.top_features(trained, 1)[0][0] == "a"
    trained.save(str(tmp_path / "m"))
    again = md.TrainedModel.load(str(tmp_path / "m"))
    a, b = (md.score(df, m).orderBy("record_id").select("probability_of_loss").collect() for m in (trained, again))
    assert a == b and again.feature_columns == ["a", "b"]
    shifts = {r["feature"]: r["importance"] for r in md.permutation_importance(df, trained, "record_id").collect()}
    assert shifts["a"] > 0.2 > abs(shifts["b"])


def test_cluster_count(spark):
    rng = np.random.default_rng(4)
    points = [(rng.normal(loc=c, scale=0.2, size=2).tolist(),) for c in (0, 10, 20) for _ in range(40)]
    df = km.as_vectors(spark.createDataFrame(points, "v array<double>"), "v")
    assert km.find_optimal_clusters_db(df, "features", 2, 4) == 3
    assert km.find_optimal_clusters_silhouette(df, "features", 2, 4) == 3
