"""Searches that hold few doubles, ranks of wanted buckets, areas by bucket."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskloom.operators import evaluation as ev
from riskloom.operators import models as md
from riskloom.operators import similarity as sm
from riskloom.plans import ranking as rk


def test_a_block_is_turned_to_doubles_in_parts(monkeypatch):
    monkeypatch.setattr(sm, "PART_NUMBERS", 65_536, raising=False)
    rng = np.random.default_rng(9)
    m = rng.normal(size=(30_000, 64)).astype(np.float32)
    m[7, 3], m[11] = np.nan, 0.0
    lists = [pa.ListArray.from_arrays(np.arange(0, len(p) * 64 + 1, 64, dtype=np.int32), pa.array(p.ravel())) for p in (m[:20_000], m[20_000:])]
    table = pa.table({"id": np.arange(len(m)), "vector": pa.chunked_array(lists)})
    tracemalloc.start()
    try:
        turned = sm._matrix(table["vector"])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(turned, sm._turned_to_one(m.astype(np.float64)), equal_nan=True)
    assert peak < 1.3 * turned.nbytes
    whole, parts = (sm._Asked(np.arange(500), turned[:500], 4, True) for _ in range(2))
    whole.start()
    whole.meet(np.arange(len(m)), turned)
    parts.start()
    for part in sm._parts(table):
        parts.meet(sm._longs(part["id"]), sm._matrix(part["vector"]))
    assert (whole.best == parts.best).all() and (whole.found == parts.found).all()


def counted(monkeypatch):
    """Names of the columns of every frame that is ranked as a whole."""
    seen, ranked = [], rk._ranked
    monkeypatch.setattr(rk, "_ranked", lambda counts, *rest: (seen.append(counts.columns), ranked(counts, *rest))[1])
    return seen


def test_cuts_and_quantiles_rank_the_wanted_buckets_only(spark, monkeypatch):
    monkeypatch.setattr(rk, "SMALL_ROWS", 50)
    seen = counted(monkeypatch)
    rng = np.random.default_rng(10)
    values = {i: (i % 2, float(rng.integers(0, 300)) if i % 3 else 7.0, None if i % 11 == 0 else float(rng.normal())) for i in range(900)}
    df = spark.createDataFrame([(i, *v) for i, v in values.items()], "id long, g int, x double, z double")
    got = {(r["g"], r["feature"]): [r["q0"], r["q1"], r["q2"]] for r in rk.quantiles(df, ["x", "z"], [0.0, 0.37, 1.0], ["g"]).collect()}
    for g in (0, 1):
        for place, name in ((1, "x"), (2, "z")):
            known = [v[place] for v in values.values() if v[0] == g and v[place] is not None]
            assert np.allclose(got[g, name], np.quantile(known, [0.0, 0.37, 1.0]), rtol=0, atol=1e-12)
    flagged = rk.first_rows_flag(df, ["x", "id"], lambda total: F.floor(total * 0.3).cast("long"), ["g"])
    for g in (0, 1):
        mine = sorted((v[1], i) for i, v in values.items() if v[0] == g)
        want = {i for _, i in mine[: int(len(mine) * 0.3)]}
        assert {r["id"] for r in flagged.where(f"g = {g} AND __first").select("id").collect()} == want
    assert not seen


def test_areas_are_added_up_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(rk, "SMALL_ROWS", 20)
    seen = counted(monkeypatch)
    rng = np.random.default_rng(11)
    rows = [(i % 2, int(rng.integers(0, 2)) if i % 50 else None, float(rng.integers(0, 90)) if i % 7 else None) for i in range(800)]
    df = spark.createDataFrame([*rows, (2, 1, 3.0)], "g int, y int, s double")
    got = {r["g"]: r["auc"] for r in ev.roc_auc(df, "y", "s", ["g"]).collect()}
    for g in (0, 1):
        pos = np.array([s for h, y, s in rows if h == g and y == 1 and s is not None])
        neg = np.array([s for h, y, s in rows if h == g and y == 0 and s is not None])
        assert got[g] == ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert got[2] is None and not seen
    assert ev.roc_auc(df.where("s IS NULL"), "y", "s").first()["auc"] is None
    even = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 7 % 400 + 0.5).alias("s"))
    hot = even.withColumn("s", F.when(F.col("s") < 250, F.lit(7.0)).otherwise(F.col("s")))
    shuffles = [ev.roc_auc(x, "y", "s", ["g"])._jdf.queryExecution().executedPlan().toString().count("Exchange hash") for x in (even, hot)]
    assert shuffles == [2, 3]  # rows, sums of buckets; with hot values their counts before
    pairs = [(p, n) for p in even.where("g = 0 AND y = 1").collect() for n in even.where("g = 0 AND y = 0").collect()]
    assert ev.roc_auc(even, "y", "s", ["g"]).where("g = 0").first()["auc"] == sum(p["s"] > n["s"] for p, n in pairs) / len(pairs)


def test_a_model_predicts_once_for_an_area(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counted:
        def transform(self, df):
            def score(a):
                calls.add(1)
                return [1.0 - a, a]

            return df.withColumn("probability", array_to_vector(F.udf(score, "array<double>")("a")))

    df = spark.createDataFrame([(i % 2, (i * 7 % 101) / 101) for i in range(200)], "y int, a double").repartition(2)
    assert 0.3 < md._auc(Counted(), df, "y") < 0.7
    assert calls.value == 200
