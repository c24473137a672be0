import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.plans import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold more than a third of the rows."""
    rng = random.Random(7)
    data = [(i, "hot" if i % 2 else f"g{i % 5}", 3.0 if i % 3 == 0 else round(rng.uniform(-50, 50), 2)) for i in range(3000)]
    return spark.createDataFrame(data, "k long, g string, v double"), pd.DataFrame(data, columns=["k", "g", "v"])


@pytest.mark.parametrize("buckets", [None, 2, 7])
def test_ranks_with_and_without_buckets(skewed, buckets):
    df, pdf = skewed
    got = rk.value_ranks(df, "v", ["g"], buckets=buckets).toPandas().set_index(["g", "value"]).sort_index()
    for g, part in pdf.groupby("g"):
        for v, n in part["v"].value_counts().items():
            row = got.loc[(g, v)]
            assert (row["n"], row["before_n"], row["total_n"]) == (n, (part["v"] < v).sum(), len(part))


@pytest.mark.parametrize("buckets", [None, 5])
def test_quantiles_match_pandas(skewed, buckets, monkeypatch):
    df, pdf = skewed
    if buckets:
        monkeypatch.setattr(rk, "SMALL_ROWS", 0)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in rk.quantiles(df, ["v"], probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        want = part["v"].quantile(probs).tolist()
        assert np.allclose([got[g][f"q{i}"] for i in range(len(probs))], want)


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert rk.medians(df, ["v"]) == {"v": 2.0}


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert rk.medians(df, ["v"]) == {"v": None}


def test_first_rows_break_ties_by_the_next_column(skewed):
    df, pdf = skewed
    got = rk.first_rows_flag(df, ["v", "k"], lambda n: F.floor(n * 0.4).cast("long"), ["g"]).where("__first").select("k").toPandas()["k"]
    want = set()
    for _, part in pdf.groupby("g"):
        want |= set(part.sort_values(["v", "k"]).head(int(len(part) * 0.4))["k"])
    assert set(got) == want and len(got) == len(want)


def test_first_rows_without_groups(skewed):
    df, pdf = skewed
    got = set(rk.first_rows_flag(df, ["v", "k"], lambda n: F.lit(1234)).where("__first").toPandas()["k"])
    assert got == set(pdf.sort_values(["v", "k"]).head(1234)["k"])


def test_dense_numbers(spark, monkeypatch):
    monkeypatch.setattr(rk, "SMALL_ROWS", 0)
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k")
    got = rk.dense_numbers(df, "k", "n", 10).orderBy("k").toPandas()
    assert got["n"].tolist() == list(range(10, 10 + len(got)))
