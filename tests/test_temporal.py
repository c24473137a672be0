import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import temporal as tm

START = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


@pytest.fixture(scope="module")
def events(spark):
    """A hot entity with two thirds of the rows, ties, exact window ends and missing values."""
    rng = random.Random(3)
    data = []
    for i in range(900):
        entity = "hot" if i % 3 else f"e{i % 7}"
        when = START + DAY * rng.choice([0, 1, 2, 7, 8, 30]) + dt.timedelta(seconds=rng.choice([0, 0, 1, 3600, rng.randrange(86400)]))
        data.append((i, entity, when, None if i % 11 == 0 else float(rng.randrange(100)), i % 2))
    data.append((900, None, START, 1.0, 1))
    schema = "k int, entity string, ts timestamp, value double, target int"
    return spark.createDataFrame(data, schema), pd.DataFrame(data, columns=["k", "entity", "ts", "value", "target"])


def window(pdf, row, days, grace=None):
    same = pdf[pdf["entity"] == row["entity"]]
    start = row["ts"] - DAY * days
    if grace is None:
        return same[(same["ts"] >= start) & (same["ts"] <= row["ts"])]
    return same[(same["ts"] > start) & (same["ts"] <= row["ts"] - DAY * grace)]


@pytest.mark.parametrize("days", [1, 7])
def test_rolling_matches_brute_force(events, days):
    df, pdf = events
    got = tm.RollingFeatures("ts").fit(df, "entity", "value", days).toPandas().set_index("k")
    assert len(got) == len(pdf)
    for _, row in pdf.iterrows():
        out = got.loc[row["k"]]
        if row["entity"] is None:
            assert pd.isna(out[f"count_entity_{days}d"])
            continue
        part = window(pdf, row, days)
        assert out[f"count_entity_{days}d"] == len(part)
        values = part["value"].dropna()
        if len(values):
            assert out[f"sum_entity_{days}"] == pytest.approx(values.sum())
            assert out[f"mean_entity_{days}d"] == pytest.approx(values.mean())
        else:
            assert pd.isna(out[f"sum_entity_{days}"])


def test_grace_window_matches_brute_force(events):
    df, pdf = events
    got = tm.rolling_with_grace(df, "ts", "target", ["entity"], [1, 7], delta=8).toPandas().set_index("k")
    for _, row in pdf.iterrows():
        if row["entity"] is not None:
            for grace in (1, 7):
                assert got.loc[row["k"], f"bad_entity_{grace}d"] == window(pdf, row, 8, grace)["target"].sum()


def test_first_of_ties(spark):
    data = [(1, "a", START, 1.0), (2, "a", START, 2.0), (3, "a", START + DAY, 4.0)]
    df = spark.createDataFrame(data, "k int, entity string, ts timestamp, value double")
    out = tm.RollingFeatures("ts", ties="first", order_col="k").fit(df, "entity", "value", 2).orderBy("k").collect()
    assert [(r["count_entity_2d"], r["sum_entity_2"]) for r in out] == [(1, 1.0), (1, 1.0), (3, 7.0)]


def test_rolling_target_names(events):
    df, _ = events
    assert "bad_entity" in tm.rolling_target(df, "ts", "target", ["entity"], 3).columns


def test_time_features(spark):
    df = spark.sql("SELECT timestamp'2024-02-05 18:30:00' AS t")
    r = tm.time_features(df, ["t"]).first()
    assert (r["t__hour_of_day"], r["t__day_of_week"], r["t__week_of_year"], r["t__month_of_year"]) == (18, 0, 6, 2)
    assert tm.time_of_day(df, "t").first()["time_of_day_t"] == "night"


def test_age(spark):
    df = spark.sql("SELECT timestamp'2000-06-02' AS born, timestamp'2024-06-01' AS at")
    r = df.select(tm.age_in_years("born", "at", calendar=True).alias("c"), tm.age_in_years(F.col("born"), F.col("at")).alias("m")).first()
    assert (r["c"], r["m"]) == (23, 23)


def test_bad_arguments():
    with pytest.raises(ValueError):
        tm.RollingFeatures("ts", ties="first")
    with pytest.raises(ValueError):
        tm.RollingWithGrace("ts", grace=200, delta=150)
