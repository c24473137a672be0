"""Rows that used to get lost: repeated and missing order values, missing ids, scores and texts, NaN, folders."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import clusters, documents, evaluation, profiling, similarity, splits
from riskloom.operators.selection import LassoSelector
from riskloom.sources import tables
from riskloom.streaming import runs


def test_last_per_key_with_repeated_and_missing_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", None, "w"), (None, 1, "n"), ("b", 1, "z")], "k string, o int, v string")
    got = sorted(map(tuple, tables.last_per_key(df, ["k"], "o").collect()), key=str)
    assert got == sorted([("a", 2, "y"), ("b", 1, "z"), ("c", None, "w"), (None, 1, "n")], key=str)
    target = spark.createDataFrame([("a", "old"), ("d", "kept")], "k string, v string")
    out = {tuple(r) for r in tables.upsert(target, df.where("k is not null"), ["k"], "o").collect()}
    assert out == {("a", "y"), ("b", "z"), ("c", "w"), ("d", "kept")}


def test_group_split_keeps_rows_without_identifier(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 20).alias("g"))
    train, test = splits.group_split(df, "g")
    assert train.count() + test.count() == 100
    assert train.where("g is null").count() == 20 and train.join(test, "g").count() == 0


def test_lasso_refuses_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 1.0), (3, math.nan, 0.0)], "record_id int, x double, TARGET double")
    with pytest.raises(ValueError, match="TARGET"):
        LassoSelector().fit(df)


def test_top_k_honours_k_and_skips_zero_vectors(spark):
    df = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(1, 30)] + [(0, [0.0, 0.0])], "id int, embedding array<double>")
    assert similarity.cosine_top_k(df.where("id = 1"), df, 20).count() == 20
    exact = sorted(map(tuple, similarity.cosine_top_k(df, df, 12).collect()))
    assert sorted(map(tuple, similarity.cosine_top_k_approximate(df, df, 12, cells=3, probes=3).collect())) == exact


def test_coincident_centres(spark):
    df = clusters.as_vectors(spark.createDataFrame([(0, [0.0]), (0, [2.0]), (1, [1.0]), (2, [9.0])], "c int, x array<double>"), "x", "f")
    assert math.isfinite(clusters.davies_bouldin(df, "f", "c"))


def test_unscored_rows_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, math.nan)], "y int, p double")
    r = evaluation._counts(df, "y", "p", [0.5]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 0, 1)


def test_null_text_is_known_after_the_first_update(spark):
    batch = spark.createDataFrame([(1, 0, None), (2, 0, "a"), (3, 0, None)], "doc_id int, chunk_no int, text string")
    store = documents.new_documents(batch, None)
    assert documents.new_documents(batch, store).count() == 0


def test_nan_does_not_move_the_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(math.nan,), (None,)], "x double")
    assert profiling._ranges(df, ["x"]) == {"x": (0.0, 9.0)}


def test_stream_of_a_folder_and_of_a_file(spark, tmp_path):
    for name, parts in (("folder.parquet", 2), ("one", 1)):
        spark.range(10).repartition(parts).write.parquet(str(tmp_path / name))
    file = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
    for n, path in enumerate((tmp_path / "folder.parquet", tmp_path / "one" / file)):
        stream = runs.table_stream(spark, str(path), spark.range(1).schema)
        assert runs.append_to(stream, str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}")).count() == 10


def test_correlations_of_pairwise_complete_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) + 1e6
    x[:, 1] += 0.7 * (x[:, 0] - 1e6)
    x[:, 3] = 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd"))
    cells = [[None] * 4 if i == 5 else row for i, row in enumerate(x.tolist())]
    df = spark.createDataFrame([tuple(row) for row in cells], "a double, b double, c double, d double")
    got = {(r.row_feature, r.column_feature): r.correlation for r in profiling.correlation_matrix(df).collect()}
    want = pdf.corr()
    assert len(got) == 16
    for (a, b), value in got.items():
        if "d" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(want.loc[a, b], abs=1e-9)
    assert all(r.correlation is None for r in profiling.correlation_matrix(df.limit(0)).collect())
