"""Searches that pass over far leaves, hits gathered by text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import clusters as km
from riskloom.operators import documents as dc
from riskloom.operators import policy as pl
from riskloom.operators import similarity as sm
from riskloom.sources import files as fl


def near_rows(q, base, k):
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    distance = np.round(1.0 - unit(q) @ unit(base).T, 9)
    order = np.lexsort((np.tile(np.arange(len(base)), (len(q), 1)), distance), axis=1)[:, :k]
    return order, np.take_along_axis(distance, order, axis=1)


def test_a_task_gives_k_rows_a_query_however_many_batches_it_reads(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(400)], "id long, vector array<double>")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 10)
    try:
        found = sm._by_broadcast(df.where("id < 20").withColumnRenamed("id", "query_id"), df, 3, False)
        assert found.count() <= 20 * 3 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset(batch)


def test_far_leaves_are_passed_over_and_nothing_is_lost(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(1, 60, size=(20_000, 3)).astype(float)
    base[::5] = [3.0, 4.0, 5.0]  # many copies
    q, seen, compare = rng.integers(1, 60, size=(600, 3)).astype(float), [], sm._Base._compare
    monkeypatch.setattr(sm._Base, "_compare", lambda self, rows, names, *rest: (seen.append(len(rows) * len(names)), compare(self, rows, names, *rest))[1])
    asked = sm._Asked(np.arange(len(q)), sm._turned_to_one(q), 4, False)
    asked.start()
    asked.meet(np.arange(len(base)), sm._turned_to_one(base))
    by = np.argsort(asked.names)
    rows, distance = near_rows(q, base, 4)
    assert (asked.best[by] == distance).all() and (asked.found[by] == rows).mean() > 0.99  # a last bit may order two equal ones
    assert sum(seen) < len(q) * len(base) / 2


@pytest.mark.parametrize("skip", [True, False])
def test_text_ids_keep_their_order_and_their_own_row(spark, skip):
    rows = [(c, [1.0, 0.0]) for c in "dbca"] + [("e", [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {}
    for r in sm.cosine_top_k(df.where("id = 'b'"), df.where("id IS NOT NULL"), 2, skip_same=skip, broadcast_numbers=0).collect():
        got[r["rank"]] = r["id"]
    assert got == ({1: "a", 2: "c"} if skip else {1: "a", 2: "b"})


def test_records_of_one_text_share_its_hits(spark):
    scored = spark.createDataFrame([("r1", "t"), ("r2", "t"), ("r3", "u")], "record_id string, said string").withColumns(
        {
            "probability_of_loss": F.lit(0.5), "is_loss_making_prediction": F.lit(False), "top_features": F.array().cast("array<string>"),
            "input_quality_flags": F.array().cast("array<string>"), "model_warnings": F.array().cast("array<string>"), "prediction_error": F.lit(None).cast("string"),
        }
    )
    hits = spark.createDataFrame([("t", "a", 0.1, 1)], "query_id string, id string, distance double, rank int")
    outcomes = spark.createDataFrame([("a", True)], "record_id string, is_loss_making boolean")
    out = pl.assess(scored, hits, outcomes, asked="said").select("record_id", "conflict_detected").collect()
    assert {tuple(r) for r in out} == {("r1", True), ("r2", True), ("r3", False)}


def test_distances_by_products_keep_their_digits():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 6)) + 1e3
    y = np.vstack([x + rng.normal(size=x.shape) * 1e-4, rng.normal(size=(40, 6))])
    exact = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
    assert np.abs(km._gaps(x, y) / exact - 1).max() < 1e-9
    marks = km._marks(np.array(["a", "b"]), np.array(["a", "b"] * 40))
    there, back = km._gap_sums(x, marks[:40], y, marks, False)
    assert np.allclose(there, exact @ marks) and np.allclose(back, exact.T @ marks[:40])


def test_each_pair_of_blocks_is_compared_once(spark, monkeypatch):
    monkeypatch.setattr(km, "SILHOUETTE_BLOCK", 10)
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(90)]
    df = km.as_vectors(spark.createDataFrame(rows, "id long, c int, v array<double>"), "v", "f")
    x, c = np.array([r[2] for r in rows]), np.arange(90) % 3
    gap = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    total = np.stack([gap[:, c == k].sum(axis=1) for k in range(3)], axis=1)
    inside = total[np.arange(90), c] / 29
    total[np.arange(90), c] = np.inf
    outside = total.min(axis=1) / 30
    assert abs(km.euclidean_silhouette(df, "f", "c") - ((outside - inside) / np.maximum(inside, outside)).mean()) < 1e-9


def test_single_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "FILES_A_TASK", 5, raising=False)
    df = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(20)], "id string, text string").coalesce(1)
    fl.write_documents(df, "id", "text", str(tmp_path / "d"), one_file_each=True)
    names = [p.name for p in (tmp_path / "d").glob("id=*/part-*")]
    assert len(names) == 20 and len({n[:10] for n in names}) > 1
    assert sorted(map(tuple, fl.read_text_folder(spark, str(tmp_path / "d")).collect())) == sorted((f"k{i}", f"text {i}") for i in range(20))


def test_an_embedding_function_gets_few_texts_at_once(spark):
    df = spark.range(3_000).coalesce(1).select("id", F.when(F.col("id") != 7, F.concat(F.lit("t"), "id")).alias("text"))
    out = dc.embed_with(df, lambda texts: [[len(texts), len(s or "")] for s in texts]).collect()
    assert len(out) == 3_000 and max(r["embedding"][0] for r in out) <= 512
    assert all(r["embedding"][1] == len(r["text"] or "") for r in out)
