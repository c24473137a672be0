"""Keyed appends, copy-on-write buckets, versions with several writers, the hash index of a store."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.operators import documents as dc
from riskloom.sources import files as fl
from riskloom.sources import tables as tb
from riskloom.sources.keyed import KeyedTable
from riskloom.sources.versions import VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    yield name, str(tmp_path / "rows")
    tb.drop_table(spark, name)


def kv(spark, *rows, schema="k int, v string"):
    return spark.createDataFrame(list(rows), schema)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_append_upserts_by_declared_keys(spark, table):
    name, path = table
    tb.write_table(kv(spark, (1, "a"), (2, "b")), name, "fail", path, keys=["k"])
    tb.write_table(kv(spark, (2, "B"), (3, "c")), name, "append")
    assert told(spark.table(name)) == [(1, "a"), (2, "B"), (3, "c")]
    tb.write_table(kv(spark, (2, "x"), (2, "y"), (3, "z"), schema="k long, v string").withColumn("o", F.col("v")), name, "append", order="o")
    assert told(spark.table(name)) == [(1, "a"), (2, "y"), (3, "z")]
    tb.write_table(kv(spark), name, "append")
    assert spark.table(name).count() == 3


def test_append_null_keys_and_absent_columns(spark, table):
    name, path = table
    tb.write_table(kv(spark, (None, "a", 1), (2, "b", 2), schema="k int, v string, w int"), name, "fail", path, keys=["k"])
    tb.write_table(kv(spark, (None, "A"), (4, "d")), name, "append")
    assert told(spark.table(name)) == [(2, "b", 2), (4, "d", None), (None, "A", 1)]


def test_append_refuses_repeated_keys_unknown_columns_and_unknown_keys(spark, table):
    name, path = table
    with pytest.raises(ValueError, match="does not exist"):
        tb.write_table(kv(spark, (1, "a")), name, "append", keys=["k"])
    tb.write_table(kv(spark, (1, "a")), name, "fail", path)
    with pytest.raises(ValueError, match="keys"):
        tb.write_table(kv(spark, (1, "a")), name, "append")
    with pytest.raises(ValueError, match="comes 2 times"):
        tb.write_table(kv(spark, (None, "a"), (None, "b")), name, "append", keys=["k"])
    with pytest.raises(ValueError, match="no column z"):
        tb.write_table(kv(spark, (1, "a"), schema="k int, z string"), name, "append", keys=["k"])
    tb.write_table(kv(spark, (1, "a")), name, "append", keys=[])  # rows as they are, on request
    assert told(spark.table(name)) == [(1, "a"), (1, "a")]


@pytest.mark.parametrize("mode", ["append", "replace"])
def test_a_failed_write_leaves_the_table(spark, table, mode):
    name, path = table
    tb.write_table(kv(spark, (1, "a"), (2, "b")), name, "fail", path, keys=["k"])
    bad = spark.range(4).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("v"))
    with pytest.raises(Exception, match="broken"):
        tb.write_table(bad, name, mode)
    assert told(spark.table(name)) == [(1, "a"), (2, "b")]


def test_replace_keeps_keys_and_takes_other_columns(spark, table):
    name, path = table
    tb.write_table(kv(spark, (1, "a")), name, "fail", path, keys=["k"])
    for i in range(4):  # folders before the last one go
        tb.write_table(kv(spark, (i, "b")), name, "replace")
    tb.write_table(kv(spark, (3, "c")), name, "append")
    assert told(spark.table(name)) == [(3, "c")]
    assert sum("__rows-" in f for f in os.listdir(os.path.dirname(path))) == 2
    tb.write_table(kv(spark, (1, 2.5), schema="k int, z double"), name, "replace")
    assert told(spark.table(name)) == [(1, 2.5)]


def test_a_table_without_a_path(spark):
    name = f"t_{uuid.uuid4().hex}"
    try:
        tb.write_table(kv(spark, (1, "a")), name, "fail", keys=["k"])
        tb.write_table(kv(spark, (1, "b"), (2, "c")), name, "append")
        tb.write_table(kv(spark, (2, "d")), name, "append")
        assert told(spark.table(name)) == [(1, "b"), (2, "d")]
    finally:
        tb.drop_table(spark, name)


def test_upsert_null_keys_and_repeated_keys(spark):
    target = kv(spark, (None, "x"), (1, "a"))
    assert told(tb.upsert(target, kv(spark, (None, "y"), (2, "b")), ["k"])) == [(1, "a"), (2, "b"), (None, "y")]
    with pytest.raises(ValueError, match="comes 2 times"):
        tb.upsert(target, kv(spark, (2, "b"), (2, "c")), ["k"])


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=50)
    rows = spark.range(1600).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("w"))
    assert table.read() is None and table.upsert(rows.limit(0)) is None
    assert table.upsert(rows) == 1
    before = table.files()
    assert len(before) == 32
    table.upsert(spark.createDataFrame([(7, "new"), (8, "new"), (None, "none")], "k int, v string"))
    after = table.files()
    assert sum(before[b] != after.get(b) for b in before) <= 3
    out = {r["k"]: (r["v"], r["w"]) for r in table.read().collect()}
    assert len(out) == 1601 and out[7] == ("new", 1) and out[None] == ("none", None) and out[9] == ("old", 1)
    assert table.read(1).count() == 1600 and table.count() == 1601
    with pytest.raises(ValueError, match="comes"):
        table.upsert(spark.createDataFrame([(7, "a"), (7, "b")], "k int, v string"))
    table.upsert(spark.createDataFrame([(7, "a", 1), (7, "b", 2)], "k int, v string, o int"), order="o")
    assert table.read().where("k = 7").first()["v"] == "b"


def test_a_keyed_update_rewrites_only_buckets_with_hits(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=50)
    table.upsert(spark.range(800).select(F.col("id").alias("k"), F.lit(0).alias("v")))
    before = table.files()
    table.update("v", [1, 2], ["k = 5", "k < 7"])
    assert sum(before[b] != f for b, f in table.files().items()) <= 7
    assert {r["k"]: r["v"] for r in table.read().where("v > 0").collect()} == {**dict.fromkeys(range(7), 2), 5: 1}
    with pytest.raises(ValueError):
        table.update("k", [1], ["k = 5"])


def test_a_growing_keyed_table_gets_more_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=20)
    for i in range(4):
        table.upsert(spark.range(i * 50, i * 50 + 50).select(F.col("id").alias("k")))
    assert table.marker()["count"] >= 8 and table.count() == 200
    assert sorted(r["k"] for r in table.read().collect()) == list(range(200))


def test_two_writers_of_a_keyed_table(spark, tmp_path):
    first, second = (KeyedTable(spark, str(tmp_path / "t"), ["k"], bucket_rows=20) for _ in range(2))
    first.upsert(kv(spark, (1, "a"), (2, "b")))
    publish = first.ready.publish

    def overtaken(marker):
        if marker["version"] == 2:
            second.upsert(kv(spark, (2, "second"), (3, "second")))
        return publish(marker)

    first.ready.publish = overtaken
    assert first.upsert(kv(spark, (3, "first"), (4, "first"))) == 3
    assert told(first.read()) == [(1, "a"), (2, "second"), (3, "first"), (4, "first")]


def test_two_writers_lose_no_version(spark, tmp_path):
    first, second = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t"))
    publish, calls = first.ready.publish, []

    def overtaken(marker):
        if not calls:
            calls.append(second.append(spark.range(100, 110)))
        return publish(marker)

    first.ready.publish = overtaken
    assert first.append(spark.range(10)) == 2 and calls == [1]
    assert first.read(1).count() == 10 and first.read().count() == 20
    assert first.markers().where("version = 2").first()["document_count"] == 20


def test_segments_stay_few(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(20):
        table.append(spark.range(i * 3, i * 3 + 3).coalesce(1))
    assert sorted(r["id"] for r in table.read().collect()) == list(range(60))
    assert len(table.ready.latest()["segments"]) <= 8 and table.read(5).count() == 15


def test_an_update_reads_only_its_hash_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dc, "FOLDER_HASHES", 10)
    store = dc.DocumentStore(spark, str(tmp_path / "s"), ["doc_id"])
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    store.update(docs)
    batch = docs.where("doc_id IN (3, 4)").unionByName(spark.createDataFrame([(900, "other"), (901, None)], "doc_id long, text string"))
    known = store.known_hashes(batch)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan and known.count() < 40
    assert store.update(batch) == 2 and store.update(batch) is None
    assert store.read().count() == 402


def test_families_of_documents_that_share_table_ids(spark):
    rows = [(d, "t1", "table_row", i, f"{d}{i}") for d in ("d1", "d2") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id string, table_id string, type string, row_index int, uid string").withColumn("columns", F.lit("c"))
    out = told(dc.biggest_table_sample(df, 3).select("doc_id", "position", "uid"))
    assert out == [(d, i + 1, f"{d}{i}") for d in ("d1", "d2") for i in range(3)]
    one = dc.fetch_table_family(df, spark.createDataFrame([("d2", "t1")], "doc_id string, table_id string"), row_limit=2)
    assert told(one.select("uid")) == [("d20",), ("d21",)]


def test_json_arrays_are_bounded(spark, tmp_path):
    items = spark.range(100).select(F.concat(F.lit("R"), "id").alias("record_id"), F.struct(F.lit(1.5).alias("loss_ratio")).alias("ground_truth"))
    fl.write_json_arrays(items, str(tmp_path / "a"), "record_id", rows=20)
    assert len([f for _, _, names in os.walk(tmp_path / "a") for f in names if f.startswith("part-")]) >= 4
    assert fl.read_eval_items(spark, str(tmp_path / "a")).select("record_id").distinct().count() == 100
