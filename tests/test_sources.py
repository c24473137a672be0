import json

import pytest
from pyspark.sql import functions as F

from riskloom.schemas import RECORD
from riskloom.sources import files as fl
from riskloom.sources import tables as tb
from riskloom.sources.versions import VersionedTable


def test_records_csv_keeps_bad_lines(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(",".join(RECORD.fieldNames()) + "\nR1,cyber,UK,retail,100,5,B,1,2,0.5,True\nR2,cyber,UK,retail,much,5,B,,,0.5,False\n")
    out = {r["record_id"]: r for r in fl.read_records_csv(spark, str(path)).collect()}
    assert out["R1"]["limit"] == 100 and out["R1"]["_corrupt_record"] is None and out["R1"]["is_loss_making"] is True
    assert out["R2"]["limit"] is None and out["R2"]["_corrupt_record"].startswith("R2")


def test_record_json_bare_nested_and_bad(spark, tmp_path):
    for name, body in {"a": {"record_id": "A", "limit": 5}, "b": {"record": {"record_id": "B"}}, "c": [1, 2]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    good, bad = fl.read_record_json(spark, str(tmp_path))
    assert {r["record_id"] for r in good.collect()} == {"A", "B"} and bad.count() == 1


def test_text_folder(spark, tmp_path):
    (tmp_path / "REC_001.txt").write_text("doc one")
    (tmp_path / "REC_002.txt").write_text("doc\ntwo\n")
    assert {tuple(r) for r in fl.read_text_folder(spark, str(tmp_path)).collect()} == {("REC_001", "doc one"), ("REC_002", "doc\ntwo")}
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        fl.read_text_folder(spark, str(empty))


def test_mixed_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text("# é")
    (tmp_path / "deep" / "b.txt").write_text("b")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.png").write_bytes(b"x")
    out = {r["extension"]: (r["status"], r["text"]) for r in fl.read_mixed_documents(spark, str(tmp_path)).collect()}
    assert out == {"md": ("loaded", "# é"), "txt": ("loaded", "b"), "pdf": ("unsupported", None)}


def test_eval_items_from_an_array(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps([{"record_id": "A", "ground_truth": {"is_loss_making": True, "loss_ratio": 1.2}}, {"record_id": "B", "ground_truth": {"case_type": "borderline"}}], indent=1))
    out = {r["record_id"]: r["ground_truth"] for r in fl.read_eval_items(spark, str(path)).collect()}
    assert out["A"]["loss_ratio"] == 1.2 and out["B"]["case_type"] == "borderline"


def test_unmarked_version_is_rebuilt(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    df = spark.range(42)
    df.limit(3).write.parquet(f"{table.path}/version=1")
    assert table.read() is None
    assert table.write(df) == 1 and table.read().count() == 42
    assert table.markers().first()["document_count"] == 42
    assert table.append(df.limit(2)) == 2 and table.markers().where("version = 2").first()["document_count"] == 44
    with pytest.raises(ValueError):
        table.read(7)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    source = spark.createDataFrame([(2, "old", 0), (2, "new", 1), (3, "c", 2)], "k int, v string, seq int")
    out = {r["k"]: (r["v"], r["w"]) for r in tb.upsert(target, source, ["k"], "seq").collect()}
    assert out == {1: ("a", "x"), 2: ("new", None), 3: ("c", None)}
    again = tb.upsert(tb.upsert(target, source, ["k"], "seq"), source, ["k"], "seq")
    assert again.count() == 3
    assert tb.upsert(target, source.limit(0), ["k"], "seq").count() == 2


def test_rows_frame_takes_the_first_dict(spark):
    schema = spark.range(1).select(F.col("id").alias("a"), F.lit("x").alias("b")).schema
    assert [tuple(r) for r in tb.rows_frame(spark, [{"a": 1, "b": "p"}, {"a": 2, "z": 3}], schema).collect()] == [(1, "p"), (2, None)]


def test_updates(spark):
    df = spark.createDataFrame([(1, 5), (2, 15), (3, 25)], "k int, v int")
    assert [r["v"] for r in tb.update_column(df, "v", [100, 200], ["v > 20", "v > 10"]).collect()] == [5, 200, 100]
    assert [r["v"] for r in tb.update_fields(df, {"v": 0}, "k = 2").collect()] == [5, 0, 25]
    with pytest.raises(ValueError):
        tb.update_column(df, "v", [1], [])


def test_statements_respect_quotes_and_comments():
    script = "SELECT ';--' AS a; -- drop; me\n/* x;\n y */ SELECT 'it''s; fine', \"b;\" ;\n ;"
    assert [" ".join(s.split()) for s in tb.split_statements(script)] == ["SELECT ';--' AS a", "SELECT 'it''s; fine', \"b;\""]
    assert tb.quoted_list(["a", "b'c"]) == "'a', 'b''c'"


def test_jdbc_options_read_key_ranges():
    o = tb.jdbc_options("jdbc:x", "t", "id", (0, 1000), 8)
    assert (o["partitionColumn"], o["numPartitions"], o["upperBound"]) == ("id", "8", "1000")


def test_missing_keys(spark):
    table = spark.createDataFrame([(1,)] * 500 + [(2,)], "k int")
    keys = spark.createDataFrame([(1,), (3,), (3,)], "k int")
    assert [r["k"] for r in tb.missing_keys(keys, table, "k").collect()] == [3]
