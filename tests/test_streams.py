from pyspark.sql import functions as F

from riskloom.streaming import monitors as mo
from riskloom.streaming import runs as rn


def folder(spark, tmp_path):
    rows = spark.range(600).select(
        F.col("id").alias("record_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 240).alias("ts"),
        F.when(F.col("id") % 3 == 0, F.lit("low")).otherwise("high").alias("confidence_level"),
        (F.col("id") % 3 == 0).alias("second_opinion_recommended"), F.array(F.lit("predict_loss")).alias("tools_used"),
        F.concat(F.lit("Text "), F.col("id") % 50).alias("text"), (F.col("id") % 20).cast("double").alias("x"),
    )
    path = str(tmp_path / "in")
    for i in range(3):  # three files, three micro-batches
        rows.where(F.floor(F.col("record_id") / 200) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), rn.file_stream(spark, path, rows.schema, files_per_batch=1)


def test_stream_equals_batch(spark, tmp_path, rows):
    batch, stream = folder(spark, tmp_path)
    got = rn.update_to(mo.decision_shares(stream), str(tmp_path / "a"), str(tmp_path / "ca"), ["window_start"])
    want = mo.decision_shares(batch)
    assert rows(got, *want.columns) == rows(want)


def test_drift_equals_batch(spark, tmp_path, rows):
    batch, stream = folder(spark, tmp_path)
    edges = [4.0, 9.0, 14.0]
    ref = mo.reference_shares(batch, "x", edges)
    got = rn.update_to(mo.drift(stream, "x", edges, ref), str(tmp_path / "b"), str(tmp_path / "cb"), ["window_start"])
    want = mo.drift(batch, "x", edges, ref)
    assert rows(got, *want.columns) == rows(want)
    assert all(abs(r["psi"]) < 0.05 for r in want.collect() if r["rows"] > 100)


def test_first_content_in_a_stream(spark, tmp_path):
    _, stream = folder(spark, tmp_path)
    out = rn.append_to(mo.first_content(stream, delay="10 days").select("record_id", "content_hash"), str(tmp_path / "c"), str(tmp_path / "cc"))
    assert sorted(r["record_id"] for r in out.collect()) == list(range(50))


def test_halt_signal(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", True), ("2024-01-01 10:01:00", False), ("2024-01-01 20:00:00", False)], "t string, second_opinion_recommended boolean")
    out = mo.halt_signals(df.withColumn("ts", F.to_timestamp("t"))).collect()
    assert out and all(r["escalation_share"] > 0.4 and r["window_start"].hour < 11 for r in out)
