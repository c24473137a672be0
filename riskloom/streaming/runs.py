"""Running streams to tables: append rows, or the latest state of updated groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream, whether its path is one file or a folder of part files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return file_stream(spark, path, schema, files_per_batch=files_per_batch)
    folder, _, name = path.rpartition("/")
    return file_stream(spark, folder, schema, name, files_per_batch)


def append_to(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> DataFrame:
    """Process all available input in append mode and return the sink as a frame."""
    run = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    _wait(run, timeout)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def update_to(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], timeout: int | None = None) -> DataFrame:
    """Process all available input in update mode; returns the last emitted row of every key.

    Every micro-batch overwrites its own folder, so a replayed batch leaves the same result.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run = (
        stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    _wait(run, timeout)
    return latest_rows(stream.sparkSession, path, stream.schema, keys)


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(wide).parquet(path)
    values = [f.name for f in schema.fields if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__last"))
    return last.select(*keys, "__last.*")


def _wait(run, timeout: int | None) -> None:
    if not run.awaitTermination(timeout) and timeout is not None:
        run.stop()
        raise TimeoutError(f"stream did not finish in {timeout} seconds")
