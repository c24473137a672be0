"""Record, document and evaluation files."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.hashing import row_hash
from riskloom.schemas import EVAL_ITEM, RECORD, REQUEST, USAGE

CORRUPT = "_corrupt_record"
# Document extensions; the binary ones are listed but not parsed.
TEXT_EXTENSIONS = ("txt", "md")
OTHER_EXTENSIONS = ("pdf", "docx", "doc")
#: Files that one task writes, and the setting by which tasks, not the driver, move what they wrote.
FILES_A_TASK, COMMIT_VERSION = 500, "mapreduce.fileoutputcommitter.algorithm.version"


def read_records_csv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records with a header line; rows that do not fit the schema keep their text in `_corrupt_record`."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT
    ).csv(path)


def record_struct(text: str | Column, schema: T.StructType = REQUEST) -> Column:
    """Record from JSON text, bare or under `record`; anything that is not an object gives NULL."""
    column = F.col(text) if isinstance(text, str) else text
    # the name stands in the text as it is, unless something in it is escaped
    inner = F.when(column.contains('"record"') | column.contains("\\"), F.get_json_object(column, "$.record"))
    chosen = F.when(inner.startswith("{"), inner).otherwise(column)
    is_object = F.trim(column).startswith("{") & F.try_parse_json(column).isNotNull()
    # the struct is named once: dropping a field from it would parse the text again for every field
    return F.when(is_object, F.from_json(chosen, schema, {"mode": "PERMISSIVE"}))


def read_record_json(spark: SparkSession, path: str, schema: T.StructType = REQUEST) -> tuple[DataFrame, DataFrame]:
    """One record per file: (records, quarantined files that hold no object)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = files.withColumn("record", record_struct("value", schema))
    good = parsed.where("record IS NOT NULL").select("file", "record.*")
    return good, parsed.where("record IS NULL").select("file", F.col("value").alias("text"))


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a folder with one text file per record, id being the file stem.

    Folders written by `write_documents(one_file_each=True)` carry the id in the folder name.
    An empty folder is an error.
    """
    try:
        raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        found = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        if not found.limit(1).collect():
            raise FileNotFoundError(f"no documents in {path}")
    except AnalysisException as e:
        raise FileNotFoundError(f"no documents in {path}") from e
    by_folder = F.regexp_extract("file", r"/[^/=]+=([^/]+)/[^/]+$", 1)
    by_stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return found.select(
        F.url_decode(F.when(by_folder != "", by_folder).otherwise(by_stem)).alias("id"),
        F.regexp_replace("text", r"\n\z", "").alias("text"),
    )


def read_mixed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, extension, status, text) of all documents below a folder; other files are skipped."""
    names = ",".join([*TEXT_EXTENSIONS, *OTHER_EXTENSIONS])
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + names + "}")
        .load(path)
    )
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    readable = extension.isin(*TEXT_EXTENSIONS)
    return files.select(
        F.col("path").alias("file"),
        extension.alias("extension"),
        F.when(readable, F.lit("loaded")).otherwise(F.lit("unsupported")).alias("status"),
        F.when(readable, F.decode("content", "UTF-8")).alias("text"),
    )


def read_eval_items(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Labelled items with the `ground_truth` struct, from files that hold a JSON array or, with
    `array=False`, one object per line (splittable, for large sets)."""
    return spark.read.schema(EVAL_ITEM).option("multiLine", array).json(path)


def write_documents(
    df: DataFrame, key: str, text: str, path: str, buckets: int = 64, one_file_each: bool = False
) -> None:
    """Documents by key. Default: JSON lines in hash buckets; on request one text file per row.

    Single files are dealt to tasks by key, about `FILES_A_TASK` each, and each task puts its own in place.
    """
    if one_file_each:
        tasks = max(1, math.ceil(df.count() / FILES_A_TASK))
        dealt = df.select(text, key).repartition(tasks, key)
        dealt.write.mode("overwrite").option(COMMIT_VERSION, "2").partitionBy(key).text(path)
        return
    bucket = F.pmod(row_hash(key), F.lit(buckets)).alias("bucket")
    df.select(F.col(key).alias("id"), F.col(text).alias("text"), bucket).write.mode("overwrite").partitionBy("bucket").json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_arrays(df: DataFrame, path: str, key: str, rows: int = 10_000) -> None:
    """Rows as JSON arrays of about `rows` items, one array a file, dealt by a hash of the whole row.

    An array is one value by its format, so each is made and read by one task: their number grows with the rows.
    """
    arrays = max(1, math.ceil(df.select(key).count() / rows))
    bucket = F.pmod(F.xxhash64(*df.columns), F.lit(arrays)).alias("part")
    items = df.groupBy(bucket).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    items.write.partitionBy("part").text(path)


def append_usage_log(df: DataFrame, path: str) -> None:
    """Append usage rows as CSV; the tool-call map is written as JSON text."""
    usage_rows(df).write.mode("append").option("header", True).option("escape", '"').csv(path)


def export_usage_log(df: DataFrame, path: str) -> None:
    usage_rows(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def usage_rows(df: DataFrame) -> DataFrame:
    columns = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name).cast(f.dataType).alias(f.name) for f in USAGE.fields]
    return df.select(*columns)


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.MapType) else f.dataType) for f in USAGE.fields])
    raw = spark.read.schema(flat).option("header", True).option("escape", '"').csv(path)
    return raw.withColumn("tool_calls", F.from_json("tool_calls", "map<string,bigint>"))
