"""Catalog and JDBC tables: reads, writes, inserts with ids, upserts, updates, SQL scripts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.cleaning import storable
from riskloom.plans.frames import attach, written
from riskloom.plans.ranking import dense_numbers
from riskloom.sources.keyed import conformed, last_per_key, merge, one_row_per_key
from riskloom.sources.publication import remove_folder


def query_frame(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, coerce_float: bool = False) -> DataFrame:
    """Frame of a query; `coerce_float` turns every decimal column into double."""
    df = spark.sql(sql, args=dict(args or {}))
    if not coerce_float:
        return df
    decimals = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(decimals) if decimals else df


def jdbc_options(
    url: str, table: str, order_by: str, bounds: tuple[Any, Any], partitions: int, fetch_size: int = 10_000
) -> dict[str, str]:
    """Options of a partitioned read: each task reads one range of the key, no offset paging."""
    return {
        "url": url, "dbtable": table, "partitionColumn": order_by, "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]), "numPartitions": str(partitions), "fetchsize": str(fetch_size),
    }


def read_table(
    spark: SparkSession, table: str, order_by: str | None = None, jdbc: Mapping[str, Any] | None = None
) -> DataFrame:
    """A whole table, from the catalog or over JDBC in key ranges, ordered when `order_by` is given."""
    if jdbc:
        df = spark.read.format("jdbc").options(**jdbc).load()
    else:
        df = spark.table(table)
    return df.orderBy(order_by) if order_by else df


def ordered_chunks(df: DataFrame, order_by: str, chunk_size: int = 1000, ties: Sequence[str] = ()) -> DataFrame:
    """`df` with `chunk` and `place`, both from 0: chunks of `chunk_size` rows in the order of any numeric, date or text key.

    Rows are range-partitioned by the key and numbered range by range, so nothing is sorted whole and no offset is
    paged over. `ties` order rows of one key, then a hash of the row does; missing keys come first.
    """
    if chunk_size < 1:
        raise ValueError("a chunk holds at least one row")
    order = F.struct(order_by, *ties, F.xxhash64(*df.columns).alias("__hash"))
    numbered = dense_numbers(df.withColumn("__order", order), "__order", "place").drop("__order")
    return numbered.withColumn("chunk", F.floor(F.col("place") / chunk_size))


def chunk_bounds(df: DataFrame, order_by: str, chunk_size: int = 1000) -> DataFrame:
    """(chunk, low, high, rows): key ranges of about `chunk_size` rows that hold every row with a key once.

    A key with more rows than a chunk is a range of its own with all of them. Only keys and their counts are ranked.
    """
    keys = df.where(F.col(order_by).isNotNull()).groupBy(order_by).agg(F.count(F.lit(1)).alias("n"))
    numbered = ordered_chunks(keys, order_by, 1).withColumnRenamed("place", "at").drop("chunk")
    lanes = numbered.withColumn("lane", F.floor(F.col("at") / LANE_KEYS))
    inside = Window.partitionBy("lane").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lanes.groupBy("lane").agg(F.sum("n").alias("total"))
    lower = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)  # one row per hundred thousand keys
    below = sizes.select("lane", F.coalesce(F.sum("total").over(lower), F.lit(0)).alias("below"))
    before = F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    counted = lanes.join(F.broadcast(below), "lane").select(order_by, "n", F.floor(before / chunk_size).alias("slot"))
    found = counted.groupBy("slot").agg(F.min(order_by).alias("low"), F.max(order_by).alias("high"), F.sum("n").alias("rows"))
    return ordered_chunks(found, "slot", 1).select("chunk", "low", "high", "rows")


#: Keys that one task adds up in a row.
LANE_KEYS = 100_000


def range_predicates(bounds: DataFrame, order_by: str) -> list[str]:
    """One condition per chunk for a partitioned read over JDBC (`spark.read.jdbc(predicates=...)`), in key order.

    The first one takes the rows without a key, too.
    """
    rows = bounds.orderBy("chunk").select(F.col("low").cast("string"), F.col("high").cast("string")).collect()  # one row per task of the read
    numeric = isinstance(bounds.schema["low"].dataType, T.NumericType)
    told = [[x if numeric else quoted_list([x]) for x in r] for r in rows]
    spans = [f"{order_by} >= {low} AND {order_by} <= {high}" for low, high in told]
    return [f"({s}) OR {order_by} IS NULL" if i == 0 else s for i, s in enumerate(spans)]


def count_records(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).agg(F.count(F.lit(1)).alias("records"))


def table_columns(spark: SparkSession, table: str) -> DataFrame:
    """(position, name, type) of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(spark.table(table).schema.fields)]
    return spark.createDataFrame(rows, "position int, name string, type string")


_MODES = ("replace", "fail", "append")
_KEYS, _BEFORE = "riskloom.keys", "riskloom.rows_before"


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    """Location and key properties of a catalog table."""
    told = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)", args={"t": table}).where(F.col("col_name") == "Location").first()
    properties = {r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES IDENTIFIER(:t)", args={"t": table}).collect()}
    return {"location": told["data_type"], "keys": properties.get(_KEYS, ""), "before": properties.get(_BEFORE, "")}


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _set(spark: SparkSession, table: str, name: str, value: str) -> None:
    spark.sql(f"ALTER TABLE IDENTIFIER(:t) SET TBLPROPERTIES ({_literal(name)} = {_literal(value)})", args={"t": table})


def _switch(spark: SparkSession, table: str, folder: str, old: dict[str, str]) -> None:
    """The table reads another folder from now on: one change in the catalog. The folder before the last one goes."""
    spark.sql(f"ALTER TABLE IDENTIFIER(:t) SET LOCATION {_literal(folder)}", args={"t": table})
    _set(spark, table, _BEFORE, old["location"])
    spark.catalog.refreshTable(table)
    if "__rows-" in old["before"]:  # only what a publication made; a query that still runs reads the last one
        remove_folder(spark, old["before"])


def _staged(location: str) -> str:
    return f"{location.rstrip('/').split('__rows-')[0]}__rows-{uuid.uuid4().hex}"


def write_table(
    df: DataFrame, table: str, if_exists: str = "fail", path: str | None = None, keys: Sequence[str] | None = None, order: str | None = None
) -> None:
    """Store a frame as a catalog table, values made storable first; a failed write raises and leaves the table as it was.

    `keys` given when the table is made are kept with it. `append` merges by them (or by `keys`): rows with a known key
    are updated in the columns the frame has, others are added, NULL being one key; with `order` the last row of a
    key wins, without it a key that comes twice is an error. `keys=[]` adds rows as they are. An empty frame changes
    nothing. What replaces a table's rows is written to a folder beside them, and the catalog is switched to it when it is
    whole; if another writer switched meanwhile, the merge is done again on its rows.
    """
    if if_exists not in _MODES:
        raise ValueError(f"if_exists must be one of {sorted(_MODES)}")
    spark, rows = df.sparkSession, storable(df)
    exists = spark.catalog.tableExists(table)
    if if_exists == "append":
        if not exists:
            raise ValueError(f"table {table} does not exist")
        _append(rows, table, keys, order)
        return
    if exists and if_exists == "replace":
        old = _described(spark, table)
        folder = _staged(path or old["location"])
        rows.write.parquet(folder)
        if [(f.name, f.dataType) for f in spark.table(table).schema] == [(f.name, f.dataType) for f in rows.schema]:
            _switch(spark, table, folder, old)
        else:  # other columns: a new entry of the catalog over rows that are already written
            drop_table(spark, table)
            spark.catalog.createTable(table, path=folder, source="parquet", schema=rows.schema)
    else:
        writer = rows.write.mode("errorifexists")
        (writer.option("path", path) if path else writer).saveAsTable(table)
    if keys is not None:
        _set(spark, table, _KEYS, ",".join(keys))


def _append(rows: DataFrame, table: str, keys: Sequence[str] | None, order: str | None) -> None:
    spark = rows.sparkSession
    declared = _described(spark, table)["keys"]
    if keys is None and not declared:
        raise ValueError(f"{table} has no declared keys: give keys, or keys=[] to add rows as they are")
    names = list(keys) if keys is not None else declared.split(",")
    schema = spark.table(table).schema
    if not names:
        conformed(rows, schema).select(*[c if c in rows.columns else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.fieldNames()]).write.mode(
            "append"
        ).insertInto(table)
        return
    latest = one_row_per_key(conformed(rows, schema, [order] if order else []), names, order)
    latest = written(latest.drop(order) if order and order not in schema.fieldNames() else latest)
    if not latest.limit(1).collect():
        return
    while True:
        old = _described(spark, table)
        folder = _staged(old["location"])
        merge(spark.table(table), latest, names, keep_absent=True).select(*schema.fieldNames()).write.parquet(folder)
        if _described(spark, table)["location"] == old["location"]:
            _switch(spark, table, folder, old)
            return
        remove_folder(spark, folder)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": table})


def with_ids(df: DataFrame, order: str, name: str = "id", last: int = 0) -> DataFrame:
    """Consecutive ids after `last`, in the order of a unique column."""
    return dense_numbers(df, order, name, start=last + 1)


def bulk_insert(df: DataFrame, table: str, order: str, id_column: str = "id") -> tuple[int, int]:
    """Append rows with generated ids; returns the first and last new id."""
    spark = df.sparkSession
    last = spark.table(table).agg(F.max(id_column)).first()[0] or 0
    rows = with_ids(df, order, id_column, last).select(*spark.table(table).columns)
    storable(rows).write.mode("append").insertInto(table)
    return last + 1, last + rows.count()


def insert_row(spark: SparkSession, row: Mapping[str, Any], table: str, id_column: str = "id") -> int:
    """Append one row and return its id."""
    schema = spark.table(table).schema
    last = spark.table(table).agg(F.max(id_column)).first()[0] or 0
    values = [last + 1 if f.name == id_column else row.get(f.name) for f in schema.fields]
    spark.createDataFrame([tuple(values)], schema).write.mode("append").insertInto(table)
    return last + 1


def rows_frame(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType) -> DataFrame:
    """A frame from dicts; the first dict names the columns, absent values are missing."""
    names = list(rows[0]) if rows else schema.fieldNames()
    kept = T.StructType([T.StructField(n, schema[n].dataType) for n in names])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kept)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of `source` replace rows of `target` with the same key; the rest is kept or added.

    With `order`, the last source row of a key wins; without it a key that comes twice is an error. NULL keys are one
    key on both sides. The result is a new frame, to be published as a new version (`write_table`, `KeyedTable`);
    nothing is changed in place. Columns absent from the source become missing.
    """
    latest = one_row_per_key(source, keys, order)
    if order and order not in target.columns:
        latest = latest.drop(order)
    return merge(target, latest, keys)


def update_fields(df: DataFrame, fields: Mapping[str, Any], condition: str | Column) -> DataFrame:
    """Set columns to constants where the condition holds."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumns({c: F.when(cond, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()})


def update_column(df: DataFrame, column: str, values: Sequence[Any], conditions: Sequence[str | Column]) -> DataFrame:
    """Ordered CASE: the first condition that holds gives the value, else the old value stays."""
    if len(values) != len(conditions):
        raise ValueError("values and conditions differ in length")
    if not values:
        return df
    new = F
    for v, c in zip(values, conditions):
        new = new.when(F.expr(c) if isinstance(c, str) else c, F.lit(v))
    return df.withColumn(column, new.otherwise(F.col(column)))


def update_from(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """New values of one column from a (key, value) frame; other rows stay."""
    new = changes.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    joined = df.join(new, key, "left")
    return joined.withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__hit").select(*df.columns)


def missing_keys(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys that the table does not hold.

    The table is reduced to the wanted keys and to one row per key before the anti-join, so a key
    with very many rows costs nothing extra.
    """
    wanted = keys.select(key).distinct()
    present = table.select(key).join(wanted, key, "left_semi").distinct()
    return wanted.join(present, key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Any, name: str | None = None) -> DataFrame:
    """Value of a unique key with a default for unknown keys."""
    joined = attach(df, table.select(key, F.col(value).alias("__value")), [key])
    return joined.withColumn(name or value, F.coalesce("__value", F.lit(default))).drop("__value")


_TOKENS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|\s+|.""", re.S)


def split_statements(script: str) -> list[str]:
    """Statements of a script; `;` and comment marks inside quotes are text."""
    parts, current = [], []
    for token in _TOKENS.findall(script):
        if token == ";":
            parts.append("".join(current))
            current = []
        elif token.startswith(("--", "/*")) or token.isspace():
            current.append(" ")
        else:
            current.append(token)
    parts.append("".join(current))
    return [p.strip() for p in parts if p.strip()]


def run_script(spark: SparkSession, script: str, args: Mapping[str, Any] | None = None) -> DataFrame | None:
    """Run all statements in order; the frame of the last one that returns columns."""
    last = None
    for statement in split_statements(script):
        df = spark.sql(statement, args=dict(args or {}))
        if df.columns:
            last = df
    return last


def read_script(spark: SparkSession, path: str) -> str:
    if not path.endswith(".sql"):
        raise ValueError(f"{path} is not a SQL file")
    return spark.read.text(path, wholetext=True).first()[0]


def quoted_list(values: Sequence[Any]) -> str:
    """Values as a comma-separated list of SQL text literals."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


