"""Keyed merges: rows of a batch replace rows of a table with equal keys, as new files that are switched to when whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans.frames import same_keys, written
from riskloom.sources.publication import Markers

BUCKET_ROWS = 1_000_000
ATTEMPTS = 50
_BUCKET = "__bucket"


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of every key by an order column: a narrow maximum per key, then a semi-join on key and place.

    Missing order values come first, NULL keys are one key, and of rows with equal key and order the one
    with the larger row hash is kept.
    """
    place = F.struct(F.col(order).isNotNull(), F.col(order), F.xxhash64(*df.columns))
    placed = df.withColumn("__place", place)
    winners = placed.groupBy(*keys).agg(F.max("__place").alias("__last")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = same_keys(placed, winners, [*((k, f"__k_{k}") for k in keys), ("__place", "__last")])
    return placed.join(winners, same, "left_semi").drop("__place").dropDuplicates(list(keys))


def one_row_per_key(source: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """The rows to merge: the last of each key with `order`; without it a repeated key is an error, NULL being one key."""
    missing = [k for k in keys if k not in source.columns]
    if missing or not keys:
        raise ValueError(f"no key column {', '.join(missing)}" if missing else "a keyed merge needs keys")
    if order:
        return last_per_key(source, keys, order)
    twice = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"key {[twice[0][k] for k in keys]} comes {twice[0]['__n']} times; give an order column to choose the last")
    return source


def merge(target: DataFrame, latest: DataFrame, keys: Sequence[str], keep_absent: bool = False) -> DataFrame:
    """`target` with the rows of `latest` (unique keys) in place of its own of equal keys; NULL equals NULL.

    Columns that `latest` lacks become missing, or with `keep_absent` stay as they are in the row that is replaced.
    """
    renamed = latest.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    keep = target.join(renamed, same_keys(target, renamed, [(k, f"__k_{k}") for k in keys]), "left_anti")
    absent = [c for c in target.columns if c not in latest.columns]
    if keep_absent and absent:
        old = target.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *absent)
        latest = latest.join(old, same_keys(latest, old, [(k, f"__k_{k}") for k in keys]), "left").drop(*[f"__k_{k}" for k in keys])
    return keep.unionByName(latest, allowMissingColumns=True)


def conformed(source: DataFrame, schema: T.StructType, extra: Sequence[str] = ()) -> DataFrame:
    """The source with the types of a table's columns, so that equal keys are equal; unknown columns are an error."""
    unknown = [c for c in source.columns if c not in schema.fieldNames() and c not in extra]
    if unknown:
        raise ValueError(f"the table has no column {', '.join(unknown)}")
    return source.select(*[F.col(c).cast(schema[c].dataType).alias(c) if c in schema.fieldNames() else F.col(c) for c in source.columns])


class KeyedTable:
    """Rows with unique keys in buckets by a hash of the key; an upsert rewrites the buckets that it changes.

    `<path>/rows-<id>/__bucket=B/` holds buckets, a marker names the folder of every bucket that has rows. A batch
    reads and rewrites only the buckets its keys fall into; all other files are named again as they are, so the
    cost follows the batch. Buckets hold about `bucket_rows` rows: when they have twice that, the table is dealt into
    four times as many, which a growing table pays for once per fourfold growth. Markers are created only if absent: of
    two writers one publishes first, the other merges its batch into that version.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.keys, self.bucket_rows = spark, path.rstrip("/"), list(keys), bucket_rows
        self.ready = Markers(spark, self.path)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _folder(self, name: str, bucket: int) -> str:
        return f"{self.path}/rows-{name}/{_BUCKET}={bucket}"

    def marker(self) -> dict[str, Any] | None:
        return self.ready.latest()

    def count(self) -> int:
        last = self.marker()
        return sum(b["rows"] for b in last["buckets"]) if last else 0

    def files(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket of a version, by default the latest."""
        last = self.ready.read(version) if version else self.marker()
        return {b["bucket"]: self._folder(b["segment"], b["bucket"]) for b in last["buckets"]} if last else {}

    def _rows(self, marker: dict[str, Any], buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(marker["schema"])
        folders = [self._folder(b["segment"], b["bucket"]) for b in marker["buckets"] if buckets is None or b["bucket"] in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        marker = self.ready.read(version) if version else self.marker()
        return self._rows(marker) if marker else None

    def _write(self, rows: DataFrame, buckets: int) -> list[dict[str, Any]]:
        """A new folder of buckets; equal buckets meet in one task, which holds one bucket at a time on disk."""
        name = uuid.uuid4().hex
        dealt = rows.withColumn(_BUCKET, self._bucket(buckets)).repartition(F.col(_BUCKET))
        folder = f"{self.path}/rows-{name}"
        dealt.write.partitionBy(_BUCKET).parquet(folder)
        schema = T.StructType([*rows.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        sizes = self.spark.read.schema(schema).parquet(folder).groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n"))
        return [{"bucket": r[_BUCKET], "segment": name, "rows": r["n"]} for r in sizes.collect()]  # one row per bucket

    def _first(self, source: DataFrame) -> dict[str, Any]:
        rows = source.count()
        buckets = 1 << max(0, -(-rows // self.bucket_rows) - 1).bit_length()
        return {"count": buckets, "buckets": self._write(source, buckets), "schema": source.schema.jsonValue()}

    def _next(self, last: dict[str, Any], source: DataFrame) -> dict[str, Any]:
        buckets, schema = last["count"], T.StructType.fromJson(last["schema"])
        source = conformed(source, schema)
        hit = {r[0] for r in source.select(self._bucket(buckets)).distinct().collect()}  # bounded by the buckets
        merged = merge(self._rows(last, hit), source, self.keys, keep_absent=True).select(*schema.fieldNames())
        kept = [b for b in last["buckets"] if b["bucket"] not in hit]
        out = {"count": buckets, "buckets": [*kept, *self._write(merged, buckets)], "schema": last["schema"]}
        if sum(b["rows"] for b in out["buckets"]) > 2 * buckets * self.bucket_rows:
            out = {"count": 4 * buckets, "buckets": self._write(self._rows(out), 4 * buckets), "schema": last["schema"]}
        return out

    def _publish(self, build: Callable[[dict | None], dict[str, Any]]) -> int:
        for _ in range(ATTEMPTS):
            last = self.ready.latest()
            marker = {**build(last), "version": last["version"] + 1 if last else 1, "keys": self.keys}
            if self.ready.publish(marker):
                return marker["version"]
        raise RuntimeError(f"no free version in {ATTEMPTS} attempts")

    def upsert(self, batch: DataFrame, order: str | None = None) -> int | None:
        """Publishes the table with the batch merged in; None, and no version, for an empty batch.

        With `order` the last row of a key wins, without it a repeated key is an error. NULL keys are one key. Columns
        that the batch lacks keep their values in replaced rows and are missing in new ones.
        """
        latest = one_row_per_key(batch, self.keys, order)
        known = self.marker()
        if order and (known is None or order not in T.StructType.fromJson(known["schema"]).fieldNames()):
            latest = latest.drop(order)
        latest = written(latest)
        if not latest.limit(1).collect():
            return None
        return self._publish(lambda last: self._next(last, latest) if last else self._first(latest))

    def update(self, column: str, values: Sequence[Any], conditions: Sequence[str | Column]) -> int | None:
        """An ordered CASE on one column; only buckets with a row that a condition picks are rewritten, None if none is."""
        from riskloom.sources.tables import update_column

        if column in self.keys:
            raise ValueError("a key column decides the bucket of its row and is not updated")
        if not values or self.marker() is None:
            return None

        def build(last: dict | None) -> dict[str, Any]:
            rows = self._rows(last)
            picked = rows.where(F.coalesce(_any(conditions), F.lit(False)))
            hit = {r[0] for r in picked.select(self._bucket(last["count"])).distinct().collect()}
            changed = update_column(self._rows(last, hit), column, values, conditions).withColumn(column, F.col(column).cast(rows.schema[column].dataType))
            kept = [b for b in last["buckets"] if b["bucket"] not in hit]
            return {**last, "buckets": [*kept, *(self._write(changed, last["count"]) if hit else [])]}

        return self._publish(build)


def _any(conditions: Sequence[str | Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False))
    return out
