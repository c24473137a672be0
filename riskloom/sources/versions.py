"""Versioned datasets: every batch is a new folder, published by a marker that is created only if absent."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.sources.publication import Markers

_SEGMENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("version", T.IntegerType())])
_READY = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("document_count", T.LongType()),
        T.StructField("segments", T.ArrayType(_SEGMENT)),
    ]
)
#: So many segments of one size class become one; a class is a power of this in rows.
FAN = 8
ATTEMPTS = 50
_SEGMENT_COLUMN = "__segment"


@dataclass
class Side:
    """Rows derived from a segment (its frame and row count) and kept beside it, and what they are partitioned by."""

    make: Callable[[DataFrame, int], DataFrame]
    partition_by: list[str] = field(default_factory=list)


class VersionedTable:
    """`<path>/rows/` holds a folder of rows per segment, `<path>/_ready/` one marker per version, written last.

    A marker names the row count and the segments that make up its version, so appending a batch costs the batch, not
    the store. Segments of like size are merged when there are `FAN` of them: a row is rewritten about log(rows) times
    and a version never has more than `FAN` segments per power of `FAN`. Readers see the newest marked version only; what
    a failed or overtaken writer left has no marker and is not read. Old versions stay.

    Two writers of one version never overwrite one another: the later finds the number taken, looks at the version that
    took it and publishes the next one on top of it.
    """

    def __init__(self, spark: SparkSession, path: str, sides: Mapping[str, Side] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.sides = dict(sides or {})
        self.ready = Markers(spark, self.path)

    def markers(self) -> DataFrame:
        """(version, document_count, segments) of published versions; segments as the versions that wrote them."""
        try:
            found = self.spark.read.schema(_READY).json(f"{self.path}/_ready")
        except AnalysisException:
            found = self.spark.createDataFrame([], _READY)
        return found.select("version", "document_count", F.col("segments.version").alias("segments"))

    def latest_version(self) -> int | None:
        found = self.ready.versions()
        return found[-1] if found else None

    def _marker(self, version: int | None = None) -> dict[str, Any] | None:
        if version is None:
            return self.ready.latest()
        if version not in self.ready.versions():
            raise ValueError(f"version {version} is not published")
        return self.ready.read(version)

    def _folder(self, name: str, side: str = "rows") -> str:
        return f"{self.path}/{side}/{_SEGMENT_COLUMN}={name}"

    def _load(self, names: Sequence[str], schema: dict, side: str = "rows") -> DataFrame:
        wide = T.StructType([*T.StructType.fromJson(schema).fields, T.StructField(_SEGMENT_COLUMN, T.StringType())])
        reader = self.spark.read.schema(wide).option("basePath", f"{self.path}/{side}")
        return reader.parquet(*[self._folder(n, side) for n in names]).drop(_SEGMENT_COLUMN)

    def read(self, version: int | None = None, side: str = "rows") -> DataFrame | None:
        """The rows of a published version, by default the latest, or a side's; None when there is none."""
        marker = self._marker(version)
        if marker is None or side not in marker["schemas"]:
            return None
        return self._load([s["name"] for s in marker["segments"]], marker["schemas"][side], side)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Publish the frame alone as the next version."""
        return self._publish(df, False, partition_by or [])

    def append(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Publish the latest version plus the frame's rows as the next version.

        Columns that only the frame or only older rows have are missing in the others.
        """
        return self._publish(df, True, partition_by or [])

    def _segment(self, df: DataFrame, partition_by: list[str]) -> tuple[dict[str, Any], dict[str, Any]]:
        """A new folder of rows with its sides, and their schemas; nobody reads it before a marker names it."""
        name = f"s{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(self._folder(name)) if partition_by else df.write.parquet(self._folder(name))
        schemas = {"rows": df.schema.jsonValue()}
        stored = self._load([name], schemas["rows"])
        rows = stored.count()  # from the file footers
        for side, how in self.sides.items():
            made = how.make(stored, rows)
            schemas[side] = made.schema.jsonValue()
            made = made.repartition(*how.partition_by) if how.partition_by else made
            made.write.partitionBy(*how.partition_by).parquet(self._folder(name, side))
        return {"name": name, "rows": rows}, schemas

    def _merged(self, segments: list[dict[str, Any]], schema: dict, partition_by: list[str], made: dict[tuple, dict]) -> list[dict[str, Any]]:
        """Segments with every full size class rewritten as one segment; `made` keeps merges over attempts."""
        while True:
            classes: dict[int, list[dict[str, Any]]] = {}
            for s in segments:
                classes.setdefault(int(math.log(max(s["rows"], 1), FAN) + 1e-9), []).append(s)
            full = sorted(c for c, held in classes.items() if len(held) >= FAN)
            if not full:
                return segments
            old = classes[full[0]]
            key = tuple(s["name"] for s in old)
            if key not in made:
                made[key] = self._segment(self._load(key, schema), partition_by)[0]
            segments = [*(s for s in segments if s not in old), made[key]]

    def _publish(self, df: DataFrame, add: bool, partition_by: list[str]) -> int:
        segment, schemas = self._segment(df, partition_by)
        made: dict[tuple, dict] = {}
        for _ in range(ATTEMPTS):
            last = self.ready.latest()
            segments, told = [segment], schemas
            if add and last:
                told = {side: _widened(last["schemas"].get(side, schema), schema) for side, schema in schemas.items()}
                segments = self._merged([*last["segments"], segment], told["rows"], partition_by, made)
            version = last["version"] + 1 if last else 1
            segments = [{"version": version, **s} for s in segments]
            marker = {"version": version, "document_count": sum(s["rows"] for s in segments), "segments": segments, "schemas": told}
            if self.ready.publish(marker):
                return version
        raise RuntimeError(f"no free version in {ATTEMPTS} attempts")


def _widened(old: dict, new: dict) -> dict:
    """The old schema and the columns that only the new one has."""
    known = {f["name"] for f in old["fields"]}
    return {**old, "fields": [*old["fields"], *(f for f in new["fields"] if f["name"] not in known)]}
