"""Small plan helpers shared by all operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def is_fractional(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas has one missing value, Spark two: fold NaN into NULL once, on ingest."""
    cols = [c for c in df.columns if is_fractional(df, c)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch for any timestamp or date column."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def same_keys(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    """Null-safe equi-join condition."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in pairs))


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join `lookup` (unique on `keys`) on equal keys, NULL matching NULL, keys kept once."""
    renamed = lookup.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    joined = df.join(renamed, same_keys(df, renamed, [(k, f"__k_{k}") for k in keys]), how)
    return joined.drop(*[f"__k_{k}" for k in keys])


def written(df: DataFrame) -> DataFrame:
    """Write a frame that many jobs will read to the shared folder and read it back.

    Cuts the lineage, survives lost executors and keeps column pruning for the readers.
    """
    from riskloom.session import shared_folder

    path = shared_folder(df.sparkSession, "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Fix the rows of a fitted table so that later jobs all see the same values.

    The table is computed once and written; its measured size then decides between broadcast and shuffle.
    """
    return written(df)


def unpivot(df: DataFrame, columns: list[str], by: Iterable[str] = (), as_type: str = "string") -> DataFrame:
    """(by..., feature, value) with one row per listed column, in a single pass."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(as_type).alias("value")) for c in columns]
    return df.select(*by, F.inline(F.array(*cells)))


def digest_long(value: str, longest: int = 64) -> Column:
    """The value itself, or its SHA-256 when it is long: counting distinct texts need not shuffle them."""
    text = F.col(value)
    return F.when(F.length(text) > longest, F.sha2(text, 256)).otherwise(text)


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), digits)
