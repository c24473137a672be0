"""Repeatable splits and samples. Rows are compared with a cut value; nothing is sorted as a whole
and no side is materialised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import fold_of, row_hash
from riskloom.plans.frames import is_fractional, numeric_columns
from riskloom.plans.ranking import cuts, first_rows_flag, not_after

Pair = tuple[DataFrame, DataFrame]


def _hashed(df: DataFrame, key: str, seed: int, method: str) -> tuple[DataFrame, list[str]]:
    """Order columns (hash, tie-breaker) for a key of any type."""
    tie = F.col(key) if key in numeric_columns(df) and not is_fractional(df, key) else row_hash(key, seed + 1)
    return df.withColumns({"__h0": row_hash(key, seed, method), "__h1": tie}), ["__h0", "__h1"]


def _share(size: float):
    return lambda total: F.ceil(total.cast("double") * F.lit(float(size))).cast("long")


def _part(df: DataFrame, flag: str) -> Pair:
    return df.where(~F.col(flag)).drop(flag, "__h0", "__h1"), df.where(F.col(flag)).drop(flag, "__h0", "__h1")


def group_split(
    df: DataFrame, identifier: str, test_size: float = 0.3, seed: int = 5, method: str = "xxhash", exact: bool = True
) -> Pair:
    """Train and test without an identifier on both sides.

    `exact` puts ceil(test_size * ids) identifiers into test; otherwise a hash threshold gives
    that share in expectation from the scan alone. Rows without an identifier are one group, which `exact`
    leaves in train.
    """
    if not exact:
        top = 2**52 if method == "xxhash" else 2**31 - 1
        chosen = row_hash(identifier, seed, method) < int(test_size * top)
        return df.where(~chosen), df.where(chosen)
    ids, order = _hashed(df.select(identifier).where(F.col(identifier).isNotNull()).distinct(), identifier, seed, method)
    row = cuts(ids, order, _share(test_size)).first()
    rows, _ = _hashed(df, identifier, seed, method)
    in_test = not_after(order, lambda i: F.lit(row[f"__cut{i}"])) if row else F.lit(False)
    known = F.col(identifier).isNotNull() & F.coalesce(in_test, F.lit(False))
    return _part(rows.withColumn("__test", known), "__test")


def random_split(df: DataFrame, key: str, test_size: float = 0.3, seed: int = 100, method: str = "xxhash") -> Pair:
    """ceil(test_size * rows) rows go to test, chosen by the hash of a unique key."""
    rows, order = _hashed(df, key, seed, method)
    return _part(first_rows_flag(rows, order, _share(test_size), name="__test"), "__test")


def split_target(df: DataFrame, target: str) -> Pair:
    """Features and target as two frames of the same rows."""
    return df.drop(target), df.select(target)


def train_val_test_split(
    df: DataFrame, key: str, test_size: float = 0.1, val_size: float = 0.1, seed: int = 100, method: str = "xxhash"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test first, then round(val_size / (1 - test_size), 2) of the rest as validation."""
    rest, test = random_split(df, key, test_size, seed, method)
    train, val = random_split(rest, key, round(val_size / (1 - test_size), 2), seed + 1, method)
    return train, val, test


def ordered_split(df: DataFrame, order: Sequence[str], test_size: float = 0.3) -> Pair:
    """The last ceil(test_size * rows) rows in the given order are test. `order` identifies a row."""
    keys = {f"__t{i}": _sortable(df, c) for i, c in enumerate(order)}
    rows = df.withColumns(keys)
    head = lambda total: total - F.ceil(total.cast("double") * F.lit(float(test_size))).cast("long")
    flagged = first_rows_flag(rows, list(keys), head, name="__train").drop(*keys)
    return flagged.where("__train").drop("__train"), flagged.where("NOT __train").drop("__train")


def ordered_train_val_test_split(
    df: DataFrame, order: Sequence[str], test_size: float = 0.1, val_size: float = 0.1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    rest, test = ordered_split(df, order, test_size)
    train, val = ordered_split(rest, order, round(val_size / (1 - test_size), 2))
    return train, val, test


def date_split(df: DataFrame, order: Sequence[str], ratio: float = 0.7) -> Pair:
    """The first int(rows * ratio) rows in date order are train."""
    keys = {f"__t{i}": _sortable(df, c) for i, c in enumerate(order)}
    head = lambda total: F.floor(total.cast("double") * F.lit(float(ratio))).cast("long")
    flagged = first_rows_flag(df.withColumns(keys), list(keys), head, name="__train").drop(*keys)
    return flagged.where("__train").drop("__train"), flagged.where("NOT __train").drop("__train")


def _sortable(df: DataFrame, column: str) -> Column:
    if column in numeric_columns(df):
        return F.col(column)
    return F.unix_micros(F.col(column).cast("timestamp"))


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42, method: str = "xxhash"
) -> Pair:
    """ceil(test_size * rows) rows of every label go to test."""
    rows, order = _hashed(df, key, seed, method)
    return _part(first_rows_flag(rows, order, _share(test_size), [label], "__test"), "__test")


def stratified_sample(
    df: DataFrame, label: str, key: str, rows_per_label: int, seed: int = 42, method: str = "xxhash"
) -> DataFrame:
    """`rows_per_label` rows of every label (all rows of a smaller one), repeatable by key hash."""
    rows, order = _hashed(df, key, seed, method)
    wanted = lambda total: F.least(total, F.lit(rows_per_label))
    return _part(first_rows_flag(rows, order, wanted, [label], "__pick"), "__pick")[1]


def with_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42, method: str = "xxhash") -> DataFrame:
    return df.withColumn("fold", fold_of(key, folds, seed, method))


def borderline_sample(
    df: DataFrame, metric: str, key: str, low: float = 0.85, high: float = 1.15, rows: int = 1, seed: int = 42, method: str = "xxhash"
) -> DataFrame:
    """A few rows whose metric is close to the decision line."""
    near = df.where(F.col(metric).between(low, high)).withColumn("__h", row_hash(key, seed, method))
    return near.orderBy("__h", key).limit(rows).drop("__h")
