"""Exact order statistics without ever sorting a group in one task.

A value column is cut into buckets of about equal row counts with approximate quantiles (only
the bucket edges are approximate). Equal values are counted before any shuffle, so a value
held by a third of all rows costs one row per map task. Ranks then need only the bucket
totals: `before = rows in lower buckets + rows below me in my bucket`. A hot group is spread
over as many tasks as there are buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.plans.frames import attach, settle, written

#: A group with at most this many distinct values is ranked without buckets: its counted rows fit in any task.
SMALL_ROWS = 20_000


def bucket_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _edges(df: DataFrame, columns: Sequence[str], n: int) -> tuple[list[list[float]], float, bool]:
    """Bucket edges per column, the largest approximate distinct count, and whether a value is two edges, in one pass."""
    probs = [i / n for i in range(1, n)]
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), probs, max(1000, 20 * n)).alias(f"e{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    edges = [sorted({e for e in (row[f"e{i}"] or []) if math.isfinite(e)}) or [0.0] for i in range(len(columns))]
    tied = any(len(set(row[f"e{i}"] or [])) < n - 1 for i in range(len(columns)))
    return edges, max(row[f"d{i}"] for i in range(len(columns))), tied


def with_buckets(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> tuple[DataFrame, bool]:
    """Add `__b_<column>`, a bucket number that never decreases with the column's value.

    Columns with few distinct values need no buckets: a group then has few counted rows. The
    second result tells whether buckets are used.
    """
    return _bucketed(df, columns, buckets)[:2]


def _bucketed(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> tuple[DataFrame, bool, bool]:
    """`with_buckets` and whether a value may hold more rows than a bucket; without buckets it may."""
    n = buckets or bucket_count(df)
    edges, distinct, tied = _edges(df, columns, n)
    if distinct <= SMALL_ROWS and not buckets:
        return df.withColumns({f"__b_{c}": F.lit(0) for c in columns}), False, True
    doubles = df.withColumns({f"__d_{c}": F.col(c).cast("double") for c in columns})
    bucketizer = Bucketizer(
        splitsArray=[[-math.inf, *e, math.inf] for e in edges],
        inputCols=[f"__d_{c}" for c in columns],
        outputCols=[f"__b_{c}" for c in columns],
        handleInvalid="keep",
    )
    # whole numbers: doubles are normalized before each shuffle, which hides that rows already lie by bucket
    whole = {f"__b_{c}": F.col(f"__b_{c}").cast("int") for c in columns}
    return bucketizer.transform(doubles).drop(*[f"__d_{c}" for c in columns]).withColumns(whole), True, tied


def _ranked(counts: DataFrame, group: list[str], measures: Sequence[str], bucketed: bool) -> DataFrame:
    """counts(group..., bucket, value, measures...) plus `before_<m>` and `total_<m>`."""
    zero = F.lit(0)
    if not bucketed:
        whole = Window.partitionBy(*group)
        below = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            "*",
            *[F.coalesce(F.sum(m).over(below), zero).alias(f"before_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
        )
    sizes = counts.groupBy(*group, "bucket").agg(*[F.sum(m).alias(f"__s_{m}") for m in measures])
    # one row per group and bucket: a group has at most as many rows as there are buckets
    whole = Window.partitionBy(*group)
    lower = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group,
        "bucket",
        *[F.coalesce(F.sum(f"__s_{m}").over(lower), zero).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__s_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    below = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    joined = attach(counts, offsets, [*group, "bucket"])
    return joined.withColumns(
        {f"before_{m}": F.col(f"__o_{m}") + F.coalesce(F.sum(m).over(below), zero) for m in measures}
    ).drop(*[f"__o_{m}" for m in measures])


def _ranked_near(rows: DataFrame, group: list[str], wanted: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """rows(group..., bucket, value) as group..., value, n, before_n and total_n of those buckets that hold a wanted rank.

    `wanted` gets the rows before a bucket, the rows in it and the rows of the group. Rows of other buckets are only counted,
    not shuffled. Where very many buckets are wanted all values are ranked.
    """
    sizes = rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("__s"))
    # one row per group and bucket
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__s").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.withColumns({"__o": before, "total_n": F.sum("__s").over(whole)})
    near = settle(spans.where(wanted(F.col("__o"), F.col("__s"), F.col("total_n"))).drop("__s"))
    if near.count() > SMALL_ROWS:
        counts = rows.groupBy(*group, "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
        return _ranked(counts, group, ["n"], True).drop("bucket")
    kept = attach(rows, F.broadcast(near), [*group, "bucket"], "inner")
    counts = kept.groupBy(*group, "bucket", "__o", "total_n", "value").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before_n", F.col("__o") + F.coalesce(F.sum("n").over(below), F.lit(0))).drop("bucket", "__o")


def value_ranks(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    measures: dict[str, Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct non-missing value of `column` in each group.

    Columns: by..., value, n, before_n, total_n and the same three for every extra measure.
    """
    extra = measures or {}
    rows, bucketed = with_buckets(df.where(F.col(column).isNotNull()), [column], buckets)
    counts = rows.groupBy(*by, F.col(f"__b_{column}").alias("bucket"), F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(name) for name, m in extra.items()]
    )
    return _ranked(counts, list(by), ["n", *extra], bucketed).drop("bucket")


def column_ranks(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    buckets: int | None = None,
    wanted: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """`value_ranks` for many numeric columns in one job; the column name is in `feature`.

    With `wanted` (see `_ranked_near`) at least the values of the buckets that hold a wanted rank.
    """
    wide, bucketed = with_buckets(df, columns, buckets)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"__b_{c}").alias("bucket"),
            F.col(c).cast("double").alias("value"),
        )
        for c in columns
    ]
    rows = wide.select(*by, F.inline(F.array(*cells))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    if wanted and bucketed:
        return _ranked_near(rows, [*by, "feature"], wanted)
    counts = rows.groupBy(*by, "feature", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    return _ranked(counts, [*by, "feature"], ["n"], bucketed).drop("bucket")


def _at(rank: Column) -> Column:
    inside = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
    return F.max(F.when(inside, F.col("value").cast("double")))


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles: by..., feature, q0, q1, ... in the order of `probs`."""
    def wanted(before: Column, n: Column, total: Column) -> Column:
        spots = [f((total - 1) * F.lit(float(p))) for p in probs for f in (F.floor, F.ceil)]
        return reduce(lambda a, b: a | b, ((before <= x) & (x < before + n) for x in spots), F.lit(False))

    ranks = column_ranks(df, columns, by, wanted=wanted)
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("total_n") - 1) * F.lit(float(p))
        picks += [
            _at(F.floor(pos)).alias(f"__lo{i}"),
            _at(F.ceil(pos)).alias(f"__hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"__w{i}"),
        ]
    found = ranks.groupBy(*by, "feature").agg(*picks)
    return found.select(
        *by,
        "feature",
        *[
            (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__w{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = {r["feature"]: r["q0"] for r in quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(c) for c in columns}


def cuts(
    df: DataFrame, order: Sequence[str], k: Callable[[Column], Column], by: Sequence[str] = ()
) -> DataFrame:
    """Order key of the k-th row of each group, k counted from 1 and derived from the group size.

    Columns by..., `__cut0`, `__cut1`, ... (one per order column; NULL when the columns before it
    already separate the rows). Groups with k < 1 have no row. Only rows tied on the leading order
    columns are looked at again for the next one, so no group is ever sorted as a whole. The order
    columns must be numeric and identify a row.
    """
    first, *rest = order
    rows, bucketed = with_buckets(df.where(F.col(first).isNotNull()), [first])
    rows = rows.select(*by, F.col(f"__b_{first}").alias("bucket"), F.col(first).alias("value"))
    if bucketed:
        ranks = _ranked_near(rows, list(by), lambda before, n, total: (before < k(total)) & (k(total) <= before + n))
    else:
        ranks = _ranked(rows.groupBy(*by, "bucket", "value").agg(F.count(F.lit(1)).alias("n")), list(by), ["n"], False)
    ranks = ranks.withColumn("__k", k(F.col("total_n")))
    hit = ranks.where((F.col("before_n") < F.col("__k")) & (F.col("__k") <= F.col("before_n") + F.col("n")))
    # one row per group; fixed so that later jobs do not rank again
    found = settle(
        hit.select(
            *by,
            F.col("value").alias("__cut0"),
            (F.col("__k") - F.col("before_n")).alias("__left"),
            (F.col("__k") < F.col("before_n") + F.col("n")).alias("__split"),
        )
    )
    if not rest or not found.where("__split").limit(1).collect():
        kinds = {c: df.schema[c].dataType for c in rest}
        blank = {f"__cut{i + 1}": F.lit(None).cast(kinds[c]) for i, c in enumerate(rest)}
        out = found.drop("__left", "__split")
        return out.withColumns(blank) if blank else out
    found = found.drop("__split")
    tied = attach(df, found, list(by), "inner") if by else df.join(found, df[first] == found["__cut0"])
    tied = tied.where(F.col(first) == F.col("__cut0"))
    inner = cuts(
        tied.withColumnsRenamed({"__cut0": "__lead", "__left": "__want"}),
        rest,
        lambda _total: F.col("__want"),
        [*by, "__lead", "__want"],
    )
    later = [F.col(f"__cut{i}").alias(f"__cut{i + 1}") for i in range(len(rest))]
    return inner.select(*by, F.col("__lead").alias("__cut0"), *later)


def not_after(order: Sequence[str], cut: Callable[[int], Column]) -> Column:
    """Lexicographic `order <= cut`; a NULL cut after the first admits every row."""
    last = len(order) - 1
    cond = F.col(order[last]) <= cut(last)
    for i in range(last - 1, -1, -1):
        cond = (F.col(order[i]) < cut(i)) | ((F.col(order[i]) == cut(i)) & F.coalesce(cond, F.lit(True)))
    return F.coalesce(cond, F.lit(False))


def first_rows_flag(
    df: DataFrame, order: Sequence[str], k: Callable[[Column], Column], by: Sequence[str] = (), name: str = "__first"
) -> DataFrame:
    """Flag the first k rows of each group in the given order; a filter, not a sort."""
    found = cuts(df, order, k, by)
    if not by:
        row = found.first()
        if row is None:
            return df.withColumn(name, F.lit(False))
        return df.withColumn(name, not_after(order, lambda i: F.lit(row[f"__cut{i}"])))
    joined = attach(df, found, list(by))
    flagged = joined.withColumn(name, not_after(order, lambda i: F.col(f"__cut{i}")))
    return flagged.drop(*[f"__cut{i}" for i in range(len(order))])


def bucket_areas(df: DataFrame, column: str, by: Sequence[str], pos: Column, neg: Column) -> DataFrame:
    """by..., pos, neg, area: Mann-Whitney counts of `pos` rows above `neg` rows in the order of `column`, ties half.

    Each bucket is added up by itself; lower buckets enter by their totals, so values are ranked inside their bucket only.
    Where no value fills a bucket, rows are shuffled once, to their bucket; else equal values are counted before.
    """
    rows, _, tied = _bucketed(df.where(F.col(column).isNotNull()), [column])
    rows = rows.select(*by, F.col(f"__b_{column}").alias("bucket"), F.col(column).alias("value"), pos.alias("__pos"), neg.alias("__neg"))
    rows = rows if tied else rows.repartition(*by, "bucket")
    counts = rows.groupBy(*by, "bucket", "value").agg(F.sum("__pos").alias("pos"), F.sum("__neg").alias("neg"))
    below = Window.partitionBy(*by, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("__below", F.coalesce(F.sum("neg").over(below), F.lit(0)).cast("double") + F.col("neg") / 2.0)
    parts = inside.groupBy(*by, "bucket").agg(F.sum(F.col("pos") * F.col("__below")).alias("__area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # one row per group and bucket
    lower = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(lower), F.lit(0)).cast("double")
    whole = parts.withColumn("__area", F.col("__area") + F.col("pos") * before)
    return whole.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("__area").alias("area"))


def dense_numbers(df: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """`df` with consecutive numbers in the order of `key`, a unique column of any orderable type.

    Rows are range-partitioned by the key and written once; numbers are the place inside the partition
    plus the rows of the partitions before it, so no task sorts more than one partition.
    """
    parts = written(df.repartitionByRange(bucket_count(df), key).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    lower = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    numbered = parts.withColumn("__place", place).join(F.broadcast(offsets), "__part")
    number = (F.col("__offset") + F.col("__place") + (start - 1)).cast("long")
    return numbered.withColumn(name, number).drop("__part", "__place", "__offset")


__all__ = [
    "bucket_areas", "bucket_count", "column_ranks", "cuts", "dense_numbers", "first_rows_flag", "medians",
    "not_after", "quantiles", "value_ranks", "with_buckets",
]
