"""Column profiles, counts, cross-tabs, correlations, histograms and summaries as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import row_hash
from riskloom.plans.frames import attach, digest_long, numeric_columns, share, string_columns, unpivot
from riskloom.plans.ranking import quantiles


def classes_of(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a class column: the names of the columns a wide result gets, one per class."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def column_profile(df: DataFrame, digits: int = 2) -> DataFrame:
    """Type, missing count, missing percentage and distinct count (missing counts as a value)."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    counts = unpivot(df, df.columns).groupBy("feature", digest_long("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    found = counts.groupBy("feature").agg(
        missing.alias("missing_count"),
        share(missing, F.sum("n"), digits).alias("missing_pct"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    out = found.select("feature", types[F.col("feature")].alias("dtype"), "missing_count", "missing_pct", "n_unique")
    return out.orderBy(F.desc("missing_count"), F.desc("n_unique"), "feature")


def class_balance(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Count and percentage of every value, missing included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", share(F.col("count"), total, digits)).orderBy(F.desc("count"), column)


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, probs: Sequence[float] = (0.05, 0.5, 0.95)
) -> DataFrame:
    """Count, mean, standard deviation, minimum, percentiles and maximum, one row per column."""
    columns = list(columns or numeric_columns(df))
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(
        *[
            F.struct(F.lit(c).alias("feature"), *[fn(F.col(c).cast("double")).alias(n) for n, fn in stats.items()]).alias(f"__s{i}")
            for i, c in enumerate(columns)
        ]
    )
    table = wide.select(F.inline(F.array(*[f"__s{i}" for i in range(len(columns))])))
    names = {f"q{i}": f"p{p * 100:g}".replace(".", "_") for i, p in enumerate(probs)}
    points = quantiles(df, columns, probs).withColumnsRenamed(names)
    return attach(table, points, ["feature"])


def rate_by_group(df: DataFrame, column: str, label: str, digits: int = 3) -> DataFrame:
    """Count and mean of a 0/1 label per group, highest rate first."""
    value = F.col(label).cast("int")
    out = df.groupBy(column).agg(F.count(value).alias("count"), F.round(F.avg(value), digits).alias("loss_rate"))
    return out.orderBy(F.desc("loss_rate"), F.desc("count"), column)


def value_counts(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 0, digits: int = 1
) -> DataFrame:
    """(feature, value, count, pct) of categorical columns; missing values are not counted."""
    columns = list(columns or string_columns(df))
    counts = (
        unpivot(df, columns).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy("feature").agg(F.sum("count").alias("__total"))
    out = attach(counts, totals, ["feature"]).select(
        "feature", "value", "count", share(F.col("count"), F.col("__total"), digits).alias("pct")
    )
    if top_n:
        rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("count"), "value"))
        out = out.withColumn("__rank", rank).where(F.col("__rank") <= top_n).drop("__rank")
    return out


def top_by(df: DataFrame, measure: str, n: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """Rows with the highest measure; n = 0 keeps all."""
    ordered = df.orderBy(F.desc(measure), *tie)
    return ordered.limit(n) if n else ordered


def class_counts(df: DataFrame, target: str, features: Sequence[str] | None = None, missing: str = "NA") -> DataFrame:
    """(feature, value, class, count) for any number of classes: the cross-tab in long form; missing classes are left out."""
    features = list(features or [c for c in string_columns(df) if c != target])
    long = unpivot(df.where(F.col(target).isNotNull()), features, [F.col(target).alias("class")])
    return long.groupBy("feature", F.coalesce("value", F.lit(missing)).alias("value"), "class").agg(F.count(F.lit(1)).alias("count"))


def crosstab(
    df: DataFrame, target: str, features: Sequence[str] | None = None, missing: str = "NA"
) -> DataFrame:
    """Counts per feature value and target class, one column per class; `class_counts` has them as rows."""
    features = list(features or [c for c in string_columns(df) if c != target])
    classes = classes_of(df, target)
    long = unpivot(df, features, [F.col(target).alias("__target")]).withColumn("value", F.coalesce("value", F.lit(missing)))
    counts = long.groupBy("feature", "value").agg(
        *[F.count_if(F.col("__target") == F.lit(c)).alias(str(c)) for c in classes]
    )
    return counts


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(row_feature, column_feature, correlation) over pairwise complete rows; NaN is missing.

    One pass takes the means, one the sums of products around them: a task keeps six columns x columns
    matrices, so the plan does not grow with the pairs. NULL where fewer than two rows hold both
    columns or one of them is constant there.
    """
    columns = sorted(columns or numeric_columns(df))
    d = len(columns)
    numbers = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(f"c{i}") for i in range(d)]).first()
    centre = np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])
    at = {"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d)}

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, d, d))
        for pdf in batches:
            x = pdf.to_numpy(float) - centre
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x, 0.0)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        n, s, squares, xy = total
        cells = {"n": n, "sx": s, "sy": s.T, "sxx": squares, "syy": squares.T, "sxy": xy}
        yield pd.DataFrame(at | {name: m.ravel() for name, m in cells.items()})

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = numbers.mapInPandas(products, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    n, sx, sy, sxx, syy, sxy = map(F.col, names)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # what rounding leaves of a constant column is no variance
    varies = (n > 1) & (vx > n * sxx * 1e-12) & (vy > n * syy * 1e-12)
    named = F.array(*map(F.lit, columns))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).select(
        F.element_at(named, F.col("i") + 1).alias("row_feature"),
        F.element_at(named, F.col("j") + 1).alias("column_feature"),
        F.when(varies, (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy))).alias("correlation"),
    )


# Quantiles 0.05 to 0.90 in steps of 0.05.
QUANTILE_GRID = [round(0.05 * i, 2) for i in range(1, 19)]


def group_quantiles(df: DataFrame, column: str, group: str, probs: Sequence[float] = QUANTILE_GRID) -> DataFrame:
    """(group, quantile, value): exact interpolated quantiles of a column in every group."""
    wide = quantiles(df.where(F.col(group).isNotNull()), [column], probs, [group])
    cells = [F.struct(F.lit(p).alias("quantile"), F.col(f"q{i}").alias("value")) for i, p in enumerate(probs)]
    return wide.select(group, F.inline(F.array(*cells)))


def _number(column: str) -> Column:
    """The column as double, NaN being missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.min(_number(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(_number(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None}


def _bin_number(column: str, low: float, high: float, bins: int) -> Column:
    width = (high - low) / bins
    if width == 0:
        return F.when(_number(column).isNotNull(), F.lit(0))
    raw = F.floor((_number(column) - low) / F.lit(width))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30, target: str | None = None
) -> DataFrame:
    """(feature, [target,] bin, low, high, count) of equal-width bins; the last bin is closed. Empty
    bins are not listed."""
    columns = list(columns or numeric_columns(df))
    ranges = _ranges(df, columns)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            _bin_number(c, lo, hi, bins).alias("bin"),
            F.lit(lo).alias("__low"),
            F.lit((hi - lo) / bins).alias("__width"),
        )
        for c, (lo, hi) in ranges.items()
    ]
    by = [target] if target else []
    counts = (
        df.select(*by, F.inline(F.array(*cells)))
        .where("bin IS NOT NULL")
        .groupBy("feature", *by, "bin", "__low", "__width")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    low = F.col("__low") + F.col("bin") * F.col("__width")
    return counts.select("feature", *by, "bin", low.alias("low"), (low + F.col("__width")).alias("high"), "count")


def density(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    target: str | None = None,
    grid: int = 200,
    bins: int = 512,
    cut: float = 3.0,
) -> DataFrame:
    """(feature, [target,] x, density): Gaussian kernel curve with bandwidth n^(-1/5) * std.

    Rows are first reduced to `bins` equal cells (their counts and means), so the curve costs
    grid x bins whatever the number of rows; each class is normalised on its own.
    """
    columns = list(columns or numeric_columns(df))
    by = [target] if target else []
    ranges = _ranges(df, columns)
    cells = [
        F.struct(F.lit(c).alias("feature"), _bin_number(c, lo, hi, bins).alias("bin"), F.col(c).cast("double").alias("v"))
        for c, (lo, hi) in ranges.items()
    ]
    binned = (
        df.select(*by, F.inline(F.array(*cells)))
        .where("bin IS NOT NULL")
        .groupBy("feature", *by, "bin")
        .agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    )
    # at most `bins` rows per curve by construction
    curve = binned.groupBy("feature", *by).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("ss").alias("ss"),
        F.collect_list(F.struct("n", "m")).alias("cells"),
    )
    spread = F.sqrt((F.col("ss") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1))
    curve = curve.where("n > 1").withColumn("h", spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).where("h > 0")
    low, high = F.col("lo") - cut * F.col("h"), F.col("hi") + cut * F.col("h")
    points = curve.select(
        "feature", *by, "n", "h", "cells",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: low + i * (high - low) / (grid - 1))).alias("x"),
    )
    kernel = F.aggregate(
        "cells",
        F.lit(0.0),
        lambda acc, c: acc + c["n"] * F.exp(-0.5 * F.pow((F.col("x") - c["m"]) / F.col("h"), F.lit(2.0))),
    )
    return points.select("feature", *by, "x", (kernel / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def box_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR) and outlier counts per column."""
    columns = list(columns or numeric_columns(df))
    box = {r["feature"]: (r["q0"], r["q1"], r["q2"]) for r in quantiles(df, columns, [0.25, 0.5, 0.75]).collect()}
    aggs = []
    for i, (c, (q1, q2, q3)) in enumerate(box.items()):
        x = F.col(c).cast("double")
        inside = x.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.min(x).alias("min"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
                F.max(x).alias("max"),
                F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
                F.count_if(~inside).alias("outliers"),
            ).alias(f"__s{i}")
        )
    return df.agg(*aggs).select(F.inline(F.array(*[f"__s{i}" for i in range(len(aggs))])))


_FUNCTIONS = {"count": F.count, "mean": F.avg, "min": F.min, "max": F.max}


def over_time(
    df: DataFrame, ts: str, columns: Sequence[str] | None = None, function: str = "count", unit: str | None = None
) -> DataFrame:
    """One aggregate of numeric columns per time value, or per truncated time when `unit` is given."""
    if function not in _FUNCTIONS:
        raise ValueError(f"function must be one of {sorted(_FUNCTIONS)}")
    columns = list(columns or [c for c in numeric_columns(df) if c != ts])
    bucket = F.date_trunc(unit, F.col(ts).cast("timestamp")) if unit else F.col(ts)
    return df.groupBy(bucket.alias(ts)).agg(*[_FUNCTIONS[function](c).alias(c) for c in columns])


def scatter_sample(
    df: DataFrame, columns: Sequence[str], key: str, rows: int = 5000, seed: int = 0, method: str = "xxhash"
) -> DataFrame:
    """A repeatable sample of at most `rows` rows for plotting."""
    picked = df.select(key, *columns, row_hash(key, seed, method).alias("__h"))
    return picked.orderBy("__h", key).limit(rows).drop("__h")


def distinct_keys(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(F.col(key))
    return df.agg(count.alias("distinct_keys"))
