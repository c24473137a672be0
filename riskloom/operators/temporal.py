"""Time features and rolling windows per entity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.plans.frames import micros

DAY = 86_400_000_000
CELLS = 256


@dataclass(frozen=True)
class Span:
    """A trailing window `[t - length, t - lag]` in microseconds; the old end may be open."""

    length: int
    lag: int = 0
    open_start: bool = False


def _cell_width(spans: Sequence[Span]) -> int:
    """A width that divides every window end and cuts the shortest window into CELLS cells or more."""
    width = math.gcd(*[s.length for s in spans], *[s.lag for s in spans])
    while min(s.length for s in spans) // width < CELLS and width % 2 == 0:
        width //= 2
    return width


def _instants(df: DataFrame, entity: str, ts: str, value: str | None, order: str | None) -> DataFrame:
    """One row per (entity, instant): simultaneous rows are added up before any window runs."""
    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    if value:
        v = F.when(~F.isnan(v), v)
    aggs = [F.count(F.lit(1)).alias("n"), F.count(v).alias("nv"), F.sum(v).alias("sv")]
    if order:
        aggs.append(F.min_by(v, F.col(order)).alias("first_v"))
    return (
        df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(entity).alias("id"), micros(ts).alias("t"))
        .agg(*aggs)
    )


_KINDS = {"n": "long", "nv": "long", "sv": "double"}


def window_totals(
    df: DataFrame,
    entity: str,
    ts: str,
    value: str | None,
    spans: Sequence[Span],
    measures: Sequence[str] = ("n", "nv", "sv"),
    order: str | None = None,
) -> DataFrame:
    """(id, t, <measure>_<span number>...): row count, value count and value sum per window.

    Time is cut into cells. A window is the end part of its newest cell, a run of whole cells
    and the start part of its oldest cell. Both partial cells are growing sums inside one
    (entity, cell) partition and the whole cells come from cell totals, so the cost is linear in
    the rows even for dense windows and one hot entity is spread over all its cells. No sum is
    ever subtracted from another, so no precision is lost. All spans share one pass.
    """
    width = _cell_width(spans)
    inst = _instants(df, entity, ts, value, order).withColumn("cell", F.floor(F.col("t") / width).cast("long"))
    lags = sorted({s.lag for s in spans})
    starts = sorted({(s.length, s.open_start) for s in spans})
    columns = [f"new{i}_{m}" for i in range(len(lags)) for m in measures]
    columns += [f"old{i}_{m}" for i in range(len(starts)) for m in measures]
    columns += [f"mid{i}_{m}" for i in range(len(spans)) for m in measures]

    def row(cell, probe=None, rising=None, falling=None, **filled: Column) -> Column:
        fixed = {"cell": cell, "probe": probe, "rising": rising, "falling": falling}
        cells = [(F.lit(None) if v is None else v).cast("long").alias(k) for k, v in fixed.items()]
        cells += [filled.get(c, F.lit(None)).cast(_KINDS[c.split("_")[1]]).alias(c) for c in columns]
        return F.struct(*cells)

    t, cell = F.col("t"), F.col("cell")

    def own(group: str) -> dict[str, Column]:
        return {f"{group}_{m}": F.col(m) for m in measures}

    pieces = []
    for i, lag in enumerate(lags):
        if lag:
            pieces.append(row(cell + lag // width, rising=t + lag, **own(f"new{i}")))
    pieces.append(row(cell, probe=t, rising=t, falling=t, **(own("new0") if lags[0] == 0 else {})))
    for i, (length, is_open) in enumerate(starts):
        pieces.append(row(cell + length // width, falling=t + length - int(is_open), **own(f"old{i}")))
    parts = inst.select("id", F.inline(F.array(*pieces)))

    totals = inst.groupBy("id", "cell").agg(*[F.sum(m).alias(m) for m in measures])
    by_cell = Window.partitionBy("id").orderBy("cell")
    whole = {}
    for i, s in enumerate(spans):
        if s.length // width - s.lag // width > 1:
            frame = by_cell.rangeBetween(-(s.length // width - 1), -(s.lag // width + 1))
            whole |= {f"mid{i}_{m}": F.sum(m).over(frame) for m in measures}
    middle = totals.select("id", "cell", *[c.alias(n) for n, c in whole.items()])
    first = row(cell, rising=F.lit(-(2**62)), **{n: F.col(n) for n in whole})
    parts = parts.unionByName(middle.select("id", F.inline(F.array(first))))

    up = Window.partitionBy("id", "cell").orderBy(F.col("rising").asc_nulls_last())
    down = Window.partitionBy("id", "cell").orderBy(F.col("falling").desc_nulls_last())
    summed = parts.select(
        "id", "probe", *[F.sum(c).over(down if c.startswith("old") else up).alias(c) for c in columns]
    ).where(F.col("probe").isNotNull())

    out = []
    for i, s in enumerate(spans):
        groups = (f"new{lags.index(s.lag)}", f"mid{i}", f"old{starts.index((s.length, s.open_start))}")
        for m in measures:
            zero = F.lit(0).cast(_KINDS[m])
            out.append(sum((F.coalesce(f"{g}_{m}", zero) for g in groups[1:]), F.coalesce(f"{groups[0]}_{m}", zero)).alias(f"{m}_{i}"))
    result = summed.select("id", F.col("probe").alias("t"), *out)
    if not order:
        return result
    first_only = inst.select(
        "id", "t", F.col("n").alias("own_n"), F.col("nv").alias("own_nv"), F.coalesce("sv", F.lit(0.0)).alias("own_sv"),
        F.lit(1).alias("first_n"), F.col("first_v").isNotNull().cast("long").alias("first_nv"),
        F.coalesce("first_v", F.lit(0.0)).alias("first_sv"),
    )
    return result.join(first_only, ["id", "t"]).select(
        "id",
        "t",
        *[
            (F.col(f"{m}_{i}") - F.col(f"own_{m}") + F.col(f"first_{m}")).alias(f"{m}_{i}")
            for i in range(len(spans))
            for m in measures
        ],
    )


def _attach(df: DataFrame, totals: DataFrame, entity: str, ts: str, outputs: dict[str, Column]) -> DataFrame:
    table = totals.select(F.col("id").alias("__id"), F.col("t").alias("__t"), *[c.alias(n) for n, c in outputs.items()])
    joined = df.join(table, (df[entity] == table["__id"]) & (micros(df[ts]) == table["__t"]), "left")
    return joined.drop("__id", "__t")


def _sum_or_null() -> Column:
    return F.when(F.col("nv_0") > 0, F.col("sv_0"))


def _mean_or_null() -> Column:
    return F.when(F.col("nv_0") > 0, F.col("sv_0") / F.col("nv_0"))


class RollingFeatures:
    """Count, sum and mean of the last n days per entity, both window ends included.

    Rows of one entity at one instant are peers and share one value (`ties="peers"`), or all take
    the value of the first of them in the order of `order_col` (`ties="first"`).
    """

    def __init__(self, timestamp: str, ties: str = "peers", order_col: str | None = None):
        if ties not in ("peers", "first"):
            raise ValueError("ties is 'peers' or 'first'")
        if ties == "first" and not order_col:
            raise ValueError("ties='first' needs order_col")
        self.timestamp = timestamp
        self.order = order_col if ties == "first" else None

    def _run(self, df: DataFrame, identifier: str, value: str | None, delta: int, outputs: dict[str, Column]) -> DataFrame:
        totals = window_totals(df, identifier, self.timestamp, value, [Span(delta * DAY)], order=self.order)
        return _attach(df, totals, identifier, self.timestamp, outputs)

    def count_of_last_n_days(self, df: DataFrame, identifier: str, delta: int) -> DataFrame:
        return self._run(df, identifier, None, delta, {f"count_{identifier}_{delta}d": F.col("n_0")})

    def sum_of_last_n_days(self, df: DataFrame, identifier: str, value: str, delta: int) -> DataFrame:
        return self._run(df, identifier, value, delta, {f"sum_{identifier}_{delta}": _sum_or_null()})

    def mean_of_last_n_days(self, df: DataFrame, identifier: str, value: str, delta: int) -> DataFrame:
        return self._run(df, identifier, value, delta, {f"mean_{identifier}_{delta}d": _mean_or_null()})

    def fit(self, df: DataFrame, identifier: str, value: str, delta: int) -> DataFrame:
        """All three columns from one pass over the windows."""
        return self._run(
            df,
            identifier,
            value,
            delta,
            {
                f"count_{identifier}_{delta}d": F.col("n_0"),
                f"sum_{identifier}_{delta}": _sum_or_null(),
                f"mean_{identifier}_{delta}d": _mean_or_null(),
            },
        )


class RollingWithGrace:
    """Sum over `(t - delta, t - grace]`: the last `delta` days without the last `grace` days."""

    def __init__(self, timestamp: str, grace: int = 30, delta: int = 150):
        if not 0 < grace < delta:
            raise ValueError("grace must lie between 0 and delta")
        self.timestamp, self.grace, self.delta = timestamp, grace, delta

    def sum_of_first_n_days(self, df: DataFrame, identifier: str, value_col: str) -> DataFrame:
        names = {self.grace: f"sum_{identifier}_grace_{self.grace}d"}
        return _grace_sums(df, self.timestamp, identifier, value_col, names, self.delta)


def _grace_sums(
    df: DataFrame, ts: str, entity: str, value: str, names: dict[int, str], delta: int
) -> DataFrame:
    spans = [Span(delta * DAY, grace * DAY, open_start=True) for grace in names]
    totals = window_totals(df, entity, ts, value, spans, ["sv"])
    return _attach(df, totals, entity, ts, {name: F.col(f"sv_{i}") for i, name in enumerate(names.values())})


def rolling_related_features(
    df: DataFrame, timestamp: str, feature: str, rolling_features: Sequence[str], rolling_window: int = 30
) -> DataFrame:
    rolling = RollingFeatures(timestamp)
    for entity in rolling_features:
        df = rolling.fit(df, entity, feature, rolling_window)
    return df


def rolling_target(
    df: DataFrame, timestamp: str, target: str, rolling_features: Sequence[str], rolling_days: int = 150
) -> DataFrame:
    rolling = RollingFeatures(timestamp)
    for entity in rolling_features:
        df = rolling.sum_of_last_n_days(df, entity, target, rolling_days)
        df = df.withColumnRenamed(f"sum_{entity}_{rolling_days}", f"bad_{entity}")
    return df


def rolling_with_grace(
    df: DataFrame,
    timestamp: str,
    target: str,
    rolling_features: Sequence[str],
    graces: Sequence[int] = (1, 7, 30, 45, 60),
    delta: int = 150,
) -> DataFrame:
    for entity in rolling_features:
        df = _grace_sums(df, timestamp, entity, target, {g: f"bad_{entity}_{g}d" for g in graces}, delta)
    return df


def time_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Calendar parts and their sine and cosine for every date or timestamp column."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    out: dict[str, Column] = {}
    for c in columns:
        x = F.col(c).cast("timestamp")
        hour, day, month = F.hour(x), F.dayofmonth(x), F.month(x)
        turns = {
            "hour": (hour + F.minute(x) / 60.0) / 24.0,
            "day": (day + hour / 24.0) / 365.0,
            "month": (month + day / 30.0 - 1) / 12.0,
        }
        out |= {
            f"{c}__hour_of_day": hour,
            f"{c}__day_of_month": day,
            f"{c}__day_of_week": F.weekday(x),
            f"{c}__week_of_year": F.weekofyear(x),
            f"{c}__month_of_year": month,
        }
        for name, turn in turns.items():
            out[f"{c}__{name}_sin"] = F.sin(turn * (2 * math.pi))
            out[f"{c}__{name}_cos"] = F.cos(turn * (2 * math.pi))
    return df.withColumns(out)


def time_of_day(df: DataFrame, column: str) -> DataFrame:
    hour = F.hour(F.col(column).cast("timestamp"))
    label = F.when((hour > 6) & (hour < 18), F.lit("day")).otherwise("night")
    return df.withColumn(f"time_of_day_{column}", label)


# Fixed value: mean Gregorian year in days, the length of the unit `years` in the reference's cast.
DAYS_PER_YEAR = 365.2425


def age_in_years(born: str | Column, at: str | Column | None = None, calendar: bool = False) -> Column:
    """Whole years between two times; by mean year length, or by calendar with `calendar=True`."""
    born = F.col(born) if isinstance(born, str) else born
    at = F.current_timestamp() if at is None else (F.col(at) if isinstance(at, str) else at)
    if calendar:
        return F.floor(F.months_between(at, born) / 12).cast("int")
    micros_per_year = int(DAYS_PER_YEAR * DAY)
    return F.floor((micros(at) - micros(born)) / F.lit(micros_per_year)).cast("int")
