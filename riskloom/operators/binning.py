"""Discretizers: equal width, quantile and custom edges, and rare-category grouping."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.stages import FitStage, FittedStage
from riskloom.plans.frames import attach, numeric_columns, settle, string_columns, unpivot
from riskloom.plans.ranking import quantiles

OTHERS = "OTHERS"


def _number(column: str) -> Column:
    """The column as double, NaN being missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


class BinModel(FittedStage):
    """Right-closed bins `(a, b]` as text `"0.0"`, `"1.0"`, ...; missing or outside is `"0.0"`.

    The left-closed bucketizer becomes right-closed by moving every edge to the next double.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges: dict[str, list[float]] = self.fitted("edges")
        columns = [c for c in edges if c in dataset.columns]
        if not columns:
            return dataset
        inputs = {f"__x_{c}": F.col(c).cast("double") for c in columns}
        splits, shifts = [], {}
        for c in columns:
            inner = [math.nextafter(e, math.inf) for e in edges[c] if math.isfinite(e)]
            shifts[c] = 1 if math.isfinite(edges[c][0]) else 0
            splits.append([-math.inf, *(inner or [0.0]), math.inf])
        buckets = Bucketizer(
            splitsArray=splits,
            inputCols=list(inputs),
            outputCols=[f"__y_{c}" for c in columns],
            handleInvalid="keep",
        ).transform(dataset.withColumns(inputs))
        labels: dict[str, Column] = {}
        for c in columns:
            number = F.col(f"__y_{c}").cast("int") - shifts[c]
            known = F.col(f"__x_{c}").isNotNull() & ~F.isnan(f"__x_{c}")
            bins = len(edges[c]) - 1
            inside = known & (number >= 0) & (number < bins) if any(map(math.isfinite, edges[c])) else F.lit(False)
            name = c if self.setting("inplace") else f"{c}__bin"
            labels[name] = F.concat(F.coalesce(F.when(inside, number), F.lit(0)).cast("string"), F.lit(".0"))
        return buckets.withColumns(labels).drop(*inputs, *[f"__y_{c}" for c in columns])


class Discretizer(FitStage):
    """Equal-width bins of all numeric columns."""

    defaults = {"n_bins": 10, "inplace": False, "columns": None}

    def _fit(self, dataset: DataFrame) -> BinModel:
        n, columns = _bin_settings(self, dataset)
        edges = {}
        if columns:
            row = dataset.agg(
                *[F.min(_number(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
                *[F.max(_number(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
            ).first()
            for i, c in enumerate(columns):
                lo, hi = row[f"lo{i}"], row[f"hi{i}"]
                inner = [] if lo is None else [lo + j * (hi - lo) / n for j in range(1, n)]
                edges[c] = [-math.inf, *sorted(set(inner)), math.inf]
        return BinModel({"inplace": self.setting("inplace")}, {"edges": edges})


class QuantileDiscretizer(FitStage):
    """Bins with about equal row counts; equal edges collapse. Exact, or `approximate=True`."""

    defaults = {"n_bins": 10, "inplace": False, "columns": None, "approximate": False, "accuracy": 10_000}

    def _fit(self, dataset: DataFrame) -> BinModel:
        n, columns = _bin_settings(self, dataset)
        probs = [i / n for i in range(1, n)]
        edges = {}
        if columns and self.setting("approximate"):
            row = dataset.agg(
                *[F.percentile_approx(F.col(c).cast("double"), probs, self.setting("accuracy")).alias(f"q{i}") for i, c in enumerate(columns)]
            ).first()
            edges = {c: [-math.inf, *sorted(set(row[f"q{i}"] or [])), math.inf] for i, c in enumerate(columns)}
        elif columns:
            for row in quantiles(dataset, columns, probs).collect():
                inner = {row[f"q{i}"] for i in range(len(probs))}
                edges[row["feature"]] = [-math.inf, *sorted(inner), math.inf]
        return BinModel({"inplace": self.setting("inplace")}, {"edges": edges})


class CustomDiscretizer(FitStage):
    """Bins with the given edges per column."""

    defaults = {"bins": {}, "inplace": False}

    def _fit(self, dataset: DataFrame) -> BinModel:
        bins = self.setting("bins")
        if not isinstance(bins, dict):
            raise TypeError("bins must be a dict of column to edges")
        edges = {c: sorted({float(e) for e in v}) for c, v in bins.items()}
        return BinModel({"inplace": self.setting("inplace")}, {"edges": edges})


def _bin_settings(stage: FitStage, dataset: DataFrame) -> tuple[int, list[str]]:
    n = stage.setting("n_bins")
    if not isinstance(n, int) or n < 2:
        raise TypeError("n_bins must be an int of at least 2")
    return n, list(stage.setting("columns") or numeric_columns(dataset))


class BinRareEvents(FitStage):
    """Keep categories whose share of non-missing rows is at least `min_ratio`; all else is OTHERS."""

    defaults = {"min_ratio": 0.01, "columns": None}

    def _fit(self, dataset: DataFrame) -> RareEventsModel:
        ratio = self.setting("min_ratio")
        if not 0 <= ratio <= 1:
            raise ValueError("min_ratio must be between 0 and 1")
        columns = list(self.setting("columns") or string_columns(dataset))
        if not columns:
            return RareEventsModel(state={"columns": []})
        counts = (
            unpivot(dataset, columns).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
        kept = attach(counts, totals, ["feature"]).where(F.col("n") / F.col("total") >= ratio).select("feature", "value")
        return RareEventsModel(state={"columns": columns}, tables={"kept": settle(kept)})


class RareEventsModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = dataset.columns
        for c in self.fitted("columns"):
            if c in names:
                kept = self.tables["kept"].where(F.col("feature") == c).select(F.col("value").alias(c), F.lit(True).alias("__kept"))
                dataset = attach(dataset, kept, [c])
                dataset = dataset.withColumn(c, F.when(F.col("__kept") & F.col(c).isNotNull(), F.col(c)).otherwise(OTHERS)).drop("__kept")
        return dataset
