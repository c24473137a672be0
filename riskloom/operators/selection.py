"""Feature selection: cardinality, stability between two samples, lasso."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import fold_of, row_hash
from riskloom.operators.binning import QuantileDiscretizer
from riskloom.operators.evaluation import area_from_ranks
from riskloom.operators.stages import FitStage, FittedStage
from riskloom.plans.frames import attach, digest_long, numeric_columns, settle, string_columns, unpivot
from riskloom.plans.ranking import value_ranks


class DropModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.fitted("drop"))


class CardinalityFilter(FitStage):
    """Drop columns with one distinct value or with distinct / rows above `high_th`; missing is no value."""

    defaults = {"high_th": 0.9, "approximate": False}

    def _fit(self, dataset: DataFrame) -> DropModel:
        columns = dataset.columns
        if self.setting("approximate"):
            row = dataset.agg(
                F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)]
            ).first()
            distinct, rows = {c: row[f"d{i}"] for i, c in enumerate(columns)}, row["n"]
        else:
            seen = unpivot(dataset, columns).groupBy("feature", digest_long("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            found = seen.groupBy("feature").agg(F.count("value").alias("d"), F.sum("n").alias("n")).collect()
            distinct, rows = {r["feature"]: r["d"] for r in found}, max((r["n"] for r in found), default=0)
        high = [c for c in columns if rows and distinct[c] / rows > self.setting("high_th")]
        single = [c for c in columns if distinct.get(c) == 1]
        return DropModel(state={"drop": high + [c for c in single if c not in high], "high": high, "single": single})


class LowerCardinality(FitStage):
    """In string columns with more than `max_categories` values keep the most frequent ones."""

    defaults = {"max_categories": 10, "others_category": "others"}

    def _fit(self, dataset: DataFrame) -> TopCategoriesModel:
        columns, keep = string_columns(dataset), self.setting("max_categories")
        config = {"others_category": self.setting("others_category")}
        if not columns:
            return TopCategoriesModel(config, {"columns": []})
        counts = (
            unpivot(dataset, columns).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        wide = [r["feature"] for r in counts.groupBy("feature").count().where(F.col("count") > keep).collect()]
        rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))
        top = counts.where(F.col("feature").isin(wide)).withColumn("r", rank).where(F.col("r") <= keep)
        return TopCategoriesModel(config, {"columns": sorted(wide)}, {"top": settle(top.select("feature", "value"))})


class TopCategoriesModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        for c in self.fitted("columns"):
            top = self.tables["top"].where(F.col("feature") == c).select(F.col("value").alias(c), F.lit(True).alias("__top"))
            dataset = attach(dataset, top, [c])
            dataset = dataset.withColumn(c, F.when(F.col("__top"), F.col(c)).otherwise(self.setting("others_category"))).drop("__top")
        return dataset


class StabilityFilter(FitStage):
    """Adversarial check: drop a column that alone tells train rows from test rows.

    A one-column tree is the share of test rows per cell (quantile bin of a number, value of a
    text). It is grown on three quarters of the rows and its ROC area measured on the rest, for
    all columns in one grouped job.
    """

    defaults = {
        "auc_threshold": 0.7, "sample_rate": 0.5, "seed": 42, "bins": 32, "key": "record_id", "hash_method": "xxhash",
    }

    def scores(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """(feature, auc) of every column."""
        key, seed, method = self.setting("key"), self.setting("seed"), self.setting("hash_method")
        share = self.setting("sample_rate")
        some = F.pmod(row_hash(key, seed, method), F.lit(1000)) < int(share * 1000)
        columns = [c for c in train.columns if c != key]
        both = train.where(some).select(key, *columns, F.lit(0).alias("__y")).unionByName(
            test.select(key, *columns, F.lit(1).alias("__y"))
        )
        both = both.withColumn("__fold", fold_of(key, 4, seed + 1, method))
        numbers = [c for c in columns if c in numeric_columns(train)]
        if numbers:
            both = QuantileDiscretizer(n_bins=self.setting("bins"), inplace=True, columns=numbers).fit(both).transform(both)
        cells = unpivot(both, columns, ["__y", "__fold"]).groupBy("feature", "value").agg(
            F.count_if((F.col("__fold") > 0) & (F.col("__y") == 1)).alias("fit_hit"),
            F.count_if(F.col("__fold") > 0).alias("fit_n"),
            F.count_if((F.col("__fold") == 0) & (F.col("__y") == 1)).alias("pos"),
            F.count_if((F.col("__fold") == 0) & (F.col("__y") == 0)).alias("neg"),
        )
        scored = cells.withColumn("score", F.coalesce(F.try_divide("fit_hit", "fit_n"), F.lit(0.5)))
        ranks = value_ranks(scored, "score", ["feature"], {"pos": F.col("pos"), "neg": F.col("neg")})
        return area_from_ranks(ranks, ["feature"]).select("feature", "auc")

    def fit(self, dataset: tuple[DataFrame, DataFrame], params=None) -> DropModel:
        """`dataset` is the pair (train, test)."""
        found = {r["feature"]: r["auc"] for r in self.scores(*dataset).collect()}
        limit = self.setting("auc_threshold")
        return DropModel(state={"drop": sorted(c for c, a in found.items() if a is not None and a > limit), "auc": found})

    def _fit(self, dataset: DataFrame) -> DropModel:
        raise TypeError("fit takes the pair (train, test)")


def _standardised(columns: list[str], mean: dict[str, float], std: dict[str, float]) -> list[Column]:
    return [((F.col(c).cast("double") - F.lit(mean[c])) / F.lit(std[c])).alias(c) for c in columns]


def _moments(df: DataFrame, columns: list[str], fold: str) -> dict[int, np.ndarray]:
    """Sums of products of (1, x..., y) per fold: one pass, one small matrix per task and fold."""
    width = len(columns) + 1

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, part in pdf.groupby("__fold"):
                x = np.column_stack([np.ones(len(part)), part[columns].to_numpy(float)])
                sums[f] = sums.get(f, np.zeros((width, width))) + x.T @ x
        for f, m in sums.items():
            yield pd.DataFrame({"fold": f, "cell": np.arange(width * width), "total": m.ravel()})

    narrow = df.select(F.col(fold).alias("__fold"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    parts = narrow.mapInPandas(products, "fold int, cell int, total double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "cell").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["fold"], np.zeros(width * width))[r["cell"]] = r["total"]
    return {f: m.reshape(width, width) for f, m in out.items()}


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covariances X'X / n and X'y / n around the means, from sums of products."""
    own = m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / m[0, 0] - np.outer(own, own)
    return cov[:-1, :-1], cov[:-1, -1]


def _lasso(gram: np.ndarray, xy: np.ndarray, alpha: float, start: np.ndarray, rounds: int) -> np.ndarray:
    b = start.copy()
    for _ in range(rounds):
        worst = 0.0
        for j in range(len(b)):
            if gram[j, j] <= 0:
                continue
            rho = xy[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
            worst, b[j] = max(worst, abs(new - b[j])), new
        if worst < 1e-9:
            break
    return b


class LassoSelector(FitStage):
    """Standardise, pick the L1 penalty by cross-validation, keep columns with a non-zero weight.

    The squared loss of every fold and penalty follows from sums of products, so the data is read
    once for all folds; the path over penalties works on columns x columns matrices.
    """

    defaults = {
        "target": "TARGET", "columns": None, "cv": 5, "alphas": None, "n_alphas": 100, "eps": 1e-3,
        "max_iter": 20_000, "seed": 42, "key": "record_id", "hash_method": "xxhash",
    }

    def _fit(self, dataset: DataFrame) -> LassoModel:
        target, key, folds = self.setting("target"), self.setting("key"), self.setting("cv")
        columns = list(self.setting("columns") or [c for c in numeric_columns(dataset) if c not in (target, key)])
        fold = fold_of(key, folds, self.setting("seed"), self.setting("hash_method"))
        absent = dataset.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in [*columns, target]]).first()
        if any(absent):
            raise ValueError(f"missing values, impute first: { {c: n for c, n in absent.asDict().items() if n} }")
        row = dataset.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        mean = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}
        std = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)}
        scaled = dataset.select(fold.alias("__fold"), *_standardised(columns, mean, std), target)
        parts = _moments(scaled, [*columns, target], "__fold")
        whole = sum(parts.values())
        gram, xy = _centred(whole)
        top = float(np.abs(xy).max()) or 1.0
        alphas = self.setting("alphas") or list(np.geomspace(top, top * self.setting("eps"), self.setting("n_alphas")))
        alphas = sorted(alphas, reverse=True)
        losses = np.zeros(len(alphas))
        for held in parts.values():
            rest = whole - held
            g, v = _centred(rest)
            b, centre = np.zeros(len(columns)), rest[0] / rest[0, 0]
            for i, alpha in enumerate(alphas):
                b = _lasso(g, v, alpha, b, self.setting("max_iter"))
                error = np.concatenate([[centre[-1] - b @ centre[1:-1]], b, [-1.0]])
                losses[i] += error @ (held / held[0, 0]) @ error / len(parts)
        best = alphas[int(np.argmin(losses))]
        b = np.zeros(len(columns))
        for alpha in [a for a in alphas if a >= best]:
            b = _lasso(gram, xy, alpha, b, self.setting("max_iter"))
        kept = [c for c, w in zip(columns, b) if abs(w) > 1e-10]
        state = {
            "columns": columns, "kept": kept, "alpha": float(best),
            "mean": mean, "std": std,
            "weights": dict(zip(columns, map(float, b))),
        }
        return LassoModel(state=state)


class LassoModel(FittedStage):
    """The kept columns, standardised; other columns of the frame that were not candidates stay."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept, columns = self.fitted("kept"), set(self.fitted("columns"))
        scaled = _standardised(kept, self.fitted("mean"), self.fitted("std"))
        return dataset.select(*[c for c in dataset.columns if c not in columns], *scaled)


__all__ = ["CardinalityFilter", "LassoSelector", "LowerCardinality", "StabilityFilter"]
