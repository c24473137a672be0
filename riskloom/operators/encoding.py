"""Category encoders: target mean, weight of evidence, one-vs-rest, out-of-fold means, one-hot."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import fold_of
from riskloom.operators.binning import CustomDiscretizer, Discretizer, QuantileDiscretizer
from riskloom.operators.profiling import classes_of
from riskloom.operators.stages import FitStage, FittedStage
from riskloom.plans.frames import attach, numeric_columns, settle, string_columns, unpivot, written

# Categories every mapping knows.
RESERVED = ("OTHERS", "MISSING")
KINDS = ("TargetEncoder", "WOEEncoder")


def _check_missing(df: DataFrame, columns: Sequence[str]) -> None:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    bad = [c for i, c in enumerate(columns) if row[f"m{i}"]]
    if bad:
        raise ValueError(f"missing values in {bad}; impute them before encoding")


def _check_binary(df: DataFrame, target: str) -> None:
    y = F.col(target).cast("double")
    row = df.agg(
        F.count_if(y.isNull() | ~y.isin(0.0, 1.0)).alias("bad"),
        F.count_if(y == 1.0).alias("ones"),
        F.count_if(y == 0.0).alias("zeros"),
    ).first()
    if row["bad"] or not row["ones"] or not row["zeros"]:
        raise ValueError(f"{target} must hold both 0 and 1 and nothing else")


def one_vs_rest(df: DataFrame, columns: Sequence[str], target: Column, classes: Sequence, kind: str) -> DataFrame:
    """(feature, category, v0, v1, ...): one value per class from one grouped count of all columns."""
    if kind not in KINDS:
        raise ValueError(f"encoder must be one of {KINDS}")
    hits = {f"__h{i}": F.count_if(F.col("__y") == F.lit(c)) for i, c in enumerate(classes)}
    counts = unpivot(df, list(columns), [target.alias("__y")]).groupBy("feature", F.col("value").alias("category")).agg(
        F.count(F.lit(1)).alias("__n"), *[h.alias(n) for n, h in hits.items()]
    )
    values = []
    if kind == "TargetEncoder":
        values = [(F.col(f"__h{i}") / F.col("__n")).alias(f"v{i}") for i in range(len(classes))]
    else:
        y = df.select(target.alias("__y"))
        row = y.agg(F.count(F.lit(1)).alias("n"), *[h.alias(n) for n, h in hits.items()]).first()
        for i in range(len(classes)):
            hit, rest = F.col(f"__h{i}"), F.col("__n") - F.col(f"__h{i}")
            ones, zeros = row[f"__h{i}"], row["n"] - row[f"__h{i}"]
            odds = F.log((hit / F.lit(ones)) / (rest / F.lit(zeros)))
            values.append(F.when((hit > 0) & (rest > 0), odds).otherwise(0.0).alias(f"v{i}"))
    return counts.select("feature", "category", *values)


class MappingModel(FittedStage):
    """Replace or extend string columns by looking categories up in the fitted table."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, labels = self.fitted("columns"), self.fitted("labels")
        keep = set(self.setting("passthrough")) | {self.setting("target")}
        mode = self.setting("handle_unknown")
        if not columns:
            return dataset
        order = dataset.columns
        for i, c in enumerate(columns):
            lookup = self.tables["mapping"].where(F.col("feature") == c).select(
                F.col("category").alias(c), *[F.col(f"v{j}").alias(f"__e{i}_{j}") for j in range(len(labels))], F.lit(True).alias(f"__f{i}")
            )
            dataset = attach(dataset, lookup, [c])
        out = {}
        for j, label in enumerate(labels):
            for i, c in enumerate(columns):
                value = F.col(f"__e{i}_{j}")
                unseen = F.col(f"__f{i}").isNull() & F.col(c).isNotNull()
                if mode == "error":
                    message = F.concat(F.lit(f"unseen category in {c}: "), F.col(c))
                    value = F.when(unseen, F.raise_error(message).cast("double")).otherwise(value)
                elif mode == "others":
                    value = F.when(unseen, F.lit(self.fitted("others")[c][j])).otherwise(value)
                out[c if label is None else f"{c}__{label}"] = value
        replaced = labels == [None]
        numbers = [c for c in numeric_columns(dataset) if c not in keep and not c.startswith("__")]
        casts = {c: F.col(c).cast("double") for c in numbers}
        final = []
        for c in order:
            if c in columns and replaced:
                final.append(out[c].alias(c))
            elif c not in columns:
                final.append(casts.get(c, F.col(c)).alias(c))
        if not replaced:
            final += [v.alias(n) for n, v in out.items()]
        return dataset.select(*final)


def _mapping_model(stage: FitStage, df: DataFrame, columns: list[str], target: Column, classes: list, kind: str, labels: list) -> MappingModel:
    config = {k: stage.setting(k) for k in ("target", "handle_unknown", "passthrough")}
    if config["handle_unknown"] not in ("error", "null", "others"):
        raise ValueError("handle_unknown is error, null or others")
    if not columns:
        warnings.warn(f"no string columns: {type(stage).__name__} is not needed", stacklevel=3)
        return MappingModel(config, {"columns": [], "labels": labels})
    _check_missing(df, columns)
    found = one_vs_rest(df, columns, target, classes, kind)
    spare = df.sparkSession.createDataFrame([(c, r) for c in columns for r in RESERVED], "feature string, category string")
    zeros = [F.lit(0.0).alias(f"v{i}") for i in range(len(classes))]
    table = settle(found.unionByName(spare.join(found, ["feature", "category"], "left_anti").select("feature", "category", *zeros)))
    others = {
        r["feature"]: [r[f"v{i}"] for i in range(len(classes))]
        for r in table.where(F.col("category") == "OTHERS").collect()
    }
    return MappingModel(config, {"columns": columns, "labels": labels, "others": others}, {"mapping": table})


_COMMON = {"target": "TARGET", "columns": None, "handle_unknown": "error", "passthrough": []}


def _texts(stage: FitStage, df: DataFrame) -> list[str]:
    skip = {stage.setting("target"), *stage.setting("passthrough")}
    return list(stage.setting("columns") or [c for c in string_columns(df) if c not in skip])


class TargetEncoder(FitStage):
    """Category to mean of a 0/1 target; all other numeric columns become double."""

    defaults = dict(_COMMON)

    def _fit(self, dataset: DataFrame) -> MappingModel:
        target = self.setting("target")
        _check_binary(dataset, target)
        return _mapping_model(self, dataset, _texts(self, dataset), F.col(target).cast("int"), [1], "TargetEncoder", [None])


class WOEEncoder(FitStage):
    """Category to ln(P(category | 1) / P(category | 0)); 0 where one side has no rows."""

    defaults = dict(_COMMON)

    def _fit(self, dataset: DataFrame) -> MappingModel:
        target = self.setting("target")
        _check_binary(dataset, target)
        return _mapping_model(self, dataset, _texts(self, dataset), F.col(target).cast("int"), [1], "WOEEncoder", [None])


class MultiClassEncoder(FitStage):
    """One column per category column and class but the first: `<col>__<target>_<class>_<encoder>`."""

    defaults = {**_COMMON, "encoder": "WOEEncoder"}

    def _fit(self, dataset: DataFrame) -> MappingModel:
        target = self.setting("target")
        classes = classes_of(dataset, target)
        if len(classes) < 3:
            raise ValueError(f"{target} needs at least three classes")
        return _multiclass(self, dataset, F.col(target), classes)


def _multiclass(stage: FitStage, df: DataFrame, target: Column, classes: list) -> MappingModel:
    kind = stage.setting("encoder")
    labels = [f"{stage.setting('target')}_{c}_{kind}" for c in classes[1:]]
    return _mapping_model(stage, df, _texts(stage, df), target, classes[1:], kind, labels)


class RegressionEncoder(FitStage):
    """Bin a continuous target, then encode against the bins as classes."""

    defaults = {**_COMMON, "encoder": "WOEEncoder", "discretizer": "quantile", "n_bins": 3, "bins": None}

    def _fit(self, dataset: DataFrame) -> MappingModel:
        target, kind = self.setting("target"), self.setting("discretizer")
        settings = {"columns": [target], "n_bins": self.setting("n_bins"), "inplace": True}
        if kind == "quantile":
            stage = QuantileDiscretizer(**settings)
        elif kind == "width":
            stage = Discretizer(**settings)
        elif kind == "custom":
            stage = CustomDiscretizer(bins={target: self.setting("bins")}, inplace=True)
        else:
            raise ValueError("discretizer is quantile, width or custom")
        binned = stage.fit(dataset.select(target)).transform(dataset)
        labelled = binned.withColumn(target, F.col(target).cast("double").cast("int"))
        classes = classes_of(labelled, target)
        return _multiclass(self, labelled, F.col(target), classes)


class OOFGroupEncoder(FitStage):
    """Group mean of a measure: from the other folds on training rows, from all rows when scoring.

    `fit_transform` needs a key to assign folds; the sums of "all folds but i" are k conditional
    aggregates of one pass, so there is no join per fold.
    """

    defaults = {
        "group_col": "broker", "score_col": "broker_score", "loss_ratio_col": "loss_ratio",
        "n_splits": 5, "random_state": 42, "key": "record_id", "hash_method": "xxhash",
    }

    def _totals(self, dataset: DataFrame) -> DataFrame:
        """Sum and count per group, over all rows and over all folds but i; missing group included."""
        value = F.col(self.setting("loss_ratio_col"))
        aggs = [F.sum(value).alias("s"), F.count(value).alias("n")]
        if "__fold" in dataset.columns:
            for i in range(self.setting("n_splits")):
                other = F.when(F.col("__fold") != i, value)
                aggs += [F.sum(other).alias(f"s{i}"), F.count(other).alias(f"n{i}")]
        return settle(dataset.groupBy(self.setting("group_col")).agg(*aggs))

    def _model(self, totals: DataFrame) -> GroupMeanModel:
        group = self.setting("group_col")
        overall = totals.agg(F.try_divide(F.sum("s"), F.sum("n"))).first()[0]
        means = totals.where(F.col(group).isNotNull() & (F.col("n") > 0)).select(group, (F.col("s") / F.col("n")).alias("__mean"))
        config = {"group_col": group, "score_col": self.setting("score_col")}
        return GroupMeanModel(config, {"global_mean": overall}, {"means": means})

    def _fit(self, dataset: DataFrame) -> GroupMeanModel:
        return self._model(self._totals(dataset))

    def _folded(self, dataset: DataFrame) -> DataFrame:
        settings = (self.setting("key"), self.setting("n_splits"), self.setting("random_state"), self.setting("hash_method"))
        return dataset.withColumn("__fold", fold_of(*settings))

    def _scored(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        k, group = self.setting("n_splits"), self.setting("group_col")
        overall = totals.agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")).alias(f"o{i}") for i in range(k)]).first()
        folds = F.array(*[F.coalesce(F.try_divide(f"s{i}", f"n{i}"), F.lit(overall[f"o{i}"])) for i in range(k)])
        table = totals.where(F.col(group).isNotNull()).select(group, folds.alias("__means"))
        default = F.array(*[F.lit(overall[f"o{i}"]).cast("double") for i in range(k)])
        score = F.element_at(F.coalesce("__means", default), F.col("__fold") + 1)
        return attach(rows, table, [group]).withColumn(self.setting("score_col"), score).drop("__fold", "__means")

    def out_of_fold(self, dataset: DataFrame) -> DataFrame:
        rows = self._folded(dataset)
        return self._scored(rows, self._totals(rows))

    def fit_transform(self, dataset: DataFrame) -> tuple[GroupMeanModel, DataFrame]:
        rows = self._folded(dataset)
        totals = self._totals(rows)
        return self._model(totals), self._scored(rows, totals)


class GroupMeanModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = F.coalesce("__mean", F.lit(self.fitted("global_mean")))
        return attach(dataset, self.tables["means"], [self.setting("group_col")]).withColumn(self.setting("score_col"), score).drop("__mean")


class CategoricalEncoder(FitStage):
    """One-hot columns without the first category, and ordered categories as ranks."""

    defaults = {"nominal_cols": [], "ordinal_col_map": {}}

    def _fit(self, dataset: DataFrame) -> CategoricalModel:
        categories = _categories(dataset, self.setting("nominal_cols"))
        used: set[str] = {c.lower() for c in dataset.columns}
        names: dict[str, list[list[str]]] = {}
        for c, values in categories.items():
            names[c] = []
            for v in values:
                name = base = f"{c}_{v}"
                n = 2
                while name.lower() in used:
                    name, n = f"{base}__{n}", n + 1
                used.add(name.lower())
                names[c].append([v, name])
        return CategoricalModel({"ordinal_col_map": self.setting("ordinal_col_map")}, {"names": names})


def _categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values of each column without the first one: each becomes an output column."""
    rows = unpivot(df, columns).where("value IS NOT NULL").distinct().collect()
    return {c: sorted(r["value"] for r in rows if r["feature"] == c)[1:] for c in columns}


class CategoricalModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.fitted("names")
        pairs = [(c, v, n) for c, items in names.items() for v, n in items]
        out = one_hot_pairs(dataset, pairs).drop(*names)
        ranks = {}
        for c, order in self.setting("ordinal_col_map").items():
            if c in out.columns:
                rank = F.lit(-1)
                for i, v in reversed(list(enumerate(order))):
                    rank = F.when(F.col(c) == v, F.lit(i)).otherwise(rank)
                ranks[c] = rank
        return out.withColumns(ranks) if ranks else out


def one_hot_pairs(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Append a 0/1 double per (column, category, output name)."""
    hot = [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)).alias(n) for c, v, n in pairs]
    return df.select("*", *hot)


class FeatureSteps:
    """Stages fitted in order. Training rows take `fit_transform` where a stage has it (out-of-fold
    scores), new rows take the fitted model's `transform`.

    Every fit reads its own few columns. So that they do not all repeat the work before them, the
    frame is written once to the shared folder before the first fit (`write_once`).
    """

    def __init__(self, stages: Sequence, write_once: bool = True):
        self.stages, self.write_once = list(stages), write_once

    def fit_transform(self, df: DataFrame) -> tuple[PipelineModel, DataFrame]:
        fitted, pending = [], self.write_once
        for stage in self.stages:
            if pending and hasattr(stage, "fit"):
                df, pending = written(df), False
            if hasattr(stage, "fit_transform"):
                model, df = stage.fit_transform(df)
            elif hasattr(stage, "fit"):
                model = stage.fit(df)
                df = model.transform(df)
            else:
                model, df = stage, stage.transform(df)
            fitted.append(model)
        return PipelineModel(fitted), df
