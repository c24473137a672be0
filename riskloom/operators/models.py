"""Training, choosing and applying classifiers; feature importance."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.hashing import fold_of
from riskloom.operators.evaluation import roc_auc
from riskloom.operators.splits import stratified_split
from riskloom.plans.frames import written
from riskloom.plans.ranking import dense_numbers

FEATURES = "__features"


def candidate_models(label: str, weight: str, seed: int = 42, trees: int = 200, boosts: int = 50) -> dict[str, Estimator]:
    """Boosted trees with class weights, random forest, logistic regression."""
    base = {"featuresCol": FEATURES, "labelCol": label}
    return {
        "boosted_trees": GBTClassifier(
            **base, weightCol=weight, maxIter=boosts, stepSize=0.05, maxDepth=4, minInstancesPerNode=30, subsamplingRate=0.8, seed=seed
        ),
        "random_forest": RandomForestClassifier(**base, numTrees=trees, seed=seed),
        "logistic_regression": LogisticRegression(**base, maxIter=1000),
    }


@dataclass
class TrainedModel:
    """A fitted pipeline with what is needed to use it again."""

    model: PipelineModel
    model_name: str
    feature_columns: list[str]
    target_column: str
    config: dict[str, Any] = field(default_factory=dict)
    scores: list[dict[str, Any]] = field(default_factory=list)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        info = {
            "model_name": self.model_name, "feature_columns": self.feature_columns,
            "target_column": self.target_column, "config": self.config, "scores": self.scores,
        }
        _active().createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> TrainedModel:
        info = json.loads(_active().read.text(f"{path}/metadata").first()[0])
        return cls(model=PipelineModel.load(f"{path}/model"), **info)


def _active() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def fit_one(df: DataFrame, features: Sequence[str], estimator: Estimator) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")
    return Pipeline(stages=[assembler, estimator]).fit(df)


#: Every so many rows by hash are held back while boosting, and the relative gain below which it stops.
STOP_FOLDS, STOP_GAIN = 5, 0.001


def fit_boosted(df: DataFrame, features: Sequence[str], estimator: GBTClassifier, key: str, seed: int = 42) -> tuple[PipelineModel, int]:
    """Boosted trees that stop when rows held back gain nothing more, and their number of rounds.

    A fifth of the rows, chosen by a hash of the key, are not fitted but validated on after every round; `maxIter` is the
    most rounds. Where either part would be empty all rounds are fitted on all rows. To use every row, fit again with
    the rounds as `maxIter`.
    """
    marked = df.withColumn("__stop", fold_of(key, STOP_FOLDS, seed) == 0)
    parts = marked.agg(F.count_if("__stop").alias("held"), F.count_if(~F.col("__stop")).alias("fit")).first()
    if not parts["held"] or not parts["fit"]:
        return fit_one(df, features, estimator), estimator.getMaxIter()
    watched = estimator.copy({estimator.validationIndicatorCol: "__stop", estimator.validationTol: STOP_GAIN})
    model = fit_one(marked, features, watched)
    return model, max(1, model.stages[-1].getNumTrees)


def given_model(weights: dict[str, float], intercept: float, target: str) -> TrainedModel:
    """A logistic model with coefficients given as numbers, to be scored, explained and saved like a fitted one."""
    jvm, gateway = _active().sparkContext._jvm, _active().sparkContext._gateway
    numbers = gateway.new_array(gateway.jvm.double, len(weights))
    for i, w in enumerate(weights.values()):
        numbers[i] = float(w)
    ml = jvm.org.apache.spark.ml
    made = ml.classification.LogisticRegressionModel("given_logistic", ml.linalg.Vectors.dense(numbers), float(intercept))
    model = LogisticRegressionModel(made).setFeaturesCol(FEATURES)
    assembler = VectorAssembler(inputCols=list(weights), outputCol=FEATURES, handleInvalid="keep")
    return TrainedModel(PipelineModel([assembler, model]), "given_logistic", list(weights), target)


def probability(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in extra if c != name])


def _class_weight(df: DataFrame, target: str) -> Column:
    """n_neg / n_pos of these rows for positive ones, 1 for the others."""
    counts = df.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("q")).first()
    return F.when(F.col(target) == 1, F.lit(counts["q"] / max(counts["p"], 1))).otherwise(1.0)


def train_candidates(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    key: str,
    test: DataFrame | None = None,
    validation_size: float = 0.2,
    candidates: dict[str, Estimator] | None = None,
    seed: int = 42,
) -> TrainedModel:
    """Fit every candidate, choose by validation area, refit the winner on all training rows.

    Positive rows weigh n_neg / n_pos in the boosted trees, which stop by `fit_boosted`; their refit has the
    rounds of the first fit. The test frame is only reported on.
    """
    labelled = written(train.withColumn(target, F.col(target).cast("int")).select(key, target, *features))
    fit_rows, held = stratified_split(labelled, target, key, validation_size, seed)
    pool = candidates or candidate_models(target, "__weight", seed)
    scores, weighted = [], fit_rows.withColumn("__weight", _class_weight(fit_rows, target))
    for name, estimator in pool.items():
        row: dict[str, Any] = {"model": name}
        if isinstance(estimator, GBTClassifier):
            model, row["rounds"] = fit_boosted(weighted, features, estimator, key, seed)
            pool = {**pool, name: estimator.copy({estimator.maxIter: row["rounds"]})}
        else:
            model = fit_one(weighted, features, estimator)
        row["val_auc"] = _auc(model, held, target)
        if test is not None:
            row["test_auc"] = _auc(model, test.withColumn(target, F.col(target).cast("int")), target)
        scores.append(row)
    scores.sort(key=lambda r: (-r["val_auc"], r["model"]))
    best = scores[0]["model"]
    final = fit_one(labelled.withColumn("__weight", _class_weight(labelled, target)), features, pool[best])
    return TrainedModel(final, best, list(features), target, {"seed": seed}, scores)


def _auc(model: PipelineModel, df: DataFrame, target: str) -> float:
    scores = written(probability(model, df, "__p").select(target, "__p"))  # read twice, predicted once
    return round(roc_auc(scores, target, "__p").first()["auc"], 4)


def score(df: DataFrame, trained: TrainedModel) -> DataFrame:
    """Probability (4 digits) and label at `>= 0.5` of the unrounded probability."""
    out = probability(trained.model, df, "__p")
    return out.withColumns(
        {"probability_of_loss": F.round("__p", 4), "is_loss_making_prediction": F.col("__p") >= 0.5}
    ).drop("__p")


def serve(df: DataFrame, probability_col: str | Column, threshold: float) -> DataFrame:
    """`pred_prob` and `pred` with a strict threshold."""
    p = F.col(probability_col) if isinstance(probability_col, str) else probability_col
    return df.withColumns({"pred_prob": p, "pred": p > threshold})


def top_features(trained: TrainedModel, n: int = 5) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients, highest first."""
    last = trained.model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = [float(v) for v in last.featureImportances.toArray()]
    elif hasattr(last, "coefficients"):
        values = [abs(float(v)) for v in last.coefficients.toArray()]
    else:
        return []
    ranked = sorted(zip(trained.feature_columns, values), key=lambda x: (-x[1], x[0]))
    return ranked[:n] if n else ranked


def linear_contributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(feature, importance): mean of |weight * (x - mean)|, the exact attribution of a linear model."""
    row = df.agg(*[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(weights)]).first()
    means = df.agg(
        *[
            F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(row[f"m{i}"])))).alias(f"v{i}")
            for i, (c, w) in enumerate(weights.items())
        ]
    )
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("importance")) for i, c in enumerate(weights)]
    return means.select(F.inline(F.array(*cells))).orderBy(F.desc("importance"), "feature")


def shuffled_partner(df: DataFrame, key: str, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """Add `__other_<c>`: the values of another row, every row used once.

    Rows are numbered densely in key order and paired by n -> a * n + b mod rows with a coprime to
    the row count, a bijection, so one equi-join replaces a shuffle of each column.
    """
    numbered = dense_numbers(df.select(key, *columns), key, "__n")
    n = numbered.count()
    a = max(1, int(n * 0.6180339887498949))
    while math.gcd(a, n) != 1:
        a += 1
    # split multiplication keeps the product below 2^63 for any row count below 2^42
    low, high = F.pmod("__n", F.lit(1 << 20)), F.floor(F.col("__n") / (1 << 20))
    target = F.pmod(
        F.pmod(high * F.lit(a % n), F.lit(n)) * F.lit((1 << 20) % n) + low * F.lit(a) + F.lit(seed % n), F.lit(n)
    )
    others = numbered.select(target.cast("long").alias("__n"), *[F.col(c).alias(f"__other_{c}") for c in columns])
    return numbered.join(others, "__n").drop("__n", *columns).join(df, key)


def permutation_importance(df: DataFrame, trained: TrainedModel, key: str, seed: int = 42) -> DataFrame:
    """(feature, importance): loss of ROC area when one feature takes the values of other rows.

    Every row is scored once as it is (number -1) and once per feature with that feature swapped; one
    pass ranks the scores of all of them.
    """
    target, features = trained.target_column, trained.feature_columns
    paired = shuffled_partner(df.withColumn(target, F.col(target).cast("int")), key, features, seed)
    turns = paired.withColumn("__swap", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = turns.select(
        "__swap", target, *[F.when(F.col("__swap") == i, F.col(f"__other_{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(features)]
    )
    scores = written(probability(trained.model, swapped, "__p").select("__swap", target, "__p"))
    areas = {r["__swap"]: r["auc"] for r in roc_auc(scores, target, "__p", ["__swap"]).collect()}
    rows = [(c, areas[-1] - areas[i]) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
