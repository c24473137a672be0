"""From raw requests to assessments: flags, prediction, gate, search, decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import retrieval_query
from riskloom.operators.cleaning import pad_features, quality_flags
from riskloom.operators.models import TrainedModel, score, top_features
from riskloom.operators.policy import MAX_DISTANCE, assess, with_decision, with_prediction_stub
from riskloom.operators.similarity import SharedHits
from riskloom.plans.frames import written

_PREDICTED = ("probability_of_loss", "is_loss_making_prediction", "top_features", "model_warnings")


def predict_loss(requests: DataFrame, steps: PipelineModel, trained: TrainedModel, key: str = "record_id", n_features: int = 5) -> DataFrame:
    """`requests` with the prediction columns of a fitted feature pipeline and model.

    Feature columns the pipeline does not give are 0 and named in `model_warnings`. `key` is unique.
    """
    named = [name for name, _ in top_features(trained, n_features)]
    scored = score(pad_features(steps.transform(requests), trained.feature_columns), trained)
    columns = scored.withColumn("top_features", F.array(*[F.lit(n) for n in named]).cast("array<string>")).select(key, *_PREDICTED)
    return requests.join(columns, key, "left")


def assess_requests(
    requests: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    search: Callable[[DataFrame], DataFrame | SharedHits],
    outcomes: DataFrame,
    key: str = "record_id",
    record_fields: Sequence[str] = (),
    max_distance: float = MAX_DISTANCE,
) -> DataFrame:
    """One assessment row per request, a frame of record columns with a unique `key`.

    `predict` adds the prediction columns and, where scoring failed, `prediction_error`; rows without a
    probability and without an error count as failed. Decisions are made once and written. Only requests inside
    the gate are searched, each distinct text once: `search` gets (query_id, text) and returns
    (query_id, id, distance, rank and, if wanted, document), read twice, or the same as `SharedHits`: then evidence is put
    together once for all texts that share their hits, and documents are never shuffled for each text.
    """
    predicted = predict(requests.withColumn("input_quality_flags", quality_flags()))
    if "prediction_error" not in predicted.columns:
        predicted = predicted.withColumn("prediction_error", F.lit(None).cast("string"))
    error = F.coalesce("prediction_error", F.when(F.col("probability_of_loss").isNull(), F.lit("no prediction")))
    predicted = predicted.withColumns({"prediction_error": error, "__text": retrieval_query()})
    decided = written(with_decision(with_prediction_stub(predicted)))
    asked = decided.where("retrieve").select(F.col("__text").alias("query_id")).distinct()
    found = search(asked.select("query_id", F.col("query_id").alias("text")))
    return assess(decided, found, outcomes, key, record_fields, max_distance, "__text")
