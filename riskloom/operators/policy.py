"""Decision rules for scored records: confidence, retrieval gate, conflict, escalation, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.similarity import SharedHits
from riskloom.plans.frames import settle

# Decision thresholds.
HIGH_MARGIN = 0.30
MEDIUM_MARGIN = 0.15
MAX_DISTANCE = 0.5

_EMPTY = "array<string>"


def _starts(flags: Column, prefix: str) -> Column:
    return F.exists(flags, lambda f: f.startswith(prefix))


def confidence_level(
    probability: Column, flags: Column, warnings: Column, high: float = HIGH_MARGIN, medium: float = MEDIUM_MARGIN
) -> Column:
    """high, medium or low from the margin around one half; input problems lower it."""
    none = F.array().cast(_EMPTY)
    flags, warnings = F.coalesce(flags, none), F.coalesce(warnings, none)
    forced = _starts(flags, "required_field_missing") | _starts(flags, "invalid_value") | (F.size(warnings) > 0)
    margin = F.abs(probability - 0.5)
    optional = _starts(flags, "optional_field_missing")
    return (
        F.when(forced, F.lit("low"))
        .when(margin >= high, F.when(optional, F.lit("medium")).otherwise("high"))
        .when(margin >= medium, F.when(optional, F.lit("low")).otherwise("medium"))
        .otherwise("low")
    )


def risk_label(prediction: Column, confidence: Column) -> Column:
    return F.when(confidence == "low", F.lit("unclear")).when(prediction, F.lit("likely_loss")).otherwise("unlikely_loss")


def should_retrieve(confidence: Column, failed: Column) -> Column:
    return (confidence == "low") | failed


def should_escalate(confidence: Column, conflict: Column) -> Column:
    return conflict | (confidence == "low")


def neighbour_votes(
    hits: DataFrame, outcomes: DataFrame, max_distance: float = MAX_DISTANCE, outcome: str = "is_loss_making"
) -> DataFrame:
    """(query_id, votes, losses, majority_loss): near hits with a known outcome; a tie is no loss."""
    near = hits.where(F.col("distance") <= max_distance)
    known = near.join(outcomes.select(F.col("record_id").alias("id"), F.col(outcome).cast("int").alias("__y")).where("__y IS NOT NULL"), "id")
    votes = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("votes"), F.sum("__y").alias("losses"))
    return votes.withColumn("majority_loss", F.col("losses") > F.col("votes") / 2)


def conflict_detected(prediction: Column, majority: Column) -> Column:
    """The prediction differs from the majority; no votes, no conflict."""
    return F.coalesce(majority != prediction, F.lit(False))


# Response texts.
CONFLICT_WARNING = "Model prediction conflicts with majority of similar historical records."
RECOMMENDATION = "Insufficient information to produce a confident recommendation. Manual review is required."
GUIDANCE = "Refer to a senior underwriter for manual assessment."


def with_prediction_stub(df: DataFrame, error: str = "prediction_error") -> DataFrame:
    """Where scoring failed: probability one half, no loss, the error as model warning."""
    failed = F.col(error).isNotNull()
    empty = F.array().cast(_EMPTY)
    named = F.when(F.col(error) != "", F.array(error)).otherwise(empty)
    return df.withColumns(
        {
            "predict_failed": failed,
            "is_loss_making_prediction": F.when(failed, F.lit(False)).otherwise(F.col("is_loss_making_prediction")),
            "probability_of_loss": F.when(failed, F.lit(0.5)).otherwise(F.col("probability_of_loss")),
            "top_features": F.when(failed, empty).otherwise(F.col("top_features")),
            "input_quality_flags": F.when(failed, empty).otherwise(F.col("input_quality_flags")),
            "model_warnings": F.when(failed, named).otherwise(F.col("model_warnings")),
        }
    )


def with_decision(df: DataFrame) -> DataFrame:
    """Confidence and gate, everything that needs no search."""
    confidence = confidence_level(F.col("probability_of_loss"), F.col("input_quality_flags"), F.col("model_warnings"))
    out = df.withColumn("confidence_level", confidence)
    return out.withColumn("retrieve", should_retrieve(F.col("confidence_level"), F.col("predict_failed")))


def _more(json: Column) -> Column:
    """The members of a JSON object as they follow others: behind a comma, without brackets."""
    return F.when(json == "{}", F.lit("")).otherwise(F.concat(F.lit(","), F.substring(json, F.lit(2), F.length(json) - 2)))


def assess(
    scored: DataFrame,
    hits: DataFrame | SharedHits,
    outcomes: DataFrame,
    key: str = "record_id",
    record_fields: Sequence[str] = (),
    max_distance: float = MAX_DISTANCE,
    asked: str | None = None,
) -> DataFrame:
    """One assessment row per scored record.

    `scored` has the prediction columns, `prediction_error` and, if known, `retrieval_error`; a frame
    that went through `with_prediction_stub` and `with_decision` before is taken as it is.
    `hits` holds the search results of the gated records (query_id, id, distance, rank and, if
    wanted, document), where query_id is the record's `key` or, if named, its column `asked`, which many records
    may share. As `SharedHits`, queries that share their hits meet one row of evidence. Rows outside the gate ignore hits.
    """
    decided = scored if "retrieve" in scored.columns else with_decision(with_prediction_stub(scored))
    shared = isinstance(hits, SharedHits)
    if shared:
        members = hits.members.select(F.xxhash64("query_id").alias("__hash"), F.col("query_id").alias("__asked"), F.col("group").alias("__group"))
        mine = F.col(asked or key)
        # hashes first: a sort by texts that begin alike is slow
        same = (F.xxhash64(mine) == F.col("__hash")) & (mine == F.col("__asked"))
        decided = decided.join(members, same & F.col("retrieve"), "left").drop("__hash", "__asked")
        # rows without a group have a negative one of their own, as nulls would all go to one task
        decided = decided.withColumn("__group", F.coalesce("__group", -1 - F.pmod(F.xxhash64(key), F.lit(2**31))))
        hits, asked = hits.hits.withColumnRenamed("group", "query_id"), "__group"
    shown = [c for c in ("id", "document", "distance") if c in hits.columns]
    found = hits.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", *shown))),  # at most the k of the search
            lambda h: F.struct(*[h[c].alias("record_id" if c == "id" else c) for c in shown]),
        ).alias("retrieved_records")
    )
    # as JSON, made once for all records that share them
    found = found.select("query_id", F.to_json(F.struct("retrieved_records")).alias("__json")).select("query_id", _more(F.col("__json")).alias("__retrieved"))
    none = _more(F.to_json(F.struct(F.lit(None).cast("array<string>").alias("retrieved_records"))))
    votes = neighbour_votes(hits, outcomes, max_distance).select("query_id", "majority_loss")
    evidence = found.join(votes, "query_id", "left").withColumnRenamed("query_id", "__query")
    evidence = settle(evidence) if shared else evidence
    joined = decided.join(evidence, (F.col(asked or key) == F.col("__query")) & F.col("retrieve"), "left").drop("__query")

    retrieval_error = F.col("retrieval_error") if "retrieval_error" in scored.columns else F.lit(None).cast("string")
    has_hits = F.col("__retrieved").isNotNull()
    joined = joined.withColumn("conflict_detected", conflict_detected(F.col("is_loss_making_prediction"), F.col("majority_loss")))
    escalate = should_escalate(F.col("confidence_level"), F.col("conflict_detected"))
    warnings = F.array_compact(
        F.concat(
            F.array(F.when(F.col("predict_failed"), F.concat(F.lit("Prediction failed: "), F.coalesce(F.nullif("prediction_error", F.lit("")), F.lit("unknown error"))))),
            F.col("input_quality_flags"),
            F.array(F.when(F.col("retrieve"), F.concat(F.lit("Retrieval failed: "), retrieval_error))),
            F.array(F.when(F.col("conflict_detected"), F.lit(CONFLICT_WARNING))),
        )
    )
    tools = F.array_compact(
        F.array(F.lit("predict_loss"), F.when(F.col("retrieve") & retrieval_error.isNull(), F.lit("retrieve_similar_records")))
    )
    out = joined.withColumns(
        {
            "second_opinion_recommended": escalate,
            "risk_assessment": risk_label(F.col("is_loss_making_prediction"), F.col("confidence_level")),
            "warnings": warnings,
            "tools_used": tools,
            "deterministic": escalate & (F.col("confidence_level") == "low") & ~has_hits,
        }
    )
    told = F.to_json(
        F.struct(
            F.struct(*[F.col(c) for c in record_fields if c != key]).alias("record") if record_fields else F.lit(None).cast("string").alias("record"),
            F.struct(
                F.col("is_loss_making_prediction").alias("is_loss_making"), "probability_of_loss", "top_features"
            ).alias("prediction"),
            "confidence_level", "risk_assessment", "second_opinion_recommended",
        )
    )
    out = out.withColumns({"__told": told, "__warned": F.to_json(F.struct("warnings"))})  # columns, as they are named more than once
    head = F.substring("__told", F.lit(1), F.length("__told") - 1)
    evidence_json = F.concat(head, F.coalesce("__retrieved", none), _more(F.col("__warned")), F.lit("}"))
    fixed = F.col("deterministic")
    return out.select(
        key,
        F.when(fixed, F.lit(RECOMMENDATION)).alias("recommendation"),
        "risk_assessment",
        "confidence_level",
        F.col("top_features").alias("key_factors"),
        F.when(fixed, deterministic_summary(F.col("confidence_level"), F.col("warnings"))).alias("summary"),
        "second_opinion_recommended",
        F.when(fixed, F.lit(GUIDANCE)).alias("review_guidance"),
        "tools_used",
        "warnings",
        "conflict_detected",
        F.when(~fixed, evidence_json).alias("evidence"),
    )


def deterministic_summary(confidence: Column, warnings: Column) -> Column:
    """Summary of a record that goes to review without search results: first three warnings."""
    issues = F.when(
        F.size(warnings) > 0, F.concat(F.lit("Issues: "), F.array_join(F.slice(warnings, 1, 3), "; "), F.lit("."))
    ).otherwise("")
    return F.concat(F.lit("Model confidence is "), confidence, F.lit(". "), issues)


def verdict(aligned: Column, calibrated: Column) -> Column:
    """Correct only when the outcome is right and the certainty fits; missing counts as no."""
    return F.coalesce(aligned, F.lit(False)) & F.coalesce(calibrated, F.lit(False))


def evaluation_summary(
    df: DataFrame, correct: str = "correct", label: str = "is_loss_making", case_type: str = "case_type", latency: str = "latency_s"
) -> DataFrame:
    """Rows, correct rows, share and mean latency: overall, by label and by case type."""
    hit = F.coalesce(F.col(correct), F.lit(False))
    cells = [
        F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")),
        F.struct(F.lit("label").alias("slice"), F.col(label).cast("string").alias("value")),
        F.struct(F.lit("case_type").alias("slice"), F.col(case_type).cast("string").alias("value")),
    ]
    rows = df.select(hit.alias("__hit"), F.col(latency).alias("__s"), F.inline(F.array(*cells)))
    return rows.groupBy("slice", "value").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("__hit").alias("correct"),
        (F.count_if("__hit") / F.count(F.lit(1))).alias("accuracy"),
        F.avg("__s").alias("avg_latency_s"),
    )
