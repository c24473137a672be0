"""Rolling monitors over assessments, as expressions that run on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions.text import content_hash
from riskloom.operators.policy import confidence_level, risk_label, should_escalate, should_retrieve

# The confidence bands and the halt threshold of the escalation share.
BANDS = ("high", "medium", "low")
HALT_SHARE = 0.40


def _windowed(df: DataFrame, ts: str, size: str, slide: str, delay: str):
    rows = df.withWatermark(ts, delay) if df.isStreaming else df
    return rows.groupBy(F.window(ts, size, slide).alias("window"))


def decision_shares(
    df: DataFrame,
    ts: str = "ts",
    confidence: str = "confidence_level",
    escalated: str = "second_opinion_recommended",
    tools: str = "tools_used",
    tool_names: Sequence[str] = ("predict_loss", "retrieve_similar_records"),
    size: str = "24 hours",
    slide: str = "1 hour",
    delay: str = "2 hours",
) -> DataFrame:
    """Shares of confidence bands, escalations and tools per sliding window, one row per window."""
    n = F.count(F.lit(1))
    measures = {f"{band}_share": F.count_if(F.col(confidence) == band) / n for band in BANDS}
    measures["escalation_share"] = F.count_if(F.col(escalated)) / n
    for name in tool_names:
        measures[f"{name}_share"] = F.count_if(F.array_contains(tools, name)) / n
    out = _windowed(df, ts, size, slide, delay).agg(n.alias("assessments"), *[m.alias(c) for c, m in measures.items()])
    return _flat(out)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in df.columns if c != "window"]
    )


def halt_signals(
    df: DataFrame,
    ts: str = "ts",
    escalated: str = "second_opinion_recommended",
    threshold: float = HALT_SHARE,
    size: str = "1 hour",
    slide: str = "5 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Windows in which the share of escalations is above the threshold."""
    n = F.count(F.lit(1))
    out = _windowed(df, ts, size, slide, delay).agg(n.alias("assessments"), F.count_if(F.col(escalated)).alias("escalations"))
    share = F.col("escalations") / F.col("assessments")
    return _flat(out.withColumn("escalation_share", share).where(F.col("escalation_share") > threshold))


def bin_counts(column: str | Column, edges: Sequence[float]) -> list[Column]:
    """Counts of the right-closed bins between the edges, with open outer bins."""
    x = F.col(column) if isinstance(column, str) else column
    bounds = [None, *edges, None]
    counts = []
    for low, high in zip(bounds, bounds[1:]):
        cond = x.isNotNull()
        if low is not None:
            cond = cond & (x > low)
        if high is not None:
            cond = cond & (x <= high)
        counts.append(F.count_if(cond))
    return counts


def reference_shares(df: DataFrame, column: str, edges: Sequence[float]) -> list[float]:
    """Bin shares of a reference period (one small row)."""
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(bin_counts(column, edges))]).first()
    total = sum(row) or 1
    return [c / total for c in row]


def drift(
    df: DataFrame,
    column: str,
    edges: Sequence[float],
    reference: Sequence[float],
    ts: str = "ts",
    size: str = "24 hours",
    slide: str = "24 hours",
    delay: str = "2 hours",
    floor: float = 1e-4,
) -> DataFrame:
    """Population stability index of a column per window against reference bin shares."""
    counts = bin_counts(column, edges)
    if len(counts) != len(reference):
        raise ValueError("reference needs one share per bin")
    grouped = _windowed(df, ts, size, slide, delay).agg(F.count(F.col(column)).alias("rows"), *[c.alias(f"__b{i}") for i, c in enumerate(counts)])
    terms = []
    for i, r in enumerate(reference):
        actual = F.greatest(F.col(f"__b{i}") / F.nullif("rows", F.lit(0)), F.lit(floor))
        expected = max(float(r), floor)
        terms.append((actual - F.lit(expected)) * F.log(actual / F.lit(expected)))
    out = grouped.withColumn("psi", sum(terms[1:], terms[0]))
    return _flat(out.drop(*[f"__b{i}" for i in range(len(counts))]))


def matched_outcomes(
    scores: DataFrame, outcomes: DataFrame, key: str = "record_id", within: str = "30 days", delay: str = "1 hour", keep_open: bool = False
) -> DataFrame:
    """Scores with the outcome that arrives within a time bound; the bound limits the join state.

    `scores` has (key, ts, confidence_level, is_loss_making_prediction), `outcomes` (key, outcome_ts,
    is_loss_making). With `keep_open` scores without an outcome come too, with missing outcome columns: on a stream once the
    watermark has passed their bound, so each score is emitted once as matched or as open.
    """
    left, right = scores, outcomes.withColumnRenamed(key, "__key")
    if scores.isStreaming:
        left, right = left.withWatermark("ts", delay), right.withWatermark("outcome_ts", delay)
    bound = (F.col("outcome_ts") >= F.col("ts")) & (F.col("outcome_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col("__key")) & bound, "left" if keep_open else "inner").drop("__key")


def calibration_with_open(matched: DataFrame) -> DataFrame:
    """`calibration` of `matched_outcomes(keep_open=True)` with the number of scores per band that stayed open."""
    closed = F.col("outcome_ts").isNotNull()
    hit = closed & (F.col("is_loss_making_prediction") == F.col("is_loss_making"))
    return matched.groupBy("confidence_level").agg(
        F.count_if(closed).alias("closed"), F.count_if(hit).alias("right"), F.count_if(~closed).alias("open"),
        (F.count_if(hit) / F.nullif(F.count_if(closed), F.lit(0))).alias("accuracy"),
    )


def calibration(matched: DataFrame) -> DataFrame:
    """Accuracy per confidence band once outcomes are known."""
    hit = F.col("is_loss_making_prediction") == F.col("is_loss_making")
    return matched.groupBy("confidence_level").agg(
        F.count(F.lit(1)).alias("closed"), F.count_if(hit).alias("right"), (F.count_if(hit) / F.count(F.lit(1))).alias("accuracy")
    )


def stream_decisions(df: DataFrame) -> DataFrame:
    """Decision columns that need no search; stateless, so rows pass straight through."""
    failed = F.col("probability_of_loss").isNull()
    p = F.coalesce("probability_of_loss", F.lit(0.5))
    out = df.withColumn("confidence_level", confidence_level(p, F.col("input_quality_flags"), F.col("model_warnings")))
    prediction = F.coalesce(F.col("probability_of_loss") >= 0.5, F.lit(False))
    return out.withColumns(
        {
            "risk_assessment": risk_label(prediction, F.col("confidence_level")),
            "retrieve": should_retrieve(F.col("confidence_level"), failed),
            "second_opinion_recommended": should_escalate(F.col("confidence_level"), F.lit(False)),
        }
    )


def first_content(df: DataFrame, text: str = "text", ts: str = "ts", delay: str = "24 hours", tie: Sequence[str] = ()) -> DataFrame:
    """One row per content hash within the watermark delay; on batch frames the earliest of all time, by `ts` and `tie`."""
    hashed = df.withColumn("content_hash", content_hash(text))
    if df.isStreaming:
        return hashed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])
    first = hashed.groupBy("content_hash").agg(F.min_by(F.struct(*df.columns), F.struct(ts, *tie)).alias("__row"))
    return first.select("__row.*", "content_hash")


#: Groups that rows of one window are dealt into while late ones are counted.
LATE_LANES = 16


def late_rows(df: DataFrame, ts: str = "ts", size: str = "24 hours", slide: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window_start, late): rows of a stream that came when their window was closed, per micro-batch and lane.

    The side sink of a monitor in append mode: with the same size, slide and delay it counts what the monitor leaves out, so
    emitted rows and late ones add up. No state is kept. Windows are dealt into lanes by the row's time, so a busy one is
    not one group.
    """
    rows = df.withWatermark(ts, delay).select(ts, F.window(ts, size, slide).alias("w"), F.pmod(F.xxhash64(ts), F.lit(LATE_LANES)).alias("lane"))
    keyed = rows.select(ts, F.col("w.start").alias("window_start"), F.unix_millis("w.end").alias("end"), "lane")

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, _ = key
        n = sum(len(b) for b in batches)
        yield pd.DataFrame({"window_start": [start], "late": [n if end <= state.getCurrentWatermarkMs() else 0]})

    grouped = keyed.groupBy("window_start", "end", "lane")
    counted = grouped.applyInPandasWithState(count, "window_start timestamp, late long", "n long", "append", GroupStateTimeout.NoTimeout)
    return counted.where("late > 0")
