"""Monitors on the events stream; each query runs the stream to its end and reads its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.session import shared_folder
from riskloom.streaming import monitors as mo
from riskloom.streaming import runs as rn

_CONF = "CASE event_type WHEN 'error' THEN 'low' WHEN 'view' THEN 'medium' ELSE 'high' END"
_ESC = "(event_type = 'error' OR user_id % 4 = 0)"


def _stream(t):
    events = rn.table_stream(t.spark, t.path("events"), t.events.schema)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _decided(df):
    low = F.col("event_type") == "error"
    tools = F.when(low, F.array(F.lit("predict_loss"), F.lit("retrieve_similar_records"))).otherwise(F.array(F.lit("predict_loss")))
    return df.select("event_id", "ts", F.expr(_CONF).alias("confidence_level"), F.expr(_ESC).alias("second_opinion_recommended"), tools.alias("tools_used"))


def _paths(t):
    base = shared_folder(t.spark, "streams", uuid.uuid4().hex)
    return f"{base}/rows", f"{base}/checkpoint"


def _start(df):
    return F.unix_seconds("window_start").alias("window_start")


_SHARES = ("high_share", "medium_share", "low_share", "escalation_share", "predict_loss_share", "retrieve_similar_records_share")


@query(
    "sm1_decision_shares",
    f"""WITH w AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - i * 3600 AS window_start, {_CONF} AS c, {_ESC} AS e FROM events, range(24) AS r(i))
        SELECT window_start, CAST(count(*) AS BIGINT) AS assessments, round(count(*) FILTER (c = 'high') / count(*)::DOUBLE, 6) AS high_share,
            round(count(*) FILTER (c = 'medium') / count(*)::DOUBLE, 6) AS medium_share, round(count(*) FILTER (c = 'low') / count(*)::DOUBLE, 6) AS low_share,
            round(count(*) FILTER (e) / count(*)::DOUBLE, 6) AS escalation_share, 1.0::DOUBLE AS predict_loss_share,
            round(count(*) FILTER (c = 'low') / count(*)::DOUBLE, 6) AS retrieve_similar_records_share FROM w GROUP BY 1""",
)
def _(t):
    out = rn.update_to(mo.decision_shares(_decided(_stream(t))), *_paths(t), ["window_start"])
    return out.select(_start(out), "assessments", *[F.round(c, 6).alias(c) for c in _SHARES])


@query(
    "sm2_halt_signals",
    f"""WITH w AS (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 - i * 300 AS window_start, {_ESC} AS e FROM events, range(12) AS r(i))
        SELECT window_start, CAST(count(*) AS BIGINT) AS assessments, CAST(count(*) FILTER (e) AS BIGINT) AS escalations FROM w
        GROUP BY 1 HAVING count(*) FILTER (e) / count(*)::DOUBLE > 0.5""",
)
def _(t):
    # no watermark delay can close the last hour of a finite stream, so updates are kept and the last
    # state of a window decides
    counts = mo.halt_signals(_decided(_stream(t)), threshold=-1.0)
    out = rn.update_to(counts, *_paths(t), ["window_start"]).where("escalation_share > 0.5")
    return out.select(_start(out), "assessments", "escalations")


_EDGES = (5.0, 10.0, 20.0, 40.0)
_BINS = ("value <= 5", "value > 5 AND value <= 10", "value > 10 AND value <= 20", "value > 20 AND value <= 40", "value > 40")


@query(
    "sm3_drift",
    f"""WITH ref AS (SELECT {', '.join(f"greatest(count(*) FILTER ({b}) / count(*)::DOUBLE, 0.0001) AS r{i}" for i, b in enumerate(_BINS))} FROM events WHERE event_id % 2 = 0),
        d AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, count(*) AS n, {', '.join(f"greatest(count(*) FILTER ({b}) / count(*)::DOUBLE, 0.0001) AS a{i}" for i, b in enumerate(_BINS))} FROM events GROUP BY 1)
        SELECT window_start, CAST(n AS BIGINT) AS rows, round({' + '.join(f'(a{i} - r{i}) * ln(a{i} / r{i})' for i in range(len(_BINS)))}, 8) AS psi FROM d, ref""",
)
def _(t):
    reference = mo.reference_shares(t.events.where("event_id % 2 = 0"), "value", _EDGES)
    out = rn.update_to(mo.drift(_stream(t), "value", _EDGES, reference), *_paths(t), ["window_start"])
    return out.select(_start(out), "rows", F.round("psi", 8).alias("psi"))


@query(
    "sm4_calibration",
    f"""WITH s AS (SELECT {_CONF} AS confidence_level, (value > 15) = (event_id % 3 = 0) AS hit FROM events WHERE event_id % 5 <> 4)
        SELECT confidence_level, CAST(count(*) AS BIGINT) AS closed, CAST(count(*) FILTER (hit) AS BIGINT) AS "right", round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS accuracy FROM s GROUP BY 1""",
)
def _(t):
    scores = _stream(t).select("event_id", "ts", F.expr(_CONF).alias("confidence_level"), (F.col("value") > 15).alias("is_loss_making_prediction"))
    # outcomes follow after one hour; every fifth comes too late
    late = F.when(F.col("event_id") % 5 == 4, F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    outcomes = _stream(t).select("event_id", (F.col("ts") + late).alias("outcome_ts"), (F.col("event_id") % 3 == 0).alias("is_loss_making"))
    matched = mo.matched_outcomes(scores, outcomes, "event_id", "2 DAYS")
    out = mo.calibration(rn.append_to(matched, *_paths(t)))
    return out.select("confidence_level", "closed", "right", F.round("accuracy", 6).alias("accuracy"))


@query(
    "sm5_stream_decisions",
    """WITH b AS (SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN (event_id % 101) / 100.0::DOUBLE END AS p FROM events),
        c AS (SELECT *, CASE WHEN abs(coalesce(p, 0.5) - 0.5) >= 0.3::DOUBLE THEN 'high' WHEN abs(coalesce(p, 0.5) - 0.5) >= 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS confidence_level FROM b)
        SELECT event_id, confidence_level, CASE WHEN confidence_level = 'low' THEN 'unclear' WHEN p >= 0.5 THEN 'likely_loss' ELSE 'unlikely_loss' END AS risk_assessment,
            confidence_level = 'low' AS second_opinion_recommended FROM c""",
)
def _(t):
    none = F.array().cast("array<string>")
    scored = _stream(t).select(
        "event_id", F.when(F.col("event_id") % 50 != 7, (F.col("event_id") % 101) / F.lit(100.0)).alias("probability_of_loss"),
        none.alias("input_quality_flags"), none.alias("model_warnings"),
    )
    decided = mo.stream_decisions(scored).select("event_id", "confidence_level", "risk_assessment", "second_opinion_recommended")
    return rn.append_to(decided, *_paths(t))


@query(
    "sm5_first_content_rows",
    """SELECT event_id, props AS text FROM (SELECT event_id, props, row_number() OVER (
        PARTITION BY sha256(regexp_replace(trim(lower(props)), '[^a-z0-9_ ]', '', 'g')) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""",
)
def _(t):
    rows = t.events.select("event_id", "ts", F.col("props").alias("text"))
    return mo.first_content(rows, tie=["event_id"]).select("event_id", "text")


@query(
    "sm5_first_content",
    "SELECT count(DISTINCT sha256(regexp_replace(trim(lower(props)), '[^a-z0-9_ ]', '', 'g'))) AS contents FROM events",
)
def _(t):
    rows = _stream(t).select("event_id", "ts", F.col("props").alias("text"))
    kept = mo.first_content(rows, delay="60 days").select("event_id", "content_hash")
    return rn.append_to(kept, *_paths(t)).agg(F.count(F.lit(1)).alias("contents"))


_LATE = 11  # every eleventh event comes a part later
_ARRIVED = f"""span AS (SELECT min(epoch(ts)) AS t0, (max(epoch(ts)) - min(epoch(ts)) + 1) / 4.0::DOUBLE AS w FROM events),
    arrived AS (SELECT e.*, least(3, CAST(floor((epoch(ts) - t0) / w) AS INT) + CASE WHEN event_id % {_LATE} = 0 THEN 1 ELSE 0 END) AS part FROM events e, span),
    marks AS (SELECT part, max(max(epoch(ts))) OVER (ORDER BY part) - 7200 AS mark FROM arrived GROUP BY part),
    cells AS (SELECT a.event_id, event_type, user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - i * 3600 AS window_start,
            CAST(epoch(date_trunc('hour', ts)) AS BIGINT) - i * 3600 + 86400 <= coalesce(m.mark, 0) AS late
        FROM arrived a LEFT JOIN marks m ON m.part = a.part - 1, range(24) AS r(i)),
    ends AS (SELECT max(mark) AS mark FROM marks)"""


def _arrivals(t, monitor, rows):
    """Events written in four parts, some a part too late; after each part the stream runs on from its checkpoint."""
    path, checkpoint = _paths(t)
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts") / 1_000_000
    ends = events.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    quarter = F.floor((at - ends["low"]) / ((ends["high"] - ends["low"] + 1) / 4)) + F.when(F.col("event_id") % _LATE == 0, 1).otherwise(0)
    parts = events.withColumn("part", F.least(F.lit(3), quarter))
    for i in range(4):
        parts.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{path}/in")
        out = rn.append_to(monitor(rows(rn.file_stream(t.spark, f"{path}/in", events.schema))), f"{path}/out", checkpoint)
    return out


@query(
    "sm1_closed_windows",
    f"""WITH {_ARRIVED}, w AS (SELECT window_start, {_CONF} AS c, {_ESC} AS e FROM cells WHERE NOT late)
        SELECT window_start, CAST(count(*) AS BIGINT) AS assessments, round(count(*) FILTER (c = 'high') / count(*)::DOUBLE, 6) AS high_share,
            round(count(*) FILTER (e) / count(*)::DOUBLE, 6) AS escalation_share FROM w, ends WHERE window_start + 86400 <= mark GROUP BY 1""",
)
def _(t):
    out = _arrivals(t, mo.decision_shares, _decided)
    return out.select(_start(out), "assessments", *[F.round(c, 6).alias(c) for c in ("high_share", "escalation_share")])


@query("sm1_late_rows", f"WITH {_ARRIVED} SELECT window_start, CAST(count(*) AS BIGINT) AS late FROM cells WHERE late GROUP BY 1")
def _(t):
    out = _arrivals(t, mo.late_rows, lambda df: df.select("ts"))
    return out.groupBy(_start(out)).agg(F.sum("late").alias("late"))


@query(
    "sm4_open_scores",
    f"""WITH s AS (SELECT {_CONF} AS c, ts, event_id % 5 <> 4 AS closed, (value > 15) = (event_id % 3 = 0) AS hit FROM events),
        m AS (SELECT max(epoch(ts)) - 3600 AS mark FROM events)
        SELECT c AS confidence_level, CAST(count(*) FILTER (closed) AS BIGINT) AS closed, CAST(count(*) FILTER (closed AND hit) AS BIGINT) AS "right",
            CAST(count(*) FILTER (NOT closed) AS BIGINT) AS open, round(count(*) FILTER (closed AND hit) / nullif(count(*) FILTER (closed), 0)::DOUBLE, 6) AS accuracy
        FROM s, m WHERE closed OR epoch(ts) + 172800 < mark GROUP BY 1""",
)
def _(t):
    scores = _stream(t).select("event_id", "ts", F.expr(_CONF).alias("confidence_level"), (F.col("value") > 15).alias("is_loss_making_prediction"))
    # every fifth outcome comes a day after the bound; a score is open once the watermark of both streams is past it
    late = F.when(F.col("event_id") % 5 == 4, F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    outcomes = _stream(t).select("event_id", (F.col("ts") + late).alias("outcome_ts"), (F.col("event_id") % 3 == 0).alias("is_loss_making"))
    matched = mo.matched_outcomes(scores, outcomes, "event_id", "2 DAYS", keep_open=True)
    out = mo.calibration_with_open(rn.append_to(matched, *_paths(t)))
    return out.select("confidence_level", "closed", "right", "open", F.round("accuracy", 6).alias("accuracy"))
