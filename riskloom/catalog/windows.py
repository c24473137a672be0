"""Time features and rolling windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.registry import query
from riskloom.operators import temporal as tm

_SEVEN = "WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)"

# Means over 2^k rows end in an exact 5; moving both sides off it keeps rounding out of the check.
_OFF_TIES = 0.00000000017


@query(
    "tw1_rolling_count",
    f"SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS count_user_id_7d FROM events {_SEVEN}",
)
def _(t):
    out = tm.RollingFeatures("ts").count_of_last_n_days(t.events.select("event_id", "user_id", "ts"), "user_id", 7)
    return out.select("event_id", "count_user_id_7d")


@query(
    "tw2_rolling_sum",
    f"SELECT event_id, round(sum(value) OVER w, 6) AS sum_user_id_7 FROM events {_SEVEN}",
)
def _(t):
    df = t.events.select("event_id", "user_id", "ts", "value")
    out = tm.RollingFeatures("ts").sum_of_last_n_days(df, "user_id", "value", 7)
    return out.select("event_id", F.round("sum_user_id_7", 6).alias("sum_user_id_7"))


@query(
    "tw3_rolling_mean",
    f"SELECT event_id, round(avg(value) OVER w, 9) AS mean_user_id_7d FROM events {_SEVEN}",
)
def _(t):
    df = t.events.select("event_id", "user_id", "ts", "value")
    out = tm.RollingFeatures("ts").mean_of_last_n_days(df, "user_id", "value", 7)
    return out.select("event_id", F.round("mean_user_id_7d", 9).alias("mean_user_id_7d"))


def rolling_activity(t):
    """Count, sum and mean of the last seven days per user (the smoke query)."""
    df = t.events.select("event_id", "user_id", "ts", "value")
    out = tm.RollingFeatures("ts").fit(df, "user_id", "value", 7)
    return out.select(
        "event_id",
        "count_user_id_7d",
        F.round("sum_user_id_7", 6).alias("sum_user_id_7"),
        F.round("mean_user_id_7d", 9).alias("mean_user_id_7d"),
    )


query(
    "tw4_rolling_fit",
    f"""SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS count_user_id_7d,
        round(sum(value) OVER w, 6) AS sum_user_id_7, round(avg(value) OVER w, 9) AS mean_user_id_7d
        FROM events {_SEVEN}""",
)(rolling_activity)


@query(
    "tw4_rolling_related",
    """SELECT event_id,
        CAST(count(*) OVER u AS BIGINT) AS count_user_id_30d, round(sum(value) OVER u, 6) AS sum_user_id_30,
        round(avg(value) OVER u, 9) AS mean_user_id_30d,
        CAST(count(*) OVER e AS BIGINT) AS count_event_type_30d, round(sum(value) OVER e, 4) AS sum_event_type_30,
        round(avg(value) OVER e + 0.00000000017, 9) AS mean_event_type_30d
        FROM events
        WINDOW u AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW),
               e AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)""",
)
def _(t):
    df = t.events.select("event_id", "user_id", "event_type", "ts", "value")
    out = tm.rolling_related_features(df, "ts", "value", ["user_id", "event_type"], 30)
    return out.select(
        "event_id",
        "count_user_id_30d",
        F.round("sum_user_id_30", 6).alias("sum_user_id_30"),
        F.round("mean_user_id_30d", 9).alias("mean_user_id_30d"),
        "count_event_type_30d",
        F.round("sum_event_type_30", 4).alias("sum_event_type_30"),
        F.round(F.col("mean_event_type_30d") + _OFF_TIES, 9).alias("mean_event_type_30d"),
    )


@query(
    "tw5_rolling_target",
    """SELECT o_orderkey,
        sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w AS bad_o_custkey FROM
        (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders)
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 150 DAY PRECEDING AND CURRENT ROW)""",
)
def _(t):
    df = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("bad")
    )
    return tm.rolling_target(df, "o_orderdate", "bad", ["o_custkey"], 150).select("o_orderkey", "bad_o_custkey")


_GRACES = (1, 7, 30, 45, 60)


@query(
    "tw6_rolling_with_grace",
    "SELECT o_orderkey, "
    + ", ".join(
        f"""coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate RANGE BETWEEN INTERVAL '149 days 23:59:59.999999' PRECEDING
        AND INTERVAL {g} DAY PRECEDING), 0.0::DOUBLE) AS bad_o_custkey_{g}d"""
        for g in _GRACES
    )
    + " FROM orders",
)
def _(t):
    df = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("bad")
    )
    out = tm.rolling_with_grace(df, "o_orderdate", "bad", ["o_custkey"], _GRACES)
    return out.select("o_orderkey", *[f"bad_o_custkey_{g}d" for g in _GRACES])


@query(
    "tw7_rolling_first_of_ties",
    """WITH e AS (SELECT event_id, event_type, date_trunc('hour', ts) AS hour, value FROM events),
        p AS (SELECT event_type, hour, count(*) AS n, sum(value) AS s, min_by(value, event_id) AS f
              FROM e GROUP BY 1, 2),
        r AS (SELECT event_type, hour, n, s, f, sum(n) OVER w AS wn, sum(s) OVER w AS ws FROM p
              WINDOW w AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW))
        SELECT event_id, CAST(wn - n + 1 AS BIGINT) AS count_event_type_1d, round(ws - s + f, 4) AS sum_event_type_1
        FROM e JOIN r USING (event_type, hour)""",
)
def _(t):
    df = t.events.select(
        "event_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "value"
    )
    rolling = tm.RollingFeatures("hour", ties="first", order_col="event_id")
    out = rolling.fit(df, "event_type", "value", 1)
    return out.select("event_id", "count_event_type_1d", F.round("sum_event_type_1", 4).alias("sum_event_type_1"))


@query(
    "tw8_time_features",
    """SELECT event_id, CAST(hour(ts) AS INT) AS ts__hour_of_day, CAST(day(ts) AS INT) AS ts__day_of_month,
        CAST(isodow(ts) - 1 AS INT) AS ts__day_of_week, CAST(weekofyear(ts) AS INT) AS ts__week_of_year,
        CAST(month(ts) AS INT) AS ts__month_of_year,
        round(sin((hour(ts) + minute(ts) / 60.0) / 24.0 * 2 * pi()), 6) + 0.0::DOUBLE AS ts__hour_sin,
        round(cos((hour(ts) + minute(ts) / 60.0) / 24.0 * 2 * pi()), 6) + 0.0::DOUBLE AS ts__hour_cos,
        round(sin((day(ts) + hour(ts) / 24.0) / 365.0 * 2 * pi()), 6) + 0.0::DOUBLE AS ts__day_sin,
        round(cos((day(ts) + hour(ts) / 24.0) / 365.0 * 2 * pi()), 6) + 0.0::DOUBLE AS ts__day_cos,
        round(sin((month(ts) + day(ts) / 30.0 - 1) / 12.0 * 2 * pi()), 6) + 0.0::DOUBLE AS ts__month_sin,
        round(cos((month(ts) + day(ts) / 30.0 - 1) / 12.0 * 2 * pi()), 6) + 0.0::DOUBLE AS ts__month_cos
        FROM events""",
)
def _(t):
    out = tm.time_features(t.events.select("event_id", "ts"), ["ts"])
    rounded = [F.round(c, 6).alias(c) if c.endswith(("_sin", "_cos")) else F.col(c) for c in out.columns if c != "ts"]
    return out.select(*rounded)


@query(
    "tw9_time_of_day",
    """SELECT event_id, CASE WHEN hour(ts) > 6 AND hour(ts) < 18 THEN 'day' ELSE 'night' END AS time_of_day_ts
        FROM events""",
)
def _(t):
    return tm.time_of_day(t.events.select("event_id", "ts"), "ts").select("event_id", "time_of_day_ts")


@query(
    "tw10_age",
    """SELECT o_orderkey,
        CAST(floor(epoch_us(TIMESTAMP '2024-06-01' - o_orderdate) / 31556952000000) AS INT) AS age,
        CAST(CASE WHEN strftime(o_orderdate, '%m%d') <= '0601' THEN 2024 - year(o_orderdate)
             ELSE 2023 - year(o_orderdate) END AS INT) AS age_calendar
        FROM orders""",
)
def _(t):
    at = F.lit("2024-06-01").cast("timestamp")
    born = F.col("o_orderdate").cast("timestamp")
    return t.orders.select(
        "o_orderkey",
        tm.age_in_years(born, at).alias("age"),
        tm.age_in_years(born, at, calendar=True).alias("age_calendar"),
    )
