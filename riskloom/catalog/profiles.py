"""Profiling tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.records import CLEANED, RECORDS, clean_sql, records
from riskloom.catalog.registry import query
from riskloom.functions.hashing import MODULUS, MULTIPLIER
from riskloom.operators import cleaning as cl
from riskloom.operators import profiling as pf

_COLUMNS = {
    "record_key": "bigint", "risk_type": "string", "industry": "string", "limit": "double",
    "premium": "double", "prior_claims": "double", "years_trading": "double",
}


@query(
    "ag1_column_profile",
    f"WITH {RECORDS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{d}' AS dtype, CAST(count(*) - count("{c}") AS BIGINT) AS missing_count,
        round((count(*) - count("{c}")) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
        CAST(count(DISTINCT "{c}") + CASE WHEN count(*) > count("{c}") THEN 1 ELSE 0 END AS BIGINT) AS n_unique FROM records"""
        for c, d in _COLUMNS.items()
    ),
)
def _(t):
    return pf.column_profile(records(t).select(*_COLUMNS))


@query(
    "ag2_class_balance",
    f"""WITH {RECORDS} SELECT industry, CAST(count(*) AS BIGINT) AS count,
        round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM records), 2) AS pct FROM records GROUP BY 1""",
)
def _(t):
    return pf.class_balance(records(t).select("industry"), "industry")


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_STATS = ("mean", "std", "min", "p5", "p50", "p95", "max")


@query(
    "ag3_numeric_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.05), 6) AS p5,
        round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95, max({c}) AS max FROM lineitem"""
        for c in _NUMERIC
    ),
)
def _(t):
    out = pf.numeric_summary(t.lineitem.select(*_NUMERIC))
    return out.select("feature", "count", *[F.round(c, 6).alias(c) for c in _STATS])


@query(
    "ag4_rate_by_group",
    f"""WITH {RECORDS} SELECT lower({clean_sql('industry', 'unknown')}) AS industry, CAST(count(*) AS BIGINT) AS count,
        round(avg(CAST(is_loss_making AS INT)), 3) AS loss_rate FROM records GROUP BY 1""",
)
def _(t):
    df = cl.normalise_categories(records(t).select("industry", "is_loss_making"), ["industry"])
    return pf.rate_by_group(df, "industry", "is_loss_making")


@query(
    "ag5_value_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {c} AS value, CAST(count(*) AS BIGINT) AS count,
        round(count(*) * 100.0::DOUBLE / (SELECT count({c}) FROM {tb}), 4) AS pct FROM {tb} WHERE {c} IS NOT NULL GROUP BY 2"""
        for c, tb in (("l_returnflag", "lineitem"), ("l_linestatus", "lineitem"))
    ),
)
def _(t):
    return pf.value_counts(t.lineitem.select("l_returnflag", "l_linestatus"), digits=4)


@query(
    "ag5_value_counts_top",
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS feature, {c} AS value, CAST(count(*) AS BIGINT) AS count,
        round(count(*) * 100.0::DOUBLE / (SELECT count({c}) FROM part), 4) AS pct FROM part GROUP BY 2 ORDER BY count DESC, value LIMIT 4)"""
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(t):
    return pf.value_counts(t.part.select("p_name", "p_brand", "p_type"), top_n=4, digits=4)


@query(
    "ag6_top_categories",
    """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1
        ORDER BY revenue DESC, l_suppkey LIMIT 10""",
)
def _(t):
    by = t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return pf.top_by(by, "revenue", 10, ["l_suppkey"])


@query(
    "ag7_crosstab",
    f"WITH {RECORDS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, coalesce({c}, 'NA') AS value, CAST(count(*) FILTER (NOT is_loss_making) AS BIGINT) AS "False",
        CAST(count(*) FILTER (is_loss_making) AS BIGINT) AS "True" FROM records GROUP BY 2"""
        for c in ("territory", "broker")
    ),
)
def _(t):
    return pf.crosstab(records(t).select("territory", "broker", "is_loss_making"), "is_loss_making", ["territory", "broker"])


_CORR = ("limit", "loss_ratio", "premium", "prior_claims", "years_trading")


@query(
    "ag8_correlations",
    f"WITH {RECORDS} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS row_feature, '{b}' AS column_feature, round(corr("{a}", "{b}"), 6) AS correlation FROM records"""
        for a in _CORR
        for b in _CORR
    ),
)
def _(t):
    out = pf.correlation_matrix(records(t), _CORR)
    return out.select("row_feature", "column_feature", F.round("correlation", 6).alias("correlation"))


@query(
    "ag9_group_quantiles",
    f"""SELECT l_returnflag, q.quantile, round(q.value, 6) AS value FROM (
        SELECT l_returnflag, unnest(list_zip({pf.QUANTILE_GRID}::DOUBLE[], quantile_cont(l_extendedprice, {pf.QUANTILE_GRID}))) AS z
        FROM lineitem GROUP BY 1), LATERAL (SELECT z[1] AS quantile, z[2] AS value) q""",
)
def _(t):
    out = pf.group_quantiles(t.lineitem.select("l_returnflag", "l_extendedprice"), "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", "quantile", F.round("value", 6).alias("value"))


def _hist_sql(bins: int, by: str | None) -> str:
    extra, group = (f"{by}, ", f", {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {extra}CAST(least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) AS bin,
        round(lo + least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1}) * ((hi - lo) / {bins}), 6) AS low,
        round(lo + (least(floor(({c} - lo) / ((hi - lo) / {bins})), {bins - 1}) + 1) * ((hi - lo) / {bins}), 6) AS high,
        CAST(count(*) AS BIGINT) AS count FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem)
        GROUP BY ALL"""
        for c in ("l_extendedprice", "l_quantity")
    )


@query("ag10_histogram", _hist_sql(30, None))
def _(t):
    out = pf.histogram(t.lineitem, ["l_extendedprice", "l_quantity"])
    return out.select("feature", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query("ag10_histogram_by_class", _hist_sql(10, "l_returnflag"))
def _(t):
    out = pf.histogram(t.lineitem, ["l_extendedprice", "l_quantity"], 10, "l_returnflag")
    return out.select("feature", "l_returnflag", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query(
    "ag11_density",
    """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
        b AS (SELECT o_orderstatus, least(floor((o_totalprice - r.lo) / ((r.hi - r.lo) / 512)), 511) AS bin, count(*) AS n,
            avg(o_totalprice) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders, r GROUP BY 1, 2),
        s AS (SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
            stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h FROM orders GROUP BY 1),
        x AS (SELECT s.*, lo - 3 * h + i * (hi - lo + 6 * h) / 199 AS x FROM s, range(200) AS g(i))
        SELECT 'o_totalprice' AS feature, x.o_orderstatus, round(x.x, 4) AS x,
            round(1e6 * sum(b.n * exp(-0.5 * pow((x.x - b.m) / x.h, 2))) / (any_value(x.n) * any_value(x.h) * sqrt(2 * pi())), 6) AS density_per_million
        FROM x JOIN b USING (o_orderstatus) GROUP BY x.o_orderstatus, x.x""",
)
def _(t):
    out = pf.density(t.orders, ["o_totalprice"], "o_orderstatus")
    return out.select(
        "feature", "o_orderstatus", F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_per_million")
    )


@query(
    "ag12_box_summary",
    " UNION ALL ".join(
        f"""(WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM lineitem)
        SELECT '{c}' AS feature, min({c}) AS min, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3, max({c}) AS max,
        min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
        max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
        CAST(count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
        FROM lineitem, q)"""
        for c in _NUMERIC
    ),
)
def _(t):
    return pf.box_summary(t.lineitem, _NUMERIC)


@query(
    "ag13_over_time",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, round(avg(o_totalprice), 4) AS o_totalprice
        FROM orders GROUP BY 1""",
)
def _(t):
    out = pf.over_time(t.orders, "o_orderdate", ["o_totalprice"], "mean", "month")
    return out.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.round("o_totalprice", 4).alias("o_totalprice"))


@query(
    "ag14_scatter_sample",
    f"""SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
        ORDER BY ((o_orderkey % {MODULUS}) * {MULTIPLIER} + 12345) % {MODULUS}, o_orderkey LIMIT 500""",
)
def _(t):
    return pf.scatter_sample(t.orders, ["o_totalprice", "o_orderstatus"], "o_orderkey", 500, method="linear")


@query("ag15_distinct_keys", "SELECT CAST(count(DISTINCT l_orderkey) AS BIGINT) AS distinct_keys FROM lineitem")
def _(t):
    return pf.distinct_keys(t.lineitem, "l_orderkey")
