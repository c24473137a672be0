"""A record table derived from orders, customers, nations and regions, with dirt by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EXPRESSIONS = {
    "record_key": "o_orderkey",
    "record_id": "concat('REC_', CAST(o_orderkey AS {text}))",
    "risk_type": """CASE WHEN o_orderkey % 25 = 1 THEN concat('  ', c_mktsegment, ' ')
        WHEN o_orderkey % 43 = 2 THEN '' WHEN o_orderkey % 47 = 3 THEN NULL
        WHEN o_orderkey % 19 = 4 THEN lower(c_mktsegment) ELSE c_mktsegment END""",
    "territory": "CASE WHEN o_orderkey % 53 = 5 THEN NULL WHEN o_orderkey % 29 = 6 THEN concat(r_name, ' ') ELSE r_name END",
    "industry": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE n_name END",
    "limit": """CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 50 = 3 THEN CAST(50 AS {real})
        WHEN o_orderkey % 61 = 7 THEN CAST(0 AS {real}) ELSE floor(o_totalprice) * 100 END""",
    "premium": """CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN CAST(0 AS {real})
        ELSE floor(o_totalprice) * (1 + o_orderkey % 5) END""",
    "broker": "CASE WHEN o_orderkey % 31 = 0 THEN 'nan' WHEN o_orderkey % 59 = 8 THEN NULL ELSE o_orderpriority END",
    "prior_claims": "CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE CAST(o_orderkey % 11 AS {real}) END",
    "years_trading": """CASE WHEN o_orderkey % 27 = 0 THEN NULL WHEN o_orderkey % 33 = 0 THEN CAST(-3 AS {real})
        ELSE CAST((o_orderkey * 7) % 51 AS {real}) END""",
    "loss_ratio": """((o_orderkey * 7919) % 2001 + (o_orderkey % 11) * 120
        + CASE WHEN o_orderkey % 71 = 0 THEN 5000 ELSE 0 END) / CAST(1000 AS {real})""",
    "is_loss_making": """(((o_orderkey * 7919) % 2001 + (o_orderkey % 11) * 120
        + CASE WHEN o_orderkey % 71 = 0 THEN 5000 ELSE 0 END > 1000) <> (o_orderkey % 60 = 9))""",
}

_JOINED = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""

RECORDS = (
    "records AS (SELECT "
    + ", ".join(f'{e.format(text="VARCHAR", real="DOUBLE")} AS "{n}"' for n, e in _EXPRESSIONS.items())
    + f" FROM {_JOINED})"
)


def records(t) -> DataFrame:
    joined = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(*[F.expr(e.format(text="STRING", real="DOUBLE")).alias(n) for n, e in _EXPRESSIONS.items()])


# Cleaned categories and numbers as SQL text, repeated by several checks.
TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean_sql(column: str, fill: str = "Unknown") -> str:
    trimmed = TRIM.format(c=f'"{column}"')
    return f"coalesce(CASE WHEN {trimmed} NOT IN ('', 'nan', '<na>') THEN {trimmed} END, '{fill}')"


CLEANED = f"""{RECORDS},
    cleaned AS (SELECT record_key, record_id, {', '.join(f'{clean_sql(c)} AS {c}' for c in ('risk_type', 'territory', 'industry', 'broker'))},
        "limit", premium, prior_claims, years_trading, loss_ratio, is_loss_making FROM records),
    medians AS (SELECT quantile_cont(CASE WHEN years_trading < 0 THEN 0 ELSE years_trading END, 0.5) AS y,
        quantile_cont(premium, 0.5) AS p, quantile_cont("limit", 0.5) AS l FROM cleaned),
    imputed AS (SELECT record_key, record_id, risk_type, territory, industry, broker, loss_ratio, is_loss_making,
        CAST(prior_claims IS NULL AS INT) AS prior_claims_missing,
        CAST(coalesce(years_trading < 0, FALSE) AS INT) AS years_trading_invalid,
        CAST(years_trading IS NULL AS INT) AS years_trading_missing,
        CASE WHEN prior_claims IS NULL OR prior_claims < 0 THEN 0.0::DOUBLE ELSE prior_claims END AS prior_claims,
        coalesce(CASE WHEN years_trading < 0 THEN 0.0::DOUBLE ELSE years_trading END, y) AS years_trading,
        CASE WHEN coalesce(premium, p) < 0 THEN 0.0::DOUBLE ELSE coalesce(premium, p) END AS premium,
        CASE WHEN coalesce("limit", l) < 1 THEN 1.0::DOUBLE ELSE coalesce("limit", l) END AS "limit"
        FROM cleaned, medians),
    engineered AS (SELECT *, premium / "limit" AS premium_to_limit, ln(1 + "limit") AS log_limit,
        ln(1 + premium) AS log_premium,
        prior_claims / (CASE WHEN years_trading < 1 THEN 1.0::DOUBLE ELSE years_trading END) AS claims_per_year,
        CASE WHEN years_trading IS NULL OR years_trading <= -0.1 THEN 'nan' WHEN years_trading <= 3 THEN 'startup'
            WHEN years_trading <= 10 THEN 'early' WHEN years_trading <= 25 THEN 'established'
            ELSE 'mature' END AS experience_band FROM imputed)"""
