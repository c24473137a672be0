"""Discretizers and rare-category grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.records import RECORDS, records
from riskloom.catalog.registry import query
from riskloom.operators import binning as bn

_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def _keyed(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_COLS)


_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _label(column: str, edges: list[str]) -> str:
    total = " + ".join(f"CAST({column} > {e} AS INT)" for e in edges)
    return f"concat(CAST({total} AS VARCHAR), '.0') AS {column}__bin"


@query(
    "bn1_equal_width",
    f"""WITH m AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in _COLS)} FROM lineitem)
        SELECT {_KEYS}, {', '.join(_label(c, [f'(lo_{c} + {i} * (hi_{c} - lo_{c}) / 4)' for i in (1, 2, 3)]) for c in _COLS)}
        FROM lineitem, m""",
)
def _(t):
    df = _keyed(t)
    out = bn.Discretizer(n_bins=4, columns=list(_COLS)).fit(df).transform(df)
    return out.drop(*_COLS)


@query(
    "bn2_quantile_bins",
    f"""WITH m AS (SELECT {', '.join(f'quantile_cont({c}, {q}) AS q{i}_{c}' for c in _COLS for i, q in enumerate((0.2, 0.4, 0.6, 0.8)))}
        FROM lineitem)
        SELECT {_KEYS}, {', '.join(_label(c, [f'q{i}_{c}' for i in range(4)]) for c in ('l_quantity', 'l_extendedprice'))}
        FROM lineitem, m""",
)
def _(t):
    df = _keyed(t)
    out = bn.QuantileDiscretizer(n_bins=5, columns=["l_quantity", "l_extendedprice"]).fit(df).transform(df)
    return out.drop(*_COLS)


@query(
    "bn3_custom_bins",
    f"""SELECT {_KEYS}, concat(CASE WHEN l_quantity > 10 AND l_quantity <= 30 THEN 1 WHEN l_quantity > 30 AND l_quantity <= 45 THEN 2
        ELSE 0 END, '.0') AS l_quantity__bin, concat(CAST(l_discount > 0.05 AS INT), '.0') AS l_discount__bin FROM lineitem""",
)
def _(t):
    df = _keyed(t)
    stage = bn.CustomDiscretizer(bins={"l_quantity": [0, 10, 30, 45], "l_discount": [float("-inf"), 0.05, float("inf")]})
    return stage.fit(df).transform(df).drop(*_COLS)


@query(
    "bn4_bins_in_place",
    f"""WITH {RECORDS}, m AS (SELECT min(prior_claims) AS lo, max(prior_claims) AS hi FROM records)
        SELECT record_key, concat(CASE WHEN prior_claims IS NULL THEN 0 ELSE
            CAST(prior_claims > lo + (hi - lo) / 3 AS INT) + CAST(prior_claims > lo + 2 * (hi - lo) / 3 AS INT) END, '.0') AS prior_claims
        FROM records, m""",
)
def _(t):
    df = records(t).select("record_key", "prior_claims")
    return bn.Discretizer(n_bins=3, inplace=True, columns=["prior_claims"]).fit(df).transform(df)


@query(
    "bn5_bins_of_given_columns",
    """SELECT c_custkey, concat(CAST(c_acctbal > 0 AS INT) + CAST(c_acctbal > 5000 AS INT), '.0') AS c_acctbal__bin,
        concat(CAST(c_nationkey > 9 AS INT), '.0') AS c_nationkey__bin FROM customer""",
)
def _(t):
    inf = float("inf")
    df = t.customer.select("c_custkey", "c_acctbal", "c_nationkey")
    stage = bn.CustomDiscretizer(bins={"c_acctbal": [-inf, 0, 5000, inf], "c_nationkey": [-inf, 9, inf]})
    return stage.fit(df).transform(df).select("c_custkey", "c_acctbal__bin", "c_nationkey__bin")


_RARE = ("risk_type", "industry", "broker")


@query(
    "bn6_rare_events",
    f"WITH {RECORDS}, "
    + ", ".join(
        f"k_{c} AS (SELECT {c} AS v FROM records WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.04 * (SELECT count({c}) FROM records))"
        for c in _RARE
    )
    + f" SELECT record_key, {', '.join(f'''CASE WHEN {c} IN (SELECT v FROM k_{c}) THEN {c} ELSE 'OTHERS' END AS {c}''' for c in _RARE)} FROM records",
)
def _(t):
    df = records(t).select("record_key", *_RARE)
    return bn.BinRareEvents(min_ratio=0.04, columns=list(_RARE)).fit(df).transform(df)
