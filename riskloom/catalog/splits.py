"""Splits, samples and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.records import records
from riskloom.catalog.registry import query
from riskloom.functions.hashing import MODULUS, MULTIPLIER
from riskloom.operators.cleaning import NumericImputer
from riskloom.operators import selection as fs
from riskloom.operators import splits as sp
from riskloom.operators.profiling import top_by


def hash_sql(key: str, seed: int) -> str:
    return f"((({key} % {MODULUS}) * {MULTIPLIER} + {seed} * 69621 + 12345) % {MODULUS})"


def _tag(**parts):
    frames = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


_KEYS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")


def _orders(t):
    return t.orders.select(*_KEYS)


@query(
    "sp1_group_split",
    f"""WITH i AS (SELECT o_custkey, row_number() OVER (ORDER BY {hash_sql('o_custkey', 5)}, o_custkey) AS r, count(*) OVER () AS n
            FROM (SELECT DISTINCT o_custkey FROM orders))
        SELECT o_orderkey, CASE WHEN r <= ceil(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS part FROM orders JOIN i USING (o_custkey)""",
)
def _(t):
    train, test = sp.group_split(_orders(t), "o_custkey", 0.3, 5, "linear")
    return _tag(train=train, test=test).select("o_orderkey", "part")


@query(
    "sp1_group_split_threshold",
    f"""SELECT o_orderkey, CASE WHEN {hash_sql('o_custkey', 5)} < {int(0.3 * MODULUS)} THEN 'test' ELSE 'train' END AS part FROM orders""",
)
def _(t):
    train, test = sp.group_split(_orders(t), "o_custkey", 0.3, 5, "linear", exact=False)
    return _tag(train=train, test=test).select("o_orderkey", "part")


@query(
    "sp1_group_split_with_missing",
    f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS c FROM orders),
        i AS (SELECT c, row_number() OVER (ORDER BY {hash_sql('c', 5)}, c) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT c FROM o WHERE c IS NOT NULL))
        SELECT o_orderkey, CASE WHEN r <= ceil(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS part FROM o LEFT JOIN i USING (c)""",
)
def _(t):
    rows = _orders(t).withColumn("c", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    train, test = sp.group_split(rows, "c", 0.3, 5, "linear")
    return _tag(train=train, test=test).select("o_orderkey", "part")


@query(
    "sp2_random_split",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey', 100)}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, CASE WHEN r <= ceil(0.3::DOUBLE * n) THEN 'test' ELSE 'train' END AS part FROM r""",
)
def _(t):
    train, test = sp.random_split(_orders(t), "o_orderkey", 0.3, 100, "linear")
    return _tag(train=train, test=test).select("o_orderkey", "part")


@query(
    "sp2_features_and_target",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('o_orderkey', 100)}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, o_totalprice FROM r WHERE r > ceil(0.3::DOUBLE * n)""",
)
def _(t):
    train, _ = sp.random_split(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey", 0.3, 100, "linear")
    x, _y = sp.split_target(train, "o_orderstatus")
    return x


@query(
    "sp3_train_val_test",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey', 100)}, o_orderkey) AS r, count(*) OVER () AS n FROM orders),
        a AS (SELECT o_orderkey, r <= ceil(0.1::DOUBLE * n) AS test FROM r),
        v AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey', 101)}, o_orderkey) AS r, count(*) OVER () AS n FROM a WHERE NOT test)
        SELECT o_orderkey, 'test' AS part FROM a WHERE test
        UNION ALL SELECT o_orderkey, CASE WHEN r <= ceil(0.22::DOUBLE * n) THEN 'val' ELSE 'train' END FROM v""",
)
def _(t):
    train, val, test = sp.train_val_test_split(_orders(t), "o_orderkey", 0.1, 0.2, 100, "linear")
    return _tag(train=train, val=val, test=test).select("o_orderkey", "part")


@query(
    "sp4_time_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, CASE WHEN r <= n - ceil(0.3::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def _(t):
    train, test = sp.ordered_split(_orders(t), ["o_orderdate", "o_orderkey"], 0.3)
    return _tag(train=train, test=test).select("o_orderkey", "part")


@query(
    "sp4_time_train_val_test",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders),
        s AS (SELECT *, n - ceil(0.1::DOUBLE * n) AS m FROM r)
        SELECT o_orderkey, CASE WHEN r > m THEN 'test' WHEN r > m - ceil(0.11::DOUBLE * m) THEN 'val' ELSE 'train' END AS part FROM s""",
)
def _(t):
    train, val, test = sp.ordered_train_val_test_split(_orders(t), ["o_orderdate", "o_orderkey"], 0.1, 0.1)
    return _tag(train=train, val=val, test=test).select("o_orderkey", "part")


@query(
    "sp5_date_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, CASE WHEN r <= floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def _(t):
    train, test = sp.date_split(_orders(t), ["o_orderdate", "o_orderkey"], 0.7)
    return _tag(train=train, test=test).select("o_orderkey", "part")


@query(
    "sp6_stratified_split",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey) AS r,
            count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
        SELECT o_orderkey, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS part FROM r""",
)
def _(t):
    train, test = sp.stratified_split(_orders(t), "o_orderstatus", "o_orderkey", 0.2, 42, "linear")
    return _tag(train=train, test=test).select("o_orderkey", "part")


@query(
    "sp6_stratified_sample",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey) AS r FROM orders)
        SELECT o_orderkey, o_orderstatus FROM r WHERE r <= 100""",
)
def _(t):
    return sp.stratified_sample(_orders(t), "o_orderstatus", "o_orderkey", 100, 42, "linear").select("o_orderkey", "o_orderstatus")


@query("sp7_folds", f"SELECT o_orderkey, CAST({hash_sql('o_orderkey', 42)} % 5 AS INT) AS fold FROM orders")
def _(t):
    return sp.with_folds(t.orders.select("o_orderkey"), "o_orderkey", 5, 42, "linear")


@query("sp8_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return top_by(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ["o_orderkey"])


@query(
    "sp9_borderline_sample",
    f"""SELECT o_orderkey, ((o_orderkey * 7919) % 4001) / 1000.0::DOUBLE AS ratio FROM orders
        WHERE ((o_orderkey * 7919) % 4001) / 1000.0::DOUBLE BETWEEN 0.85 AND 1.15
        ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey LIMIT 25""",
)
def _(t):
    df = t.orders.select("o_orderkey", (F.expr("(o_orderkey * 7919) % 4001") / F.lit(1000.0)).alias("ratio"))
    return sp.borderline_sample(df, "ratio", "o_orderkey", rows=25, method="linear")


@query("fs1_cardinality_filter", "SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.lit(1).alias("one"))
    return fs.CardinalityFilter(high_th=0.9).fit(df).transform(df)


@query(
    "fs2_lower_cardinality",
    """WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8)
        SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN p_brand ELSE 'others' END AS p_brand, p_type FROM part""",
)
def _(t):
    df = t.part.select("p_partkey", "p_brand", "p_type")
    return fs.LowerCardinality(max_categories=8).fit(df).transform(df)


_BOTH = f"""both_ AS (SELECT o_orderkey, o_totalprice, epoch(o_orderdate) / 86400 AS day, o_orderpriority,
        CAST(o_orderdate >= TIMESTAMP '2000-01-01' AS INT) AS y, {hash_sql('o_orderkey', 43)} % 4 AS fold FROM orders
        WHERE o_orderdate >= TIMESTAMP '2000-01-01' OR {hash_sql('o_orderkey', 42)} % 1000 < 500),
    edges AS (SELECT {', '.join(f"quantile_cont({c}, [{', '.join(str(i / 32) for i in range(1, 32))}]) AS e_{c}" for c in ('o_totalprice', 'day'))} FROM both_)"""


@query(
    "fs3_feature_stability",
    f"""WITH {_BOTH}, cells AS (
            SELECT 'o_totalprice' AS feature, CAST(len(list_filter(list_distinct(e_o_totalprice), lambda e: e < o_totalprice)) AS VARCHAR) AS v, y, fold FROM both_, edges
            UNION ALL SELECT 'day', CAST(len(list_filter(list_distinct(e_day), lambda e: e < day)) AS VARCHAR), y, fold FROM both_, edges
            UNION ALL SELECT 'o_orderpriority', o_orderpriority, y, fold FROM both_),
        s AS (SELECT feature, coalesce(count(*) FILTER (fold > 0 AND y = 1)::DOUBLE / nullif(count(*) FILTER (fold > 0), 0), 0.5) AS score,
            count(*) FILTER (fold = 0 AND y = 1) AS pos, count(*) FILTER (fold = 0 AND y = 0) AS neg FROM cells GROUP BY feature, v),
        g AS (SELECT feature, score, sum(pos) AS pos, sum(neg) AS neg FROM s GROUP BY 1, 2),
        c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
        SELECT feature, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM c GROUP BY 1""",
)
def _(t):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86_400_000_000)
    df = t.orders.select("o_orderkey", "o_totalprice", day.alias("day"), "o_orderpriority", (F.col("o_orderdate") >= "2000-01-01").alias("late"))
    train, test = df.where("NOT late").drop("late"), df.where("late").drop("late")
    stage = fs.StabilityFilter(key="o_orderkey", hash_method="linear")
    return stage.scores(train, test).select("feature", F.round("auc", 6).alias("auc"))


@query("fs4_lasso_selector")
def _(t):
    columns = ["limit", "premium", "prior_claims", "years_trading"]
    df = records(t).select("record_key", *columns, "loss_ratio").where("loss_ratio is not null")
    df = NumericImputer().fit(df).transform(df)
    model = fs.LassoSelector(target="loss_ratio", columns=columns, key="record_key").fit(df)
    weights = model.fitted("weights")
    rows = [(c, float(w), c in model.fitted("kept")) for c, w in weights.items()]
    return t.spark.createDataFrame(rows, "feature string, weight double, kept boolean")


#: Penalty of the entry with a closed form: in the range of the covariance of price and quantity.
_PENALTY = 5000.0


@query(
    "fs4_lasso_closed_form",
    f"""WITH m AS (
            SELECT covar_pop(l_quantity::DOUBLE, l_extendedprice::DOUBLE) / stddev_pop(l_quantity::DOUBLE) AS a,
                covar_pop(l_discount::DOUBLE, l_extendedprice::DOUBLE) / stddev_pop(l_discount::DOUBLE) AS b,
                corr(l_quantity::DOUBLE, l_discount::DOUBLE) AS r FROM lineitem)
        SELECT 'no penalty' AS setting, 'l_quantity' AS feature, round((a - r * b) / (1 - r * r), 3) AS weight FROM m
        UNION ALL SELECT 'no penalty', 'l_discount', round((b - r * a) / (1 - r * r), 3) FROM m
        UNION ALL SELECT 'penalty', 'l_quantity', round(sign(a) * greatest(abs(a) - {_PENALTY}::DOUBLE, 0), 3) FROM m""",
)
def _(t):
    # two columns without penalty are least squares; one column with a penalty is a soft threshold
    both = fs.LassoSelector(target="l_extendedprice", columns=["l_quantity", "l_discount"], key="l_orderkey", alphas=[0.0]).fit(t.lineitem)
    one = fs.LassoSelector(target="l_extendedprice", columns=["l_quantity"], key="l_orderkey", alphas=[_PENALTY]).fit(t.lineitem)
    rows = [(s, c, round(w, 3)) for s, m in (("no penalty", both), ("penalty", one)) for c, w in m.fitted("weights").items()]
    return t.spark.createDataFrame(rows, "setting string, feature string, weight double")
