"""Category encoders and the composed record features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.records import CLEANED, RECORDS, clean_sql, records
from riskloom.catalog.registry import query
from riskloom.functions.hashing import MODULUS, MULTIPLIER
from riskloom.operators import cleaning as cl
from riskloom.operators import encoding as en
from riskloom.operators.features import feature_steps

_CATS = ("o_orderpriority", "segment")


def _labelled(t, target):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return df.select("o_orderkey", "o_orderpriority", F.col("c_mktsegment").alias("segment"), target.alias("y"))


_BASE = """base AS (SELECT o_orderkey, o_orderpriority, c_mktsegment AS segment, {y} AS y
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
_IS_F = _BASE.format(y="CAST(o_orderstatus = 'F' AS INT)")


def _woe(c: str, hit: str) -> str:
    return f"""(SELECT {c} AS k, CASE WHEN count(*) FILTER ({hit}) = 0 OR count(*) FILTER (NOT ({hit})) = 0 THEN 0.0::DOUBLE
        ELSE ln((count(*) FILTER ({hit})::DOUBLE / (SELECT count(*) FROM base WHERE {hit}))
            / (count(*) FILTER (NOT ({hit}))::DOUBLE / (SELECT count(*) FROM base WHERE NOT ({hit})))) END AS v FROM base GROUP BY 1)"""


@query(
    "en1_target_encoder",
    f"""WITH {_IS_F} SELECT o_orderkey, round(a.v, 8) AS o_orderpriority, round(b.v, 8) AS segment FROM base
        JOIN (SELECT o_orderpriority AS k, avg(y) AS v FROM base GROUP BY 1) a ON a.k = base.o_orderpriority
        JOIN (SELECT segment AS k, avg(y) AS v FROM base GROUP BY 1) b ON b.k = base.segment""",
)
def _(t):
    df = _labelled(t, (F.col("o_orderstatus") == "F").cast("int"))
    out = en.TargetEncoder(target="y", passthrough=["o_orderkey"]).fit(df).transform(df)
    return out.select("o_orderkey", *[F.round(c, 8).alias(c) for c in _CATS])


@query(
    "en2_weight_of_evidence",
    f"""WITH {_IS_F} SELECT o_orderkey, round(a.v, 8) AS o_orderpriority, round(b.v, 8) AS segment FROM base
        JOIN {_woe('o_orderpriority', 'y = 1')} a ON a.k = base.o_orderpriority
        JOIN {_woe('segment', 'y = 1')} b ON b.k = base.segment""",
)
def _(t):
    df = _labelled(t, (F.col("o_orderstatus") == "F").cast("int"))
    out = en.WOEEncoder(target="y", passthrough=["o_orderkey"]).fit(df).transform(df)
    return out.select("o_orderkey", *[F.round(c, 8).alias(c) for c in _CATS])


@query(
    "en3_multiclass_encoder",
    f"""WITH {_BASE.format(y='o_orderstatus')} SELECT o_orderkey, round(ao.v, 8) AS o_orderpriority__y_O_WOEEncoder,
        round(bo.v, 8) AS segment__y_O_WOEEncoder, round(ap.v, 8) AS o_orderpriority__y_P_WOEEncoder,
        round(bp.v, 8) AS segment__y_P_WOEEncoder FROM base
        JOIN {_woe('o_orderpriority', "y = 'O'")} ao ON ao.k = base.o_orderpriority
        JOIN {_woe('segment', "y = 'O'")} bo ON bo.k = base.segment
        JOIN {_woe('o_orderpriority', "y = 'P'")} ap ON ap.k = base.o_orderpriority
        JOIN {_woe('segment', "y = 'P'")} bp ON bp.k = base.segment""",
)
def _(t):
    df = _labelled(t, F.col("o_orderstatus"))
    out = en.MultiClassEncoder(target="y", encoder="WOEEncoder", passthrough=["o_orderkey"]).fit(df).transform(df)
    return out.select("o_orderkey", *[F.round(c, 8).alias(c) for c in out.columns if "__y_" in c])


_BINNED = """base AS (SELECT o_orderkey, o_orderpriority, c_mktsegment AS segment,
    CAST(o_totalprice > (SELECT quantile_cont(o_totalprice, 1.0/3) FROM orders) AS INT)
    + CAST(o_totalprice > (SELECT quantile_cont(o_totalprice, 2.0/3) FROM orders) AS INT) AS y
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "en4_regression_encoder",
    f"""WITH {_BINNED} SELECT o_orderkey, {', '.join(f'round({a}{k}.v, 8) AS {c}__y_{k}_TargetEncoder' for k in (1, 2) for a, c in (('a', 'o_orderpriority'), ('b', 'segment')))}
        FROM base {' '.join(f'JOIN (SELECT {c} AS k, avg(CAST(y = {k} AS INT)) AS v FROM base GROUP BY 1) {a}{k} ON {a}{k}.k = base.{c}' for k in (1, 2) for a, c in (('a', 'o_orderpriority'), ('b', 'segment')))}""",
)
def _(t):
    df = _labelled(t, F.col("o_totalprice"))
    stage = en.RegressionEncoder(target="y", encoder="TargetEncoder", discretizer="quantile", n_bins=3, passthrough=["o_orderkey"])
    out = stage.fit(df).transform(df)
    return out.select("o_orderkey", *[F.round(c, 8).alias(c) for c in out.columns if "__y_" in c])


@query(
    "en5_fit_checks",
    f"""WITH {RECORDS} SELECT 'missing_values' AS problem, count(*) > 0 AS raised FROM records WHERE industry IS NULL
        UNION ALL SELECT 'not_binary', count(*) > 0 FROM records WHERE prior_claims NOT IN (0, 1)""",
)
def _(t):
    df = records(t).select("industry", "prior_claims", F.col("is_loss_making").cast("int").alias("y"))
    problems = []
    for name, stage in (
        ("missing_values", en.TargetEncoder(target="y")),
        ("not_binary", en.TargetEncoder(target="prior_claims")),
    ):
        try:
            stage.fit(df)
            problems.append((name, False))
        except ValueError:
            problems.append((name, True))
    return t.spark.createDataFrame(problems, "problem string, raised boolean")


@query(
    "en6_unseen_category",
    """WITH m AS (SELECT c_mktsegment AS k, avg(CAST(c_acctbal > 5000 AS INT)) AS v FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
        SELECT c_custkey, round(v, 8) AS as_null, round(coalesce(v, 0.0), 8) AS as_others
        FROM customer LEFT JOIN m ON m.k = c_mktsegment""",
)
def _(t):
    df = t.customer.select("c_custkey", F.col("c_mktsegment").alias("as_null"), (F.col("c_acctbal") > 5000).cast("int").alias("y"))
    known = df.where("as_null <> 'BUILDING'")
    settings = {"target": "y", "passthrough": ["c_custkey"]}
    nulls = en.TargetEncoder(**settings, handle_unknown="null").fit(known).transform(df.withColumn("seg", F.col("as_null")))
    renamed = nulls.withColumnRenamed("seg", "as_others").drop("y")
    other = known.withColumnRenamed("as_null", "as_others")
    out = en.TargetEncoder(**settings, handle_unknown="others").fit(other).transform(renamed)
    return out.select("c_custkey", F.round("as_null", 8).alias("as_null"), F.round("as_others", 8).alias("as_others"))


_FOLD = f"((o_orderkey % {MODULUS}) * {MULTIPLIER} + 42 * 69621 + 12345) % {MODULUS} % 5"
_FOLD_R = _FOLD.replace("o_orderkey", "record_key")


def _oof_sql(group: str, source: str, name: str) -> str:
    return f"""{name} AS (SELECT record_key, coalesce((g.s - f.s) / nullif(g.n - f.n, 0),
            (SELECT avg(loss_ratio) FROM {source} x WHERE x.fold <> r.fold)) AS score
        FROM {source} r JOIN (SELECT {group}, sum(loss_ratio) AS s, count(*) AS n FROM {source} GROUP BY 1) g USING ({group})
        JOIN (SELECT {group}, fold, sum(loss_ratio) AS s, count(*) AS n FROM {source} GROUP BY 1, 2) f USING ({group}, fold))"""


@query(
    "en7_out_of_fold_mean",
    f"""WITH {RECORDS}, r0 AS (SELECT record_key, {clean_sql('broker')} AS broker, loss_ratio, {_FOLD_R} AS fold FROM records),
        {_oof_sql('broker', 'r0', 'o')} SELECT record_key, round(score, 8) AS score FROM o""",
)
def _(t):
    df = cl.StringCleaner(categorical_cols=["broker"]).transform(records(t).select("record_key", "broker", "loss_ratio"))
    stage = en.OOFGroupEncoder(group_col="broker", score_col="score", key="record_key", hash_method="linear")
    return stage.out_of_fold(df).select("record_key", F.round("score", 8).alias("score"))


@query(
    "en7_group_mean_scoring",
    f"""WITH {RECORDS}, m AS (SELECT broker, avg(loss_ratio) AS v FROM records WHERE record_key % 2 = 0 AND broker IS NOT NULL GROUP BY 1)
        SELECT record_key, round(coalesce(m.v, (SELECT avg(loss_ratio) FROM records WHERE record_key % 2 = 0)), 8) AS score
        FROM records LEFT JOIN m USING (broker)""",
)
def _(t):
    df = records(t).select("record_key", "broker", "loss_ratio")
    model = en.OOFGroupEncoder(group_col="broker", score_col="score").fit(df.where("record_key % 2 = 0"))
    return model.transform(df).select("record_key", F.round("score", 8).alias("score"))


_TERRITORIES = ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Unknown")


@query(
    "en8_categorical_encoder",
    f"WITH {CLEANED} SELECT record_key, "
    + ", ".join(f"""CAST(territory = '{v}' AS DOUBLE) AS "territory_{v}" """ for v in _TERRITORIES)
    + """, CAST(CASE experience_band WHEN 'startup' THEN 0 WHEN 'early' THEN 1 WHEN 'established' THEN 2
        WHEN 'mature' THEN 3 ELSE -1 END AS INT) AS experience_band FROM engineered""",
)
def _(t):
    df = records(t).select("record_key", "territory", "limit", "premium", "prior_claims", "years_trading")
    df = cl.StringCleaner(categorical_cols=["territory"]).transform(df)
    df = cl.FeatureEngineer().transform(cl.NumericImputer().fit(df).transform(df))
    stage = en.CategoricalEncoder(
        nominal_cols=["territory"], ordinal_col_map={"experience_band": ["startup", "early", "established", "mature"]}
    )
    out = stage.fit(df).transform(df)
    return out.select("record_key", *[c for c in out.columns if c.startswith("territory_")], "experience_band")


@query(
    "en9_one_hot_pairs",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS DOUBLE) AS is_f, CAST(o_orderpriority = '1-URGENT' AS DOUBLE) AS urgent FROM orders""",
)
def _(t):
    pairs = [("o_orderstatus", "F", "is_f"), ("o_orderpriority", "1-URGENT", "urgent")]
    return en.one_hot_pairs(t.orders, pairs).select("o_orderkey", "is_f", "urgent")


_OUT = ("premium_to_limit", "log_limit", "log_premium", "claims_per_year", "broker_quality_score", "industry_risk_score")


@query(
    "en10_feature_matrix",
    f"""WITH {CLEANED}, e AS (SELECT *, {_FOLD_R} AS fold FROM engineered),
        {_oof_sql('broker', 'e', 'b')}, {_oof_sql('industry', 'e', 'i')}
        SELECT e.record_key, {', '.join(f'round({c}, 6) AS {c}' for c in _OUT[:4])}, round(b.score, 6) AS broker_quality_score,
        round(i.score, 6) AS industry_risk_score, prior_claims_missing, years_trading_invalid, years_trading_missing,
        CAST(risk_type = 'MACHINERY' AS DOUBLE) AS "risk_type_MACHINERY", CAST(territory = 'ASIA' AS DOUBLE) AS "territory_ASIA"
        FROM e JOIN b ON b.record_key = e.record_key JOIN i ON i.record_key = e.record_key""",
)
def _(t):
    df = records(t).drop("record_id", "is_loss_making")
    _, out = feature_steps(key="record_key", hash_method="linear").fit_transform(df)
    return out.select(
        "record_key", *[F.round(c, 6).alias(c) for c in _OUT],
        "prior_claims_missing", "years_trading_invalid", "years_trading_missing", "risk_type_MACHINERY", "territory_ASIA",
    )
