"""Cleaning, coercion, imputation, validation, derived features and text templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.records import CLEANED, RECORDS, TRIM, clean_sql, records
from riskloom.catalog.registry import query
from riskloom.functions import text as tx
from riskloom.operators import cleaning as cl
from riskloom.schemas import CATEGORICAL_FIELDS, NUMERIC_FIELDS

_CATS = list(CATEGORICAL_FIELDS)


@query(
    "cl1_string_cleaner",
    f"WITH {RECORDS} SELECT record_key, record_id, {', '.join(f'{clean_sql(c)} AS {c}' for c in _CATS)} FROM records",
)
def _(t):
    out = cl.StringCleaner(categorical_cols=_CATS).transform(records(t))
    return out.select("record_key", "record_id", *_CATS)


@query(
    "cl2_lowercase_categories",
    f"""WITH {RECORDS} SELECT record_key, {', '.join(f"lower({clean_sql(c, 'unknown')}) AS {c}" for c in _CATS)} FROM records""",
)
def _(t):
    return cl.normalise_categories(records(t).select("record_key", *_CATS), _CATS)


@query(
    "cl3_label",
    "SELECT o_orderkey, o_orderstatus = 'F' AS label FROM orders",
)
def _(t):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit(" True")).otherwise(F.lit("FALSE "))
    return cl.normalise_label(t.orders.select("o_orderkey", raw.alias("label")), "label")


@query(
    "cl4_numeric_coercion",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN NULL
        ELSE o_totalprice END AS amount FROM orders""",
)
def _(t):
    dirty = (
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a"))
        .when(F.col("o_orderkey") % 7 == 1, F.lit(""))
        .otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    )
    return cl.NumericCoercer(numeric_cols=["amount", "absent"]).transform(
        t.orders.select("o_orderkey", dirty.alias("amount"))
    )


_FLAGS = ("prior_claims_missing", "years_trading_invalid", "years_trading_missing")


@query(
    "cl5_missing_flags",
    f"WITH {CLEANED} SELECT record_key, {', '.join(_FLAGS)} FROM imputed",
)
def _(t):
    return cl.MissingFlagger().transform(records(t)).select("record_key", *_FLAGS)


@query(
    "cl6_numeric_imputer",
    f'WITH {CLEANED} SELECT record_key, prior_claims, years_trading, premium, "limit" FROM imputed',
)
def _(t):
    df = records(t).select("record_key", "prior_claims", "years_trading", "premium", "limit")
    return cl.NumericImputer().fit(df).transform(df)


def _fills_sql(agg: dict[str, str]) -> str:
    cols = ", ".join(f'round(coalesce("{c}", (SELECT {a} FROM records)), 4) AS "{c}"' for c, a in agg.items())
    return f"WITH {RECORDS} SELECT record_key, {cols} FROM records"


_FILLED = ("limit", "premium", "prior_claims", "years_trading")


def _simple_numeric(t, **settings):
    df = records(t).select("record_key", *_FILLED)
    keyed = df.withColumn("record_key", F.col("record_key").cast("string"))
    out = cl.SimpleNumericImputer(**settings).fit(keyed).transform(keyed)
    return out.select(F.col("record_key").cast("long").alias("record_key"), *[F.round(c, 4).alias(c) for c in _FILLED])


@query("cl7_impute_mean", _fills_sql({c: f'avg("{c}")' for c in _FILLED}))
def _(t):
    return _simple_numeric(t, strategy="mean")


@query("cl7_impute_median", _fills_sql({c: f'quantile_cont("{c}", 0.5)' for c in _FILLED}))
def _(t):
    return _simple_numeric(t, strategy="median")


@query(
    "cl7_impute_most_frequent",
    f"WITH {RECORDS} SELECT record_key, "
    + ", ".join(
        f'''round(coalesce("{c}", (SELECT v FROM (SELECT "{c}" AS v, count(*) AS n FROM records WHERE "{c}" IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, v LIMIT 1))), 4) AS "{c}"'''
        for c in _FILLED
    )
    + " FROM records",
)
def _(t):
    return _simple_numeric(t, strategy="most_frequent")


@query("cl7_impute_constant", _fills_sql({c: "-1.0::DOUBLE" for c in _FILLED}).replace("(SELECT -1.0::DOUBLE FROM records)", "-1.0::DOUBLE"))
def _(t):
    return _simple_numeric(t, strategy="constant", fill_value=-1)


@query(
    "cl8_datetime_imputer",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '1970-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
        FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("day"))
    out = cl.SimpleDatetimeImputer().transform(df)
    return out.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    "cl9_category_imputer",
    f"WITH {RECORDS} SELECT record_key, {', '.join(f'''coalesce({c}, 'None') AS {c}''' for c in _CATS)} FROM records",
)
def _(t):
    return cl.SimpleCategoryImputer().transform(records(t).select("record_key", *_CATS))


@query("cl10_leakage_dropper", f'WITH {RECORDS} SELECT record_key, premium FROM records')
def _(t):
    df = records(t).select("record_key", "premium", "loss_ratio")
    return cl.LeakageDropper(cols_to_drop=["loss_ratio", "absent"]).transform(df)


FLAGS_SQL = """list_filter([
        CASE WHEN "limit" IS NULL THEN 'required_field_missing:limit' END,
        CASE WHEN premium IS NULL THEN 'required_field_missing:premium' END,
        CASE WHEN risk_type IS NULL THEN 'required_field_missing:risk_type' END,
        CASE WHEN territory IS NULL THEN 'required_field_missing:territory' END,
        CASE WHEN broker IS NULL THEN 'optional_field_missing:broker' END,
        CASE WHEN industry IS NULL THEN 'optional_field_missing:industry' END,
        CASE WHEN prior_claims IS NULL THEN 'optional_field_missing:prior_claims' END,
        CASE WHEN years_trading IS NULL THEN 'optional_field_missing:years_trading' END,
        CASE WHEN years_trading < 0 THEN 'invalid_value:years_trading_negative' END,
        CASE WHEN "limit" <= 0 THEN 'invalid_value:limit_nonpositive' END,
        CASE WHEN premium <= 0 THEN 'invalid_value:premium_nonpositive' END], lambda x: x IS NOT NULL)"""


@query(
    "cl11_quality_flags",
    f"WITH {RECORDS} SELECT record_key, array_to_string({FLAGS_SQL}, '|') AS flags FROM records",
)
def _(t):
    return records(t).select("record_key", F.array_join(cl.quality_flags(), "|").alias("flags"))


@query(
    "cl12_label_disagreements",
    f"""WITH {RECORDS} SELECT record_key, loss_ratio, is_loss_making FROM records
        WHERE (loss_ratio > 1.0) <> is_loss_making""",
)
def _(t):
    return cl.label_disagreements(records(t)).select("record_key", "loss_ratio", "is_loss_making")


@query(
    "cl13_clean_subset",
    f"""WITH {RECORDS} SELECT record_key FROM records WHERE risk_type IS NOT NULL AND territory IS NOT NULL
        AND industry IS NOT NULL AND broker IS NOT NULL AND prior_claims IS NOT NULL AND years_trading IS NOT NULL
        AND loss_ratio < 4.0 AND "limit" > 1000 AND premium > 0""",
)
def _(t):
    return cl.clean_subset(records(t)).select("record_key")


@query(
    "cl14_request_validation",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS "limit",
        CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_orderpriority END AS broker,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS note,
        array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 1 THEN 'wrong_type:limit' END,
            CASE WHEN o_orderkey % 5 = 2 THEN 'wrong_type:broker' END], lambda x: x IS NOT NULL), '|') AS reasons
        FROM orders""",
)
def _(t):
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    payload = F.concat(
        F.lit('{"record_id": "R'), k.cast("string"), F.lit('", "limit": '),
        F.when(k % 4 == 1, F.concat(F.lit('"'), price, F.lit(' dollars"'))).otherwise(price),
        F.lit(', "broker": '),
        F.when(k % 5 == 2, F.lit("17")).otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))),
        F.when(k % 3 == 0, F.concat(F.lit(', "note": "'), F.col("o_orderstatus"), F.lit('"'))).otherwise(""),
        F.lit("}"),
    )
    out = cl.validate_requests(t.orders.select("o_orderkey", payload.alias("payload"), "o_orderstatus"), "payload")
    return out.select(
        "o_orderkey", "limit", "broker", F.col("extras")["note"].alias("note"),
        F.array_join("reasons", "|").alias("reasons"),
    )


_RATES = ("premium_to_limit", "log_limit", "log_premium", "claims_per_year")


@query(
    "cl15_derived_features",
    f"""WITH {CLEANED} SELECT record_key, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)}, experience_band
        FROM engineered""",
)
def _(t):
    df = records(t).select("record_key", *NUMERIC_FIELDS)
    out = cl.FeatureEngineer().transform(cl.NumericImputer().fit(df).transform(df))
    return out.select("record_key", *[F.round(c, 6).alias(c) for c in _RATES], "experience_band")


@query(
    "cl16_pad_features",
    """SELECT o_orderkey, o_totalprice, 0 AS never_seen,
        'feature_missing_after_transform:never_seen' AS model_warnings FROM orders""",
)
def _(t):
    out = cl.pad_features(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "never_seen"])
    return out.withColumn("model_warnings", F.array_join("model_warnings", "|"))


_PY_ROUND_1 = "format('{:.1f}', \"limit\" / 1000000)"


@query(
    "cl17_record_sentence",
    f"""WITH {RECORDS} SELECT record_key, concat('This is a ', coalesce(lower({TRIM.format(c='risk_type')}), 'nan'), ' record covering ',
        coalesce(lower({TRIM.format(c='risk_type')}), 'nan'), ', submitted by ', coalesce({TRIM.format(c='broker')}, 'nan'), ' for a ',
        coalesce({TRIM.format(c='industry')}, 'an undisclosed industry'), ' account ', coalesce({TRIM.format(c='territory')}, 'nan'),
        '. The insured is ', CASE WHEN years_trading IS NULL THEN 'an entity with unknown trading history'
            WHEN years_trading < 5 THEN 'a recently established entity'
            ELSE concat('a business with ', CAST(CAST(years_trading AS INT) AS VARCHAR), ' years of trading history') END,
        ', with ', CASE WHEN prior_claims IS NULL THEN 'unknown prior claims history'
            WHEN prior_claims = 0 THEN 'no prior claims history' WHEN prior_claims = 1 THEN 'one prior claim on record'
            WHEN prior_claims = 2 THEN 'two prior claims on record'
            WHEN prior_claims = 3 THEN 'three prior claims on record'
            ELSE concat(CAST(CAST(prior_claims AS INT) AS VARCHAR), ' prior claims on record') END,
        '. The policy limit is $', CASE WHEN "limit" >= 1000000 THEN concat({_PY_ROUND_1}, 'm')
            ELSE coalesce(format('{{:,}}', CAST("limit" AS BIGINT)), 'nan') END,
        ' and the quoted premium is $', coalesce(format('{{:.0f}}', premium / 1000), 'nan'), 'k, placed with Acme Underwriting.') AS sentence
        FROM records""",
)
def _(t):
    return records(t).select("record_key", tx.record_sentence("Acme Underwriting").alias("sentence"))


RETRIEVAL_SQL = """coalesce(nullif(concat_ws(' ', nullif(risk_type, ''), CASE WHEN industry <> '' THEN concat(industry, ' company') END,
        CASE WHEN territory <> '' THEN concat('in ', territory) END,
        CASE WHEN prior_claims <> 0 THEN concat('with ', CAST(CAST(prior_claims AS BIGINT) AS VARCHAR), ' prior claim(s)') END,
        CASE WHEN "limit" <> 0 THEN concat('limit ', format('{:,}', CAST("limit" AS BIGINT))) END), ''), 'insurance record')"""


@query("cl18_retrieval_query", f"WITH {RECORDS} SELECT record_key, {RETRIEVAL_SQL} AS query_text FROM records")
def _(t):
    return records(t).select("record_key", tx.retrieval_query().alias("query_text"))


@query(
    "cl19_json_in_text",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT)
            WHEN 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN 2 THEN CAST(json_extract(props, '$.k') AS BIGINT)
            ELSE NULL END AS k, event_id % 4 = 3 AS failed FROM events""",
)
def _(t):
    n = F.col("event_id") % 4
    wrapped = (
        F.when(n == 0, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone {x}")))
        .when(n == 1, F.concat(F.lit("answer "), F.col("props"), F.lit(" end")))
        .when(n == 2, F.col("props"))
        .otherwise(F.lit("no { object"))
    )
    found = tx.json_object("raw")
    return t.events.select("event_id", wrapped.alias("raw")).select(
        "event_id", F.get_json_object(found, "$.k").cast("long").alias("k"), found.isNull().alias("failed")
    )


@query(
    "cl20_storable_values",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status,
        concat('{"priority":"', o_orderpriority, '"}') AS detail, concat('["', o_orderstatus, '"]') AS tags FROM orders""",
)
def _(t):
    k = F.col("o_orderkey")
    return cl.storable(
        t.orders.select(
            "o_orderkey",
            F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
            F.when(k % 4 == 0, F.lit("NULL")).otherwise(F.col("o_orderstatus")).alias("status"),
            F.struct(F.col("o_orderpriority").alias("priority")).alias("detail"),
            F.array("o_orderstatus").alias("tags"),
        )
    )
