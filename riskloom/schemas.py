"""Declared schemas of the record, result, evaluation and usage tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and groups of the record contract.
REQUIRED_FIELDS = ("limit", "premium", "risk_type", "territory")
OPTIONAL_FIELDS = ("broker", "industry", "prior_claims", "years_trading")
CATEGORICAL_FIELDS = ("risk_type", "territory", "industry", "broker")
NUMERIC_FIELDS = ("limit", "premium", "prior_claims", "years_trading")

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("risk_type", T.StringType()),
        T.StructField("territory", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("limit", T.LongType()),
        T.StructField("premium", T.LongType()),
        T.StructField("broker", T.StringType()),
        T.StructField("prior_claims", T.DoubleType()),
        T.StructField("years_trading", T.DoubleType()),
        T.StructField("loss_ratio", T.DoubleType()),
        T.StructField("is_loss_making", T.BooleanType()),
    ]
)

# Fields of one request; types are strict and every field may be absent.
REQUEST = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("risk_type", T.StringType()),
        T.StructField("territory", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("limit", T.DoubleType()),
        T.StructField("premium", T.DoubleType()),
        T.StructField("broker", T.StringType()),
        T.StructField("prior_claims", T.DoubleType()),
        T.StructField("years_trading", T.DoubleType()),
    ]
)

EVAL_ITEM = T.StructType(
    RECORD.fields[:9]
    + [
        T.StructField(
            "ground_truth",
            T.StructType(
                [
                    T.StructField("is_loss_making", T.BooleanType()),
                    T.StructField("loss_ratio", T.DoubleType()),
                    T.StructField("case_type", T.StringType()),
                ]
            ),
        )
    ]
)

USAGE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("token_cost_usd", T.DoubleType()),
        T.StructField("tool_calls", T.MapType(T.StringType(), T.LongType())),
        T.StructField("tool_cost_usd", T.DoubleType()),
        T.StructField("cost_usd", T.DoubleType()),
    ]
)
