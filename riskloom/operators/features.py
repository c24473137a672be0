"""The record feature steps: clean, coerce, flag, impute, derive, group scores, encode, drop."""

from __future__ import annotations

from riskloom.operators.cleaning import (
    FeatureEngineer,
    LeakageDropper,
    MissingFlagger,
    NumericCoercer,
    NumericImputer,
    StringCleaner,
)
from riskloom.operators.encoding import CategoricalEncoder, FeatureSteps, OOFGroupEncoder
from riskloom.schemas import CATEGORICAL_FIELDS, NUMERIC_FIELDS

# Raw inputs that the derived features replace.
SUPERSEDED = ["limit", "premium", "prior_claims", "years_trading", "broker", "industry"]


def feature_steps(key: str = "record_id", folds: int = 5, seed: int = 42, hash_method: str = "xxhash") -> FeatureSteps:
    score = {"n_splits": folds, "random_state": seed, "key": key, "hash_method": hash_method}
    return FeatureSteps(
        [
            StringCleaner(categorical_cols=list(CATEGORICAL_FIELDS)),
            NumericCoercer(numeric_cols=[*NUMERIC_FIELDS, "loss_ratio"]),
            MissingFlagger(),
            NumericImputer(),
            FeatureEngineer(),
            OOFGroupEncoder(group_col="broker", score_col="broker_quality_score", **score),
            OOFGroupEncoder(group_col="industry", score_col="industry_risk_score", **score),
            CategoricalEncoder(
                nominal_cols=["risk_type", "territory"],
                ordinal_col_map={"experience_band": ["startup", "early", "established", "mature"]},
            ),
            LeakageDropper(cols_to_drop=["loss_ratio", *SUPERSEDED]),
        ]
    )
