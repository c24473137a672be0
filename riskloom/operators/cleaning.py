"""Cleaning, coercion, imputation, validation and derived record features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.stages import FitStage, FittedStage, Stage
from riskloom.plans.frames import nan_to_null, numeric_columns, string_columns, time_columns
from riskloom.plans.ranking import medians
from riskloom.schemas import OPTIONAL_FIELDS, REQUEST, REQUIRED_FIELDS

# Texts that count as missing in a categorical column.
MISSING_TEXTS = ["", "nan", "<na>"]


# The code points Python treats as blank.
BLANKS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(column: str | Column) -> Column:
    """Trim every Unicode blank, as the reference's string trim does."""
    return F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS))


def normal_category(column: str | Column, fill: str, lower: bool = False) -> Column:
    text = strip(column)
    text = F.lower(text) if lower else text
    return F.coalesce(F.when(~text.isin(MISSING_TEXTS), text), F.lit(fill))


class StringCleaner(Stage):
    """Trim all string columns; missing or blank categorical values become `fill_value`."""

    defaults = {"categorical_cols": [], "fill_value": "Unknown"}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        texts = {c: strip(c) for c in string_columns(dataset)}
        chosen = [c for c in self.setting("categorical_cols") if c in dataset.columns]
        texts |= {c: normal_category(F.col(c).cast("string"), self.setting("fill_value")) for c in chosen}
        return dataset.withColumns(texts) if texts else dataset


def normalise_categories(df: DataFrame, columns: list[str], fill: str = "unknown") -> DataFrame:
    """Exploration variant: trimmed, lower case, missing as `unknown`."""
    return df.withColumns({c: normal_category(c, fill, lower=True) for c in columns})


def parse_label(column: str) -> Column:
    text = F.lower(strip(column))
    return F.when(text == "true", True).when(text == "false", False)


def normalise_label(df: DataFrame, column: str) -> DataFrame:
    """Text label to boolean. Any other text or a missing label is an error."""
    text = F.lower(strip(F.col(column).cast("string")))
    label = F.when(text == "true", True).when(text == "false", False)
    shown = F.when(label.isNull() & ~text.isin(MISSING_TEXTS), text)
    bad = df.agg(
        F.count_if(label.isNull()).alias("missing"), F.count_if(shown.isNotNull()).alias("wrong")
    ).first()
    if bad["wrong"]:
        sample = [r[0] for r in df.select(shown.alias("v")).where("v IS NOT NULL").distinct().limit(20).collect()]
        raise ValueError(f"unexpected labels in {column}: {sorted(sample)}")
    if bad["missing"]:
        raise ValueError(f"missing labels in {column}: {bad['missing']}")
    return df.withColumn(column, label)


def _as_number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        number = strip(column).try_cast("double")
    else:
        number = F.col(column).try_cast("double")
    return F.when(~F.isnan(number), number)


class NumericCoercer(Stage):
    """Cast columns to double; what cannot be parsed becomes missing."""

    defaults = {"numeric_cols": []}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = [c for c in self.setting("numeric_cols") if c in dataset.columns]
        return dataset.withColumns({c: _as_number(dataset, c) for c in found}) if found else dataset


class MissingFlagger(Stage):
    """0/1 flags for missing and impossible values, taken before imputation."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        flags = {}
        if "prior_claims" in dataset.columns:
            flags["prior_claims_missing"] = F.col("prior_claims").isNull().cast("int")
        if "years_trading" in dataset.columns:
            flags["years_trading_invalid"] = F.coalesce(F.col("years_trading") < 0, F.lit(False)).cast("int")
            flags["years_trading_missing"] = F.col("years_trading").isNull().cast("int")
        return dataset.withColumns(flags) if flags else dataset


def _floor(column: str | Column, low: float) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c < low, F.lit(float(low))).otherwise(c)


class NumericImputer(FitStage):
    """Medians of years, premium and limit from the training rows; claims fill 0."""

    def _fit(self, dataset: DataFrame) -> NumericImputerModel:
        present = [c for c in ("years_trading", "premium", "limit") if c in dataset.columns]
        base = dataset.select(*[(_floor(c, 0) if c == "years_trading" else F.col(c)).alias(c) for c in present])
        return NumericImputerModel(state={"medians": medians(base, present)})


class NumericImputerModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        medians = self.fitted("medians")
        out = {}
        if "prior_claims" in dataset.columns:
            out["prior_claims"] = _floor(F.coalesce("prior_claims", F.lit(0.0)), 0)
        if "years_trading" in dataset.columns:
            out["years_trading"] = F.coalesce(_floor("years_trading", 0), F.lit(medians["years_trading"]))
        for column, low in (("premium", 0), ("limit", 1)):
            if column in dataset.columns:
                out[column] = _floor(F.coalesce(column, F.lit(medians[column])), low)
        return dataset.withColumns(out) if out else dataset


class SimpleNumericImputer(FitStage):
    """Fill all numeric columns with their mean, median, most frequent value or a constant."""

    defaults = {"strategy": "mean", "fill_value": 0}

    def _fit(self, dataset: DataFrame) -> FillModel:
        columns = numeric_columns(dataset)
        strategy = self.setting("strategy")
        clean = nan_to_null(dataset.select(*columns))
        if strategy == "mean":
            row = clean.agg(*[F.avg(c).alias(c) for c in columns]).first()
            fills = row.asDict()
        elif strategy == "median":
            fills = medians(clean, columns)
        elif strategy == "most_frequent":
            fills = _most_frequent(clean, columns)
        elif strategy == "constant":
            fills = {c: float(self.setting("fill_value")) for c in columns}
        else:
            raise ValueError(f"unknown strategy {strategy}")
        return FillModel(state={"fills": fills})


def _most_frequent(df: DataFrame, columns: list[str]) -> dict[str, float]:
    cells = [F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]
    counts = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL").groupBy("c", "v").count()
    best = counts.groupBy("c").agg(F.max(F.struct("count", (-F.col("v")).alias("v"))).alias("m"))
    return {r["c"]: -r["m"]["v"] for r in best.collect()}


class FillModel(FittedStage):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        clean = nan_to_null(dataset)
        fills = {c: v for c, v in self.fitted("fills").items() if v is not None and c in clean.columns}
        return clean.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


class SimpleDatetimeImputer(Stage):
    """Missing dates and timestamps become one fixed date."""

    defaults = {"imputation_value": "1970-01-01"}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fill = F.lit(self.setting("imputation_value"))
        cols = {c: F.coalesce(c, fill.cast(dataset.schema[c].dataType)) for c in time_columns(dataset)}
        return dataset.withColumns(cols) if cols else dataset


class SimpleCategoryImputer(Stage):
    """Missing text becomes one fixed word."""

    defaults = {"imputation_value": "None"}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = string_columns(dataset)
        return dataset.fillna(self.setting("imputation_value"), subset=cols) if cols else dataset


class LeakageDropper(Stage):
    """Drop columns that give the target away."""

    defaults = {"cols_to_drop": ["loss_ratio"]}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.setting("cols_to_drop"))


# Right-closed upper ends of the trading-age bands.
EXPERIENCE_BANDS = [(3, "startup"), (10, "early"), (25, "established"), (float("inf"), "mature")]


class FeatureEngineer(Stage):
    """Ratio, log and band features of a cleaned record."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        years = F.col("years_trading")
        band = F.when(years.isNull() | (years <= -0.1), F.lit("nan"))
        for upper, label in EXPERIENCE_BANDS:
            band = band.when(years <= upper, F.lit(label))
        return dataset.withColumns(
            {
                "premium_to_limit": F.try_divide(F.col("premium").cast("double"), F.col("limit")),
                "log_limit": F.log1p("limit"),
                "log_premium": F.log1p("premium"),
                "claims_per_year": F.col("prior_claims") / _floor(years.cast("double"), 1),
                "experience_band": band,
            }
        )


def quality_flags() -> Column:
    """Missing and impossible fields of a request in the order they are reported."""
    parts = [F.when(F.col(f).isNull(), F.lit(f"required_field_missing:{f}")) for f in sorted(REQUIRED_FIELDS)]
    parts += [F.when(F.col(f).isNull(), F.lit(f"optional_field_missing:{f}")) for f in sorted(OPTIONAL_FIELDS)]
    parts += [
        F.when(F.col("years_trading") < 0, F.lit("invalid_value:years_trading_negative")),
        F.when(F.col("limit") <= 0, F.lit("invalid_value:limit_nonpositive")),
        F.when(F.col("premium") <= 0, F.lit("invalid_value:premium_nonpositive")),
    ]
    return F.array_compact(F.array(*parts))


def label_disagreements(df: DataFrame, ratio: str = "loss_ratio", label: str = "is_loss_making") -> DataFrame:
    """Rows whose label contradicts `ratio > 1`, highest ratio first."""
    return df.where((F.col(ratio) > 1.0) != F.col(label)).orderBy(F.desc(ratio))


def clean_subset(df: DataFrame, max_ratio: float = 4.0, min_limit: float = 1000.0) -> DataFrame:
    """Complete and plausible records, the pool for evaluation sets."""
    needed = ["risk_type", "territory", "industry", "broker", "prior_claims", "years_trading"]
    complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in needed))
    return df.where(complete & (F.col("loss_ratio") < max_ratio) & (F.col("limit") > min_limit) & (F.col("premium") > 0))


def validate_requests(df: DataFrame, payload: str, schema: T.StructType = REQUEST) -> DataFrame:
    """Strict typing of a JSON request column, unknown fields kept.

    Adds one column per declared field, `extras` (map of the other fields) and `reasons` (names
    of fields with a wrong JSON type). Rows with reasons belong in quarantine.
    """
    raw = F.from_json(payload, "map<string,string>")
    typed = F.try_parse_json(payload)
    df = df.withColumns({"__raw": raw, "__typed": typed})
    fields, reasons = {}, []
    for field in schema.fields:
        path = f"$.{field.name}"
        kind = F.schema_of_variant(F.try_variant_get("__typed", path, "variant"))
        numeric = isinstance(field.dataType, T.NumericType)
        wanted = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") if numeric else kind == "STRING"
        absent = F.coalesce(kind == "VOID", F.lit(True))
        fields[field.name] = F.when(~absent & wanted, F.try_variant_get("__typed", path, field.dataType.simpleString()))
        reasons.append(F.when(~absent & ~wanted, F.lit(f"wrong_type:{field.name}")))
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    broken = F.when(F.col("__raw").isNull(), F.lit("not_an_object"))
    return df.withColumns(
        {
            **fields,
            "extras": F.map_filter("__raw", lambda k, _v: ~F.array_contains(known, k)),
            "reasons": F.array_compact(F.array(broken, *reasons)),
        }
    ).drop("__raw", "__typed")


def pad_features(df: DataFrame, expected: list[str]) -> DataFrame:
    """Exactly the trained columns: absent ones are 0 and named in `model_warnings`."""
    absent = [c for c in expected if c not in df.columns]
    kept = [c for c in df.columns if c not in expected]
    warnings = F.array(*[F.lit(f"feature_missing_after_transform:{c}") for c in absent]).cast("array<string>")
    return df.select(
        *kept,
        *[F.lit(0).alias(c) if c in absent else F.col(c) for c in expected],
        warnings.alias("model_warnings"),
    )


def storable(df: DataFrame) -> DataFrame:
    """Values as a database takes them: NaN and the text `NULL` are NULL, nested values are JSON."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.when(c != "NULL", c)
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            out[f.name] = F.to_json(c)
    return df.withColumns(out) if out else df
