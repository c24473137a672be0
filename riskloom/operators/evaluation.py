"""Exact ranking metrics and threshold tables of a scored frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.ranking import bucket_areas, value_ranks

# Default thresholds of the sweep.
THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99)
# Fixed value: the clip of a hard label inside the log loss, the double epsilon.
EPSILON = 2.0**-52


def _outcomes(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("int")
    return value_ranks(df, score, (), {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")})


def area_from_ranks(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney area per group from counts per distinct score; a tie counts half."""
    below = F.col("before_neg").cast("double") + F.col("neg") / 2.0
    area = F.sum(F.col("pos") * below) / (F.nullif(F.sum("pos"), F.lit(0)).cast("double") * F.nullif(F.sum("neg"), F.lit(0)))
    return ranks.groupBy(*by).agg(area.alias("auc"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, one row per group."""
    y = F.col(label).cast("int")
    sums = bucket_areas(df, score, by, (y == 1).cast("long"), (y == 0).cast("long"))
    area = F.col("area") / (F.nullif("pos", F.lit(0)).cast("double") * F.nullif("neg", F.lit(0)))
    return sums.select(*by, area.alias("auc"))


def _counts(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn for `score > threshold`; all thresholds in one scan, rows without a score left out."""
    df = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    y = F.col(label).cast("int") == 1
    row = df.agg(
        F.count_if(y).alias("p"),
        F.count_if(~y).alias("q"),
        *[F.count_if(y & (F.col(score) > t)).alias(f"tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(~y & (F.col(score) > t)).alias(f"fp{i}") for i, t in enumerate(thresholds)],
    )
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
            (F.col("p") - F.col(f"tp{i}")).alias("fn"), (F.col("q") - F.col(f"fp{i}")).alias("tn"),
        )
        for i, t in enumerate(thresholds)
    ]
    return row.select(F.inline(F.array(*cells)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def _pct(value: Column, digits: int) -> Column:
    return F.round(value * 100, digits)


def threshold_sweep(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] = THRESHOLDS, digits: int = 2
) -> DataFrame:
    """Accuracy, balanced accuracy, recall, precision, F1, MCC and log loss (all x 100) per threshold."""
    auc = roc_auc(df, label, score).scalar()
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    mcc = _ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return _counts(df, label, score, thresholds).select(
        F.col("threshold").alias("classification_threshold"),
        _pct(auc, digits).alias("auc"),
        _pct((tp + tn) / n, digits).alias("accuracy"),
        _pct((recall + specificity) / 2, digits).alias("balanced_accuracy"),
        _pct(recall, digits).alias("recall"),
        _pct(_ratio(tp, tp + fp), digits).alias("precision"),
        _pct(_ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1_score"),
        _pct(mcc, digits).alias("mcc"),
        _pct((fp + fn) / n * -math.log(EPSILON), digits).alias("log_loss"),
    )


def confusion_table(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] = THRESHOLDS, digits: int = 2
) -> DataFrame:
    """Counts and shares of the four outcomes per threshold, with the share of rows flagged."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = (tp + fp + fn + tn).cast("double")
    return _counts(df, label, score, thresholds).select(
        "threshold", "tp", "fp", "tn", "fn",
        *[_pct(F.col(c) / n, digits).alias(f"{c}_pct") for c in ("tp", "fp", "tn", "fn")],
        _pct((tp + tn) / n, digits).alias("accuracy"),
        _pct(_ratio(tp.cast("double"), tp + fn), digits).alias("recall"),
        _pct(_ratio(tp.cast("double"), tp + fp), digits).alias("precision"),
        (tp + fp).alias("predicted_positives"),
        _pct((tp + fp) / n, digits).alias("traffic_blocked_pct"),
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, fpr, tpr for `score >= threshold` at every distinct score."""
    return _outcomes(df, label, score).select(
        F.col("value").alias("threshold"),
        ((F.col("total_neg") - F.col("before_neg")) / F.nullif(F.col("total_neg"), F.lit(0))).alias("fpr"),
        ((F.col("total_pos") - F.col("before_pos")) / F.nullif(F.col("total_pos"), F.lit(0))).alias("tpr"),
        ((F.col("total_n") - F.col("before_n")) / F.col("total_n")).alias("flagged"),
        F.col("total_n").alias("rows"),
    )


def threshold_for_risk(
    df: DataFrame, label: str, score: str, risk_appetite: float = 0.02, mode: str = "recall"
) -> DataFrame:
    """One threshold for a risk appetite.

    `recall`: the highest score whose true-positive rate reaches round(n * r) / n.
    `flagged`: the lowest score at which at most the share r of rows is flagged.
    """
    points = roc_points(df, label, score)
    if mode == "recall":
        need = F.bround(F.col("rows") * F.lit(risk_appetite), 0) / F.col("rows")
        return points.where(F.col("tpr") >= need).agg(F.max("threshold").alias("threshold"))
    if mode == "flagged":
        return points.where(F.col("flagged") <= risk_appetite).agg(F.min("threshold").alias("threshold"))
    raise ValueError("mode is recall or flagged")


def classification_report(df: DataFrame, label: str, prediction: str, digits: int = 3) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    pairs = df.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # a confusion table: classes x classes rows
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    per = sides.groupBy("class").agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "called", "hit")])
    per = per.select(
        "class", "support", "hit",
        _ratio(F.col("hit"), F.col("called")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"),
    )
    metrics = ("precision", "recall", "f1")
    total = per.agg(
        F.sum("support").alias("support"), F.sum("hit").alias("hit"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in metrics],
    )
    accuracy = F.col("hit") / F.col("support")

    def line(name: str, values: Sequence[Column]) -> Column:
        return F.struct(F.lit(name).alias("class"), *[v.alias(m) for v, m in zip(values, metrics)], F.col("support"))

    summary = total.select(
        F.inline(
            F.array(
                line("accuracy", [accuracy] * 3),
                line("macro avg", [F.col(f"macro_{m}") for m in metrics]),
                line("weighted avg", [F.col(f"weighted_{m}") for m in metrics]),
            )
        )
    )
    return per.select("class", *metrics, "support").unionByName(summary).select(
        "class", *[F.round(m, digits).alias(m) for m in metrics], F.col("support").cast("long").alias("support")
    )
