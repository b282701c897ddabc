"""Evaluation metrics as distributed aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import LOG_LOSS_EPS, dbl, is_finite
from tidemark.operators.ordered import running_totals

NAN = float("nan")


def log_loss(label: Column, p: Column, eps: float = LOG_LOSS_EPS) -> Column:
    """Aggregate: mean binary cross-entropy with p clipped to [eps, 1 - eps].

    Scores that are no number are left out.
    """
    q = F.greatest(F.least(p, dbl(1 - eps)), dbl(eps))
    y = label.cast("double")
    return F.avg(F.when(is_finite(p), -(y * F.log(q) + (dbl(1) - y) * F.log(dbl(1) - q))))


def score_levels(
    df: DataFrame, label: str, score: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, score, pos, neg): one row per distinct finite score of labelled rows."""
    usable = df.filter(F.col(label).isNotNull() & is_finite(F.col(score)))
    return usable.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(F.lit(1) - F.col(label).cast("long")).alias("neg"),
    )


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per key; ties count one half, one class gives NaN.

    Rows are first reduced to distinct scores, then ordered in score buckets:
    no key is ever sorted in one task.
    """
    levels = running_totals(score_levels(df, label, score, keys), keys, "score", ["pos", "neg"])
    won = F.col("pos").cast("double") * (F.col("before_neg") + dbl(0.5) * F.col("neg"))
    area = F.sum(won) / F.nullif(
        F.max("total_pos").cast("double") * F.max("total_neg"), dbl(0)
    )
    return levels.groupBy(*keys).agg(F.coalesce(area, dbl(NAN)).alias("auc"))


def binned_auc(
    df: DataFrame, label: str, score: str, bins: int, keys: Sequence[str] = ()
) -> DataFrame:
    """AUC with probabilities reduced to ``bins`` equal-width levels: bounded state per key."""
    level = F.floor(F.least(F.col(score), dbl(1 - 1e-12)) * dbl(bins)).cast("double")
    return auc(df.withColumn("_level", level), label, "_level", keys)


def batch_counts(
    df: DataFrame,
    label: str = "label",
    score: str = "p_click",
    keys: Sequence[str] = (),
    eps: float = LOG_LOSS_EPS,
) -> DataFrame:
    """Impressions, clicks, observed and predicted rate, log-loss; unlabelled rows only counted."""
    y, p = F.col(label), F.col(score)
    seen = F.when(y.isNotNull() & is_finite(p), p)
    return df.groupBy(*keys).agg(
        F.count(y).alias("impressions"),
        F.coalesce(F.sum(y.cast("long")), F.lit(0)).alias("clicks"),
        F.avg(y.cast("double")).alias("ctr_observed"),
        F.avg(seen).alias("ctr_predicted"),
        log_loss(y, seen, eps).alias("logloss"),
        F.count_if(y.isNull()).alias("n_unlabelled"),
    )


def batch_metrics(
    df: DataFrame,
    label: str = "label",
    score: str = "p_click",
    keys: Sequence[str] = (),
    eps: float = LOG_LOSS_EPS,
) -> DataFrame:
    """Counts, rates, log-loss and AUC, one row per key."""
    counts = batch_counts(df, label, score, keys, eps)
    areas = auc(df, label, score, keys)
    if keys:
        joined = counts.join(areas, list(keys), "left")
    else:
        joined = counts.withColumn("_one", F.lit(1)).join(
            areas.withColumn("_one", F.lit(1)), "_one", "left"
        ).drop("_one")
    return joined.withColumn("auc", F.coalesce("auc", dbl(NAN)))


def positive_rate(df: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )


def parity(df: DataFrame, left: str, right: str, tolerance: float) -> DataFrame:
    """Two scorings of the same rows: exact equality, largest difference, within tolerance."""
    gap = F.max(F.abs(F.col(left) - F.col(right)))
    return df.agg(
        F.bool_and(F.col(left).eqNullSafe(F.col(right))).alias("is_equal"),
        gap.alias("max_abs_diff"),
        (gap <= dbl(tolerance)).alias("within_tolerance"),
    )
