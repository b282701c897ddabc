"""Monitoring rules over the per-batch metrics and drift tables.

Both tables hold one row per batch (and field), never raw impressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import COVERAGE_ALERT, dbl
from tidemark.operators.modes import with_single_row
from tidemark.operators.ordered import previous_row

# Fixed value: largest accepted distance between predicted and observed rate.
CALIBRATION_LIMIT = 0.03


def latest_batch(df: DataFrame) -> DataFrame:
    """The rows of the greatest batch_id."""
    newest = df.agg(F.max("batch_id").alias("_newest"))
    return with_single_row(df, newest).filter(F.col("batch_id") == F.col("_newest")).drop("_newest")


def last_batches(metrics: DataFrame, n: int = 5) -> DataFrame:
    return metrics.orderBy(F.desc("batch_id")).limit(n)


def calibration_gap(metrics: DataFrame) -> DataFrame:
    """Predicted minus observed rate of the last batch, in percentage points."""
    gap = dbl(100) * (F.max("ctr_predicted") - F.max("ctr_observed"))
    return latest_batch(metrics).groupBy("batch_id").agg(gap.alias("calibration_gap_pp"))


def fields_in_alert(drift: DataFrame) -> DataFrame:
    """Fields of the last batch with a PSI or a coverage alert."""
    alert = (F.col("psi_level") == "alert") | F.col("coverage_alert")
    return latest_batch(drift).groupBy("batch_id").agg(F.count_if(alert).alias("n_fields_alert"))


def miscalibrated(metrics: DataFrame, limit: float = CALIBRATION_LIMIT) -> DataFrame:
    """Batches that are off by more than the limit, and were already in the batch before."""
    off = F.abs(F.col("ctr_predicted") - F.col("ctr_observed")) > dbl(limit)
    flagged = metrics.withColumn("off", off)
    return (
        previous_row(flagged, [], "batch_id", ["off"])
        .filter(F.col("off") & F.col("prev_off"))
        .select("batch_id", "ctr_observed", "ctr_predicted")
    )


def input_drift(drift: DataFrame) -> DataFrame:
    """Batches with a PSI alert in any field."""
    return (
        drift.filter(F.col("psi_level") == "alert")
        .groupBy("batch_id")
        .agg(F.count("*").alias("n_fields"), F.max("psi").alias("max_psi"))
    )


def off_curve(drift: DataFrame, limit: float = COVERAGE_ALERT) -> DataFrame:
    """Batches in which a field's coverage of the calibrated range is too low."""
    return (
        drift.filter(F.col("coverage") < dbl(limit))
        .groupBy("batch_id")
        .agg(F.count("*").alias("n_fields"), F.min("coverage").alias("min_coverage"))
    )


def model_changed(metrics: DataFrame) -> DataFrame:
    """Batches served by another model than the batch before."""
    return (
        previous_row(metrics, [], "batch_id", ["model"])
        .filter(F.col("model") != F.col("prev_model"))
        .select("batch_id", F.col("prev_model").alias("previous_model"), "model")
    )


def score_histogram(predictions: DataFrame, n_bins: int = 20, score: str = "p_click") -> DataFrame:
    """Histogram of the last batch's scores on equal-width bins of [0, 1]."""
    bucket = F.width_bucket(F.col(score), dbl(0), dbl(1), F.lit(n_bins))
    clipped = F.greatest(F.least(bucket, F.lit(n_bins)), F.lit(1)).cast("int")
    return (
        latest_batch(predictions.select("batch_id", score))
        .groupBy(clipped.alias("bin"))
        .agg(F.count("*").alias("n_rows"))
    )


def drift_matrix(drift: DataFrame, batches: Sequence[int] | None = None) -> DataFrame:
    """Fields by batches with the PSI as cell; give the batches to save a pass."""
    return drift.groupBy("field").pivot("batch_id", list(batches) if batches else None).agg(F.first("psi"))


def latency_versus_auc(timing: DataFrame, encoders: DataFrame) -> DataFrame:
    """Mean latency and mean AUC side by side, fastest first."""
    return (
        timing.select("encoder", "full_ms_mean")
        .join(encoders.select("encoder", "auc_mean"), "encoder")
        .orderBy("full_ms_mean", "encoder")
    )


def grid_size_table(results: DataFrame) -> DataFrame:
    """Mean AUC and rank per grid size, smallest grid first."""
    means = results.groupBy("grid_size").agg(F.avg("test_auc").alias("test_auc"))
    best = Window.orderBy(F.desc("test_auc"), "grid_size")  # a handful of grid sizes
    return means.withColumn("auc_rank", F.row_number().over(best)).orderBy("grid_size")


def dominant_operator(results: DataFrame) -> DataFrame:
    """Per field, the operator most accepted results share (first name on ties)."""
    counted = (
        results.filter("is_accepted").groupBy("field_name", "operator").agg(F.count("*").alias("n_seeds"))
    )
    first = F.struct((-F.col("n_seeds")).alias("late"), "operator", "n_seeds")
    return counted.groupBy("field_name").agg(F.min(first).alias("top")).select(
        "field_name", F.col("top.operator").alias("operator"), F.col("top.n_seeds").alias("n_seeds")
    )
