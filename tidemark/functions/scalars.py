"""Scalar column functions shared by batch and stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the monitoring and fidelity verdicts.
PSI_WARNING = 0.10
PSI_ALERT = 0.25
COVERAGE_ALERT = 0.99
MONOTONE_BELOW = 0.05
ALMOST_MONOTONE_BELOW = 0.15
FAITHFUL_BELOW = 0.20
FAIR_BELOW = 0.40

LOG_LOSS_EPS = 1e-7
INPUT_CLIP = 10.0


def dbl(value: float) -> Column:
    """A double literal (a bare 2.0 in SQL text would be a decimal)."""
    return F.lit(float(value))


def double_table(values: Iterable[float]) -> Column:
    """Constant array<double>; folds to a single literal, however long it is."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def magnitude(x: Column) -> Column:
    """Absolute value with missing read as 0.0."""
    return F.coalesce(F.abs(x), dbl(0))


def log_count(x: Column) -> Column:
    """log1p of a count column, never below log1p(0)."""
    return F.log1p(F.greatest(x, dbl(0)))


def standardise(x: Column, mean: float, std: float | None) -> Column:
    """(x - mean) / std; a missing or zero deviation counts as 1."""
    return (x - dbl(mean)) / dbl(std if std else 1.0)


def winsorise(x: Column, limit: float = INPUT_CLIP) -> Column:
    """Clipped to [-limit, limit]; null and NaN stay what they are."""
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.greatest(F.least(x, dbl(limit)), dbl(-limit)))


def is_finite(x: Column) -> Column:
    """True only for real numbers: null, NaN and infinities are false."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < dbl(float("inf"))), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def fill_numeric(x: Column) -> Column:
    """Model input: null and NaN become 0.0, infinities the largest double."""
    big = dbl(1.7976931348623157e308)
    return F.greatest(F.least(F.coalesce(F.nanvl(x, dbl(0)), dbl(0)), big), -big)


def fill_index(idx: Column) -> Column:
    return F.coalesce(idx, F.lit(0))


def clamp_index(idx: Column, n_values: int) -> Column:
    """Index forced into [0, n_values)."""
    return F.greatest(F.least(idx, F.lit(n_values - 1)), F.lit(0)).cast("int")


def sigmoid(x: Column) -> Column:
    return dbl(1) / (dbl(1) + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def psi_level(psi: Column) -> Column:
    return F.when(psi >= PSI_ALERT, "alert").when(psi >= PSI_WARNING, "warning").otherwise("ok")


def monotone_verdict(rate: Column) -> Column:
    return (
        F.when(rate < MONOTONE_BELOW, "monotone")
        .when(rate < ALMOST_MONOTONE_BELOW, "almost")
        .otherwise("not monotone")
    )


def fidelity_verdict(error: Column) -> Column:
    return F.when(error < FAITHFUL_BELOW, "faithful").when(error < FAIR_BELOW, "fair").otherwise("low")


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded for reports; the added zero turns -0.0 into 0.0."""
    return F.round(x, places) + dbl(0)


def rounded_or_zero(x: Column, places: int) -> Column:
    return rounded(F.coalesce(x, dbl(0)), places)
