"""Closed-form formulas fitted to curve tables.

Every operator is a * shape(x) + b, so the best a and b are ordinary least
squares on shape(x): one grouped aggregate over the points fits every operator
of every curve, and the winner is picked inside the aggregate's row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formulas import (
    OPERATORS,
    apply_operator,
    apply_operator_column,
    finite_or_zero,
    render,
    shape,
)
from tidemark.functions.scalars import MONOTONE_BELOW, dbl, is_finite, sigmoid
from tidemark.operators.modes import mode_of_state, mode_state
from tidemark.operators.ordered import previous_row

CURVE = ("seed", "field_name", "dim")
FIELD = ("seed", "field_name")
DIRECTIONS = ("increasing", "decreasing", "flat")

# Acceptance, flatness, step and ranking tolerances.
R2_THRESHOLD = 0.90
FLAT_SS = 1e-12
R2_EPS = 1e-10
FLAT_VARIANCE = 1e-12
STEP_TOLERANCE = 1e-4
RANK_PLACES = 9
L1_PERCENTILE = 20.0


def operator_fits(curves: DataFrame, keys: Sequence[str] = CURVE) -> DataFrame:
    """Least-squares fit of every operator to every curve: (keys, fits).

    ``fits`` is an array in operator order of (operator, a, b, r2); an operator
    that cannot be fitted (flat curve, flat or overflowing shape) is left out.
    """
    x, phi = F.col("x"), F.col("phi")
    aggs = [F.count(phi).alias("_n"), F.avg(phi).alias("_my"), F.var_pop(phi).alias("_vy")]
    for op in OPERATORS:
        f = F.col(f"_f_{op}")
        aggs += [
            F.avg(f).alias(f"_m_{op}"),
            F.var_pop(f).alias(f"_v_{op}"),
            F.covar_pop(f, phi).alias(f"_c_{op}"),
        ]
    finite = curves.filter(is_finite(x) & is_finite(phi))
    points = finite.select(*keys, phi, *[shape(op, x).alias(f"_f_{op}") for op in OPERATORS])
    moments = points.groupBy(*keys).agg(*aggs)
    ss_tot = F.col("_n") * F.col("_vy")
    fits = []
    for i, op in enumerate(OPERATORS):
        a = F.try_divide(F.col(f"_c_{op}"), F.col(f"_v_{op}"))
        b = F.col("_my") - a * F.col(f"_m_{op}")
        ss_res = ss_tot - F.col("_n") * a * F.col(f"_c_{op}")
        r2 = dbl(1) - ss_res / (ss_tot + dbl(R2_EPS))
        fits.append(
            F.struct(
                F.round(r2, RANK_PLACES).alias("rank"),
                F.lit(-i).alias("late"),
                F.lit(op).alias("operator"),
                a.alias("a"),
                b.alias("b"),
                r2.alias("r2"),
            )
        )
    usable = F.filter(
        F.array(*fits), lambda e: is_finite(e["a"]) & is_finite(e["b"]) & is_finite(e["r2"])
    )
    return moments.filter(ss_tot >= dbl(FLAT_SS)).select(*keys, usable.alias("fits"))


def fit_curves(curves: DataFrame, keys: Sequence[str] = CURVE) -> DataFrame:
    """Best operator per curve: (keys, operator, r2, param_a, param_b, formula).

    The higher R2 wins, the earlier operator on ties; curves without any usable
    fit are left out.
    """
    best = operator_fits(curves, keys).select(*keys, F.array_max("fits").alias("best"))
    fitted = best.filter(F.col("best").isNotNull())
    a, b, op = F.col("best.a"), F.col("best.b"), F.col("best.operator")
    return fitted.select(
        *keys,
        op.alias("operator"),
        F.col("best.r2").alias("r2"),
        a.alias("param_a"),
        b.alias("param_b"),
        render(op, a, b).alias("formula"),
    )


def field_summary(fits: DataFrame, threshold: float = R2_THRESHOLD) -> DataFrame:
    """One row per (seed, field): dominant operator, spread of R2, agreement, acceptance.

    The parameters shown are those of the best fit among the dimensions that
    chose the dominant operator (the lowest dimension on ties).
    """
    op, r2, dim = F.col("operator"), F.col("r2"), F.col("dim")
    entry = F.struct(r2, (-dim).alias("late"), F.col("param_a"), F.col("param_b"), F.col("formula"))
    best = [F.max(F.when(op == name, entry)).alias(f"_best_{name}") for name in OPERATORS]
    grouped = fits.groupBy(*FIELD).agg(
        *mode_state(op, OPERATORS, dim),
        *best,
        F.count("*").alias("n_dims_fitted"),
        F.avg(r2).alias("r2_mean"),
        F.stddev_pop(r2).alias("r2_std"),
        F.min(r2).alias("r2_min"),
        F.max(r2).alias("r2_max"),
        F.min_by(F.struct(op, r2), dim).alias("_dim0"),
    )
    winner = F.coalesce(
        *[F.when(F.col("_mode.name") == name, F.col(f"_best_{name}")) for name in OPERATORS]
    )
    return (
        grouped.withColumn("_mode", mode_of_state(OPERATORS))
        .withColumn("_win", winner)
        .select(
            *FIELD,
            F.col("_mode.name").alias("operator"),
            F.col("_win.param_a").alias("param_a"),
            F.col("_win.param_b").alias("param_b"),
            F.col("_win.formula").alias("formula"),
            (F.col("r2_mean") >= dbl(threshold)).alias("accepted"),
            "n_dims_fitted",
            (F.col("_mode.n") / F.col("n_dims_fitted")).alias("operator_agreement"),
            "r2_mean",
            "r2_std",
            "r2_min",
            "r2_max",
            F.col("_dim0.operator").alias("dim0_operator"),
            F.col("_dim0.r2").alias("dim0_r2"),
        )
    )


def prune_by_norm(norms: DataFrame, percentile: float = L1_PERCENTILE) -> DataFrame:
    """Fields whose norm reaches the percentile of all norms of the same seed.

    A convenience cut of how many formulas to inspect, not a measure of
    importance.  A seed has one norm per field, so its exact percentile is cheap.
    """
    cuts = norms.groupBy("seed").agg(
        F.percentile("norm", F.lit(percentile / 100.0)).alias("threshold")
    )
    return norms.join(cuts, "seed").filter(F.col("norm") >= F.col("threshold"))


def curve_steps(curves: DataFrame, tolerance: float = STEP_TOLERANCE) -> DataFrame:
    """Rising, falling and all steps along x, one row per curve."""
    along = previous_row(curves.select(*CURVE, "x", "phi"), CURVE, "x", ["phi"])
    diff = F.col("phi") - F.col("prev_phi")
    return along.groupBy(*CURVE).agg(
        F.count_if(diff > dbl(tolerance)).alias("n_up"),
        F.count_if(diff < dbl(-tolerance)).alias("n_down"),
        F.count(diff).alias("n_steps"),
    )


def _field_monotonicity(rates: DataFrame) -> DataFrame:
    grouped = rates.groupBy(*FIELD).agg(
        *mode_state(F.col("direction"), DIRECTIONS, F.col("dim")),
        F.avg("rate").alias("violation_rate"),
        F.stddev_pop("rate").alias("violation_std"),
    )
    return grouped.select(
        *FIELD,
        "violation_rate",
        "violation_std",
        mode_of_state(DIRECTIONS)["name"].alias("direction"),
        (F.col("violation_rate") < dbl(MONOTONE_BELOW)).alias("is_monotone"),
    )


def _rate(count: Column) -> Column:
    moved = F.col("n_up") + F.col("n_down") > 0
    return F.when(moved, F.try_divide(count.cast("double"), F.col("n_steps"))).otherwise(dbl(0))


def monotonicity(curves: DataFrame, tolerance: float = STEP_TOLERANCE) -> DataFrame:
    """Share of steps against each curve's own main direction, per (seed, field)."""
    up, down = F.col("n_up"), F.col("n_down")
    rates = curve_steps(curves, tolerance).select(
        *CURVE,
        _rate(F.least(up, down)).alias("rate"),
        F.when(up + down == 0, "flat")
        .when(up >= down, "increasing")
        .otherwise("decreasing")
        .alias("direction"),
    )
    return _field_monotonicity(rates)


def monotonicity_against(
    curves: DataFrame, expected: Mapping[str, str], tolerance: float = STEP_TOLERANCE
) -> DataFrame:
    """Share of steps against a given direction; fields not named use their own."""
    unknown = set(expected.values()) - {"increasing", "decreasing"}
    if unknown:
        raise ValueError(f"unknown directions {sorted(unknown)}")
    up, down = F.col("n_up"), F.col("n_down")
    own = F.when(up >= down, "increasing").otherwise("decreasing")
    if expected:
        pairs = F.create_map(*[F.lit(p) for kv in expected.items() for p in kv])
        wanted = F.coalesce(F.try_element_at(pairs, F.col("field_name")), own)
    else:
        wanted = own
    rates = curve_steps(curves, tolerance).select(
        *CURVE,
        _rate(F.when(wanted == "increasing", down).otherwise(up)).alias("rate"),
        F.when(up + down == 0, "flat").otherwise(wanted).alias("direction"),
    )
    return _field_monotonicity(rates)


def scale_offset(curves: DataFrame, formulas: DataFrame) -> DataFrame:
    """Least-squares scale and offset of a field's formula to each of its curves.

    ``formulas`` has one row per (seed, field_name) with operator, param_a and
    param_b.  A constant formula gets scale 0 and the curve's mean as offset.
    ``curve_rel_error`` is the remaining RMSE relative to the curve's deviation.
    """
    shapes = formulas.select(*FIELD, "operator", "param_a", "param_b")
    value = apply_operator_column(
        F.col("operator"), F.col("x"), F.col("param_a"), F.col("param_b")
    )
    points = curves.join(shapes, list(FIELD)).withColumn("_f", finite_or_zero(value))
    moments = points.groupBy(*CURVE, "operator").agg(
        F.avg("_f").alias("_mf"),
        F.var_pop("_f").alias("_vf"),
        F.avg("phi").alias("_my"),
        F.var_pop("phi").alias("_vy"),
        F.covar_pop("_f", "phi").alias("_c"),
    )
    constant = F.col("_vf") < dbl(FLAT_VARIANCE)
    scale = F.when(constant, dbl(0)).otherwise(F.try_divide(F.col("_c"), F.col("_vf")))
    left = F.greatest(F.col("_vy") - scale * F.col("_c"), dbl(0))
    return moments.select(
        *CURVE,
        "operator",
        scale.alias("scale"),
        (F.col("_my") - F.when(constant, dbl(0)).otherwise(scale * F.col("_mf"))).alias("offset"),
        (F.sqrt(left) / (F.sqrt(F.col("_vy")) + dbl(1e-9))).alias("curve_rel_error"),
    )


def curve_errors(scaled: DataFrame) -> DataFrame:
    """Relative curve error per (seed, field): mean over the dimensions."""
    return scaled.groupBy(*FIELD, "operator").agg(
        F.avg("curve_rel_error").alias("curve_rel_error")
    )


def curve_error_report(errors: DataFrame) -> DataFrame:
    """Mean and largest curve error over the fields of each seed."""
    return errors.groupBy("seed").agg(
        F.count("*").alias("n_fields_substituted"),
        F.avg("curve_rel_error").alias("curve_rel_error_mean"),
        F.max("curve_rel_error").alias("curve_rel_error_max"),
    )


def linear_r2(curves: DataFrame) -> DataFrame:
    """R2 of a straight line per curve: low means truly curved."""
    x, phi = F.col("x"), F.col("phi")
    moments = curves.groupBy(*CURVE).agg(
        F.count(phi).alias("_n"),
        F.var_pop(phi).alias("_vy"),
        F.var_pop(x).alias("_vx"),
        F.covar_pop(x, phi).alias("_c"),
    )
    left = F.col("_vy") - F.coalesce(F.try_divide(F.col("_c") * F.col("_c"), F.col("_vx")), dbl(0))
    n = F.col("_n")
    return moments.select(
        *CURVE, (dbl(1) - n * left / (n * F.col("_vy") + dbl(1e-12))).alias("linear_r2")
    )


def additive_score(formulas: Sequence[tuple[str, str, float, float]]) -> Column:
    """sigmoid of the plain sum of formulas (field, operator, a, b).

    Kept for old results only: it ignores everything else in the model.
    """
    total = dbl(0)
    for name, op, a, b in formulas:
        total = total + apply_operator(op, F.col(name), dbl(a), dbl(b))
    return sigmoid(total)


def gap_rmse(df: DataFrame, score: str, formula_score: Column, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE between a model's score and the additive formula score."""
    d = F.col(score) - formula_score
    return df.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("gap_rmse"))
