"""Reports over formula results and experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formulas import number_text
from tidemark.functions.scalars import MONOTONE_BELOW, dbl, rounded
from tidemark.operators.guards import require_rows
from tidemark.operators.modes import mode_first_seen, with_single_row
from tidemark.operators.ordered import exact_quantiles
from tidemark.sources.schemas import DEFAULT_ENCODER


def dominant_stability(results: DataFrame) -> DataFrame:
    """Stability (a): how many of all seeds give a field its dominant operator.

    Accepted results only; the share is over all seeds present.  With one seed
    the share is trivially 1, which ``is_trivial`` flags.
    """
    seeds = results.agg(F.count_distinct("seed").alias("n_seeds"))
    modes = mode_first_seen(results.filter("is_accepted"), ["field_name"], "operator", "seed")
    return with_single_row(modes, seeds).select(
        "field_name",
        F.col("mode").alias("operator"),
        F.col("mode_count").alias("seeds_agreeing"),
        "n_seeds",
        (F.col("mode_count") / F.col("n_seeds")).alias("stability"),
        (F.col("n_seeds") < 2).alias("is_trivial"),
    )


def operator_stability(results: DataFrame, dataset: str, seeds: Sequence[int]) -> DataFrame:
    """Stability (b): per field and operator, the share of the given seeds choosing it.

    Ordered by field, most frequent operator first.  A missing gap stays null.
    """
    chosen = results.filter(
        (F.col("dataset") == dataset) & F.col("seed").isin(list(seeds)) & F.col("is_accepted")
    )
    return (
        chosen.groupBy(F.col("field_name").alias("field"), "operator")
        .agg(
            F.count("*").alias("seeds_count"),
            (F.count("*") / F.lit(len(seeds))).alias("stability_pct"),
            F.round(F.avg("r2"), 4).alias("avg_r2"),
            F.round(F.avg("gap_rmse"), 6).alias("avg_gap_rmse"),
        )
        .orderBy("field", F.desc("seeds_count"), "operator")
    )


def operator_sets(results: DataFrame, encoder: str = DEFAULT_ENCODER) -> DataFrame:
    """Stability (c): the operators a field received over all seeds; stable if only one."""
    chosen = results.filter((F.col("encoder") == encoder) & F.col("is_accepted"))
    grouped = chosen.groupBy("field_name").agg(
        F.sort_array(F.collect_set("operator")).alias("operators"),  # at most seven names
        F.avg("r2").alias("avg_r2"),
        F.count("*").alias("n_seeds"),
    )
    return grouped.select(
        "*",
        F.size("operators").cast("long").alias("n_operators"),
        (F.size("operators") == 1).alias("is_stable"),
    ).orderBy("field_name")


def full_stability(results: DataFrame) -> DataFrame:
    """Stability (d): like (a), with the mean R2 over every seed, accepted or not."""
    means = results.groupBy("field_name").agg(F.avg("r2").alias("r2_mean"))
    return dominant_stability(results).drop("is_trivial").join(means, "field_name")


def stability_totals(stability: DataFrame) -> DataFrame:
    """One row: fields, fields with the same operator in all seeds, mean stability."""
    return stability.agg(
        F.count("*").alias("n_fields"),
        F.count_if(F.col("stability") == 1.0).alias("n_perfect"),
        F.avg("stability").alias("mean_stability"),
    )


def require_accepted(results: DataFrame) -> DataFrame:
    require_rows(results.filter("is_accepted"), "no formula reached the R2 threshold in any seed")
    return results


def cross_dataset(results: DataFrame, field_name: str) -> DataFrame:
    """One field's operators over datasets."""
    chosen = results.filter((F.col("field_name") == field_name) & F.col("is_accepted"))
    return (
        chosen.groupBy("dataset", "operator")
        .agg(F.count("*").alias("count"), F.avg("r2").alias("avg_r2"))
        .orderBy("dataset", F.desc("count"), "operator")
    )


def best_formulas(results: DataFrame) -> DataFrame:
    """The accepted result with the highest R2 per (dataset, field); lowest seed on ties."""
    rest = [c for c in results.columns if c not in ("dataset", "field_name")]
    return (
        results.filter("is_accepted")
        .groupBy("dataset", "field_name")
        .agg(F.max_by(F.struct(*rest), F.struct(F.col("r2"), -F.col("seed"))).alias("_row"))
        .select("dataset", "field_name", *[F.col("_row")[c].alias(c) for c in rest])
    )


def scoring_summary(results: DataFrame, dataset: str, seeds: Sequence[int]) -> DataFrame:
    """Readable scoring formula: one line per field, plus a header naming the fields.

    One row; its size is bounded by the number of fields.
    """
    stability = operator_stability(results, dataset, seeds)
    first = F.struct((-F.col("seeds_count")).alias("late"), "operator", "seeds_count", "avg_r2")
    leading = stability.groupBy("field").agg(F.min(first).alias("top"))
    best = best_formulas(results.filter(F.col("dataset") == dataset)).select(
        F.col("field_name").alias("field"), "formula_str"
    )
    line = F.concat(
        F.lit("  φ_"),
        F.col("field"),
        F.lit("(x) ≈ "),
        F.col("formula_str"),
        F.lit("   [stability "),
        F.col("top.seeds_count").cast("string"),
        F.lit(f"/{len(seeds)}  R²="),
        number_text(F.col("top.avg_r2")),
        F.lit("]"),
    )
    lines = leading.join(best, "field").select("field", line.alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("field", "line")))
    return lines.agg(ordered.alias("l")).select(
        F.concat(
            F.lit("ŷ ≈ f("),
            F.array_join(F.transform("l", lambda e: e["field"]), ", "),
            F.lit(") where:\n"),
            F.array_join(F.transform("l", lambda e: e["line"]), "\n"),
        ).alias("scoring_formula")
    )


def field_formula_text(summary: DataFrame, position: Column) -> DataFrame:
    """Per seed: the accepted formulas in field order under a header.

    ``position`` is the field's index in the model; the text is bounded by the
    number of fields.
    """
    entry = F.struct(position.alias("p"), F.col("formula").alias("f"))
    listed = summary.groupBy("seed").agg(
        F.sort_array(F.collect_list(F.when(F.col("accepted"), entry))).alias("l")
    )
    names = F.transform("l", lambda e: F.concat(F.lit("F"), e["p"].cast("string")))
    lines = F.transform(
        "l", lambda e: F.concat(F.lit("  φ_F"), e["p"].cast("string"), F.lit("(x) ≈ "), e["f"])
    )
    text = F.concat(
        F.lit("ŷ ≈ f("), F.array_join(names, ", "), F.lit(") where:\n"), F.array_join(lines, "\n")
    )
    return listed.select(
        "seed",
        F.when(F.size("l") == 0, "No accepted operators found.").otherwise(text).alias("formula_text"),
    )


def fidelity_summary(ablations: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds of curve error and AUC loss (one row)."""
    return ablations.agg(
        F.count("*").alias("n_seeds"),
        F.avg("curve_rel_error_mean").alias("curve_error_mean"),
        F.stddev_samp("curve_rel_error_mean").alias("curve_error_std"),
        F.avg("delta_auc").alias("delta_auc_mean"),
        F.stddev_samp("delta_auc").alias("delta_auc_std"),
    )


def monotone_summary(monotone: DataFrame) -> DataFrame:
    """Monotone fields, all fields and the mean violation rate per seed."""
    return monotone.groupBy("seed").agg(
        F.count_if(F.col("violation_rate") < MONOTONE_BELOW).alias("n_monotone"),
        F.count("*").alias("n_fields"),
        F.avg("violation_rate").alias("violation_mean"),
    )


# ── experiment results ──────────────────────────────────────────────────────

# Optional measures of an experiment table and the columns they give.
MEASURES = (
    ("test_auc", "auc_mean", "auc_std"),
    ("test_logloss", "logloss_mean", "logloss_std"),
    ("train_seconds", "train_seconds_mean", None),
    ("n_params", "n_params", None),
)


def encoder_summary(results: DataFrame) -> DataFrame:
    """Seeds, mean and sample deviation per encoder, for the measures that exist."""
    aggs = [F.count("*").alias("n_seeds")]
    for column, mean, deviation in MEASURES:
        if column in results.columns:
            aggs.append(F.avg(column).alias(mean))
            if deviation:
                aggs.append(F.stddev_samp(column).alias(deviation))
    return results.groupBy("encoder").agg(*aggs)


def encoder_ranking(summary: DataFrame) -> DataFrame:
    """The summary rounded for reading, best AUC first."""
    places = {"auc_mean": 4, "auc_std": 4, "logloss_mean": 4, "train_seconds_mean": 1}
    shown = [rounded(F.col(c), p).alias(c) for c, p in places.items() if c in summary.columns]
    return summary.select("encoder", *shown, "n_seeds").orderBy(F.desc("auc_mean"), "encoder")


def encoder_difference(results: DataFrame, left: str, right: str, measure: str = "test_auc") -> DataFrame:
    """One row: mean of a measure under two encoders and their difference."""
    mean_left = F.avg(F.when(F.col("encoder") == left, F.col(measure)))
    mean_right = F.avg(F.when(F.col("encoder") == right, F.col(measure)))
    return results.agg(
        mean_left.alias("left_mean"),
        mean_right.alias("right_mean"),
        (mean_left - mean_right).alias("difference"),
    )


def mean_by_dataset(results: DataFrame, measure: str = "test_auc", dataset: str | None = None) -> DataFrame:
    """Mean of a measure per dataset and encoder."""
    chosen = results if dataset is None else results.filter(F.col("dataset") == dataset)
    return chosen.groupBy("dataset", "encoder").agg(F.avg(measure).alias("mean_value"))


def accepted_share(results: DataFrame) -> DataFrame:
    """One row: accepted results over all results (null if there are none)."""
    n = F.count("*")
    return results.agg(
        n.alias("n_results"),
        F.try_divide(F.count_if("is_accepted").cast("double"), n).alias("accepted_share"),
        F.avg(F.when(F.col("is_accepted"), F.col("r2"))).alias("r2_mean_accepted"),
    )


def collapse_sets(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Distinct values of a column per key and their number; for small value sets."""
    return df.groupBy(*keys).agg(
        F.sort_array(F.collect_set(column)).alias("values"),
        F.count_distinct(column).alias("n_values"),
    )


# ── timings ─────────────────────────────────────────────────────────────────


def timing_summary(timings: DataFrame, keys: Sequence[str], rows_per_run: int) -> DataFrame:
    """Mean, population deviation, median, p95, encoder share and rows per second.

    ``timings`` has one row per run with ``full_ms`` and ``encoder_ms``; a key
    has as many rows as there were runs.  Moments are one aggregate.  The quantiles,
    of finite timings, come from counts of buckets and runs of the few that hold a
    wanted position, so no task holds a key's timings.  A null key is a key.
    """
    name = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])).alias("_key")
    named = timings.select(*keys, name, "full_ms", "encoder_ms")
    moments = named.groupBy(*keys, "_key").agg(
        F.count("*").alias("n_runs"),
        F.avg("full_ms").alias("full_ms_mean"),
        F.stddev_pop("full_ms").alias("full_ms_std"),
        F.avg("encoder_ms").alias("encoder_ms_mean"),
        F.stddev_pop("encoder_ms").alias("encoder_ms_std"),
    )
    placed = exact_quantiles(named, ["full_ms", "encoder_ms"], [0.5, 0.95], ["_key"])

    def quantile(field: str, i: int) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("quantiles")[i]))

    wide = placed.groupBy("_key").agg(
        quantile("full_ms", 0).alias("full_ms_p50"),
        quantile("full_ms", 1).alias("full_ms_p95"),
        quantile("encoder_ms", 1).alias("encoder_ms_p95"),
    )
    return moments.join(wide, "_key", "left").select(
        *keys,
        "n_runs",
        "full_ms_mean",
        "full_ms_std",
        "full_ms_p50",
        "full_ms_p95",
        "encoder_ms_mean",
        "encoder_ms_std",
        "encoder_ms_p95",
        F.coalesce(F.try_divide("encoder_ms_mean", "full_ms_mean"), dbl(0)).alias("encoder_share"),
        F.try_divide(dbl(1000.0 * rows_per_run), F.col("full_ms_mean")).alias("rows_per_s"),
    )


def versus_fastest(summary: DataFrame) -> DataFrame:
    """Every row's mean time over the fastest one."""
    fastest = summary.agg(F.min("full_ms_mean").alias("_fastest"))
    return with_single_row(summary, fastest).select(
        *summary.columns, (F.col("full_ms_mean") / F.col("_fastest")).alias("vs_fastest")
    )


def ratio_pairs(summary: DataFrame, key: str, pairs: Sequence[tuple[str, str]], measure: str = "full_ms_mean") -> DataFrame:
    """Ratio of a measure between named rows: (numerator, denominator, ratio)."""
    named = F.array(*[F.struct(F.lit(a).alias("numerator"), F.lit(b).alias("denominator")) for a, b in pairs])
    asked = summary.sparkSession.range(1).select(F.inline(named))
    top = summary.select(F.col(key).alias("numerator"), F.col(measure).alias("_top"))
    bottom = summary.select(F.col(key).alias("denominator"), F.col(measure).alias("_bottom"))
    return (
        asked.join(top, "numerator")
        .join(bottom, "denominator")
        .select("numerator", "denominator", F.try_divide("_top", "_bottom").alias("ratio"))
    )


def add_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    return table.unionByName(rows, allowMissingColumns=True)
