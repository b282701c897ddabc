"""Numeric normalisation: the same functions for static frames and micro-batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    fill_index,
    fill_numeric,
    log_count,
    magnitude,
    standardise,
)
from tidemark.operators.encode import IndexMaps, apply_index_maps

Stats = Mapping[str, "Mapping[str, float] | tuple[float, float]"]


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 columns ``<c>_is_null``; take them before imputing."""
    return df.withColumns({f"{c}_is_null": F.col(c).isNull().cast("int") for c in columns})


def impute_and_log(
    df: DataFrame, numeric: Sequence[str], log_columns: Sequence[str]
) -> DataFrame:
    """Missing -> 0.0, else absolute value; log1p on the count columns. One projection."""
    logged = set(log_columns)
    unknown = logged - set(numeric)
    if unknown:
        raise ValueError(f"log columns outside the numeric columns: {sorted(unknown)}")
    out = {c: magnitude(F.col(c)) for c in numeric}
    out.update({c: log_count(magnitude(F.col(c))) for c in log_columns})
    return df.withColumns(out)


def scaler_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and sample deviation of every column, in one pass."""
    return df.agg(
        *[F.mean(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in columns],
    )


def scaler_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std) with an unusable deviation replaced by 1, the mean of no values by 0."""
    std = {c: F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(F.lit(1.0)) for c in columns}
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.coalesce(f"mean_{c}", F.lit(0.0)).alias("mean"), std[c].alias("std"))
            for c in columns
        ]
    )
    return scaler_row(df, columns).select(F.inline(rows))


def load_scaler(table: DataFrame) -> dict[str, dict[str, float]]:
    """Statistics table to a dictionary; one row per column."""
    return {r["column"]: {"mean": r["mean"], "std": r["std"]} for r in table.collect()}


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Fit on the training rows (an action; the result has one entry per column)."""
    return load_scaler(scaler_table(df, columns))


def apply_scaler(df: DataFrame, stats: Stats, columns: Sequence[str]) -> DataFrame:
    """Standardise with training statistics: ``{c: {mean, std}}`` or ``{c: (mean, std)}``."""
    out = {}
    for c in columns:
        s = stats[c]
        mean, std = (s["mean"], s["std"]) if isinstance(s, Mapping) else s
        out[c] = standardise(F.col(c), mean, std)
    return df.withColumns(out)


def apply_fitted_stages(
    df: DataFrame,
    model: PipelineModel,
    columns: Sequence[str],
    raw: str = "num_raw",
    scaled: str = "num_scaled",
) -> DataFrame:
    """Run a fitted assembler + scaler and write its vector back into the columns."""
    values = vector_to_array(F.col(scaled))
    out = model.transform(df)
    return out.withColumns({c: values[i] for i, c in enumerate(columns)}).drop(raw, scaled)


def fill_model_inputs(
    df: DataFrame, numeric: Sequence[str], index_columns: Sequence[str]
) -> DataFrame:
    """NaN and null numbers -> 0.0, null indices -> 0."""
    out = {c: fill_numeric(F.col(c)) for c in numeric}
    out.update({c: fill_index(F.col(c)) for c in index_columns})
    return df.withColumns(out)


def normalise_like_train(
    df: DataFrame,
    stats: Stats,
    maps: IndexMaps,
    numeric: Sequence[str],
    log_columns: Sequence[str],
    std_columns: Sequence[str],
    categories: Sequence[str],
) -> DataFrame:
    """The whole transformation with training artifacts, for batch and stream alike."""
    df = impute_and_log(df, numeric, log_columns)
    df = apply_scaler(df, stats, std_columns)
    return apply_index_maps(df, maps, categories)

