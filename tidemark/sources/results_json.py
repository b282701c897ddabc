"""Nested formula documents flattened to result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.guards import require_rows
from tidemark.sources.schemas import DEFAULT_ENCODER, FORMULA_DOCUMENT


def result_rows(
    fits: DataFrame,
    run_id: Column,
    dataset: Column,
    encoder: str = DEFAULT_ENCODER,
) -> DataFrame:
    """Fit rows under the names the result table uses.

    ``fits`` has seed, field_name and the fit columns; absent optional columns
    become nulls.  ``r2`` falls back to ``r2_mean``, a missing formula to '?'.
    """

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in fits.columns else F.lit(None)).cast(kind).alias(name)

    r2 = [F.col(c) for c in ("r2", "r2_mean") if c in fits.columns]
    params = {
        "param_a": F.get(F.col("params"), F.lit(0)) if "params" in fits.columns else optional("param_a", "double"),
        "param_b": F.get(F.col("params"), F.lit(1)) if "params" in fits.columns else optional("param_b", "double"),
    }
    accepted = "accepted" if "accepted" in fits.columns else "is_accepted"
    formula = "formula" if "formula" in fits.columns else "formula_str"
    return fits.select(
        run_id.alias("run_id"),
        dataset.alias("dataset"),
        F.col("seed").cast("int").alias("seed"),
        "field_name",
        F.lit(encoder).alias("encoder"),
        "operator",
        F.coalesce(F.col(formula), F.lit("?")).alias("formula_str"),
        F.coalesce(*r2, F.lit(0.0)).alias("r2"),
        F.coalesce(F.col(accepted), F.lit(False)).alias("is_accepted"),
        optional("field_idx", "int"),
        *[c.alias(n) for n, c in params.items()],
        *[optional(c, "double") for c in ("r2_mean", "r2_std", "r2_min", "operator_agreement")],
        optional("n_dims_fitted", "long"),
        *[optional(c, "double") for c in ("curve_rel_error", "gap_rmse")],
        optional("is_monotone", "boolean"),
        optional("violation_rate", "double"),
    )


def flatten_document(documents: DataFrame) -> DataFrame:
    """seed -> field -> fit maps to one row per (seed, field) that has parameters."""
    return (
        documents.select(F.explode("results_by_seed").alias("seed", "fields"))
        .select("seed", F.explode("fields").alias("field_name", "fit"))
        .filter(F.col("fit.params").isNotNull())
        .select(F.col("seed").cast("int").alias("seed"), "field_name", "fit.*")
    )


def read_results_json(spark: SparkSession, path: str, dataset: str, run_prefix: str) -> DataFrame:
    """Result rows of a nested JSON document; an empty document is an error."""
    documents = spark.read.schema(FORMULA_DOCUMENT).option("multiLine", True).json(path)
    rows = require_rows(flatten_document(documents), "the document holds no valid fit")
    run_id = F.concat(F.lit(run_prefix), F.col("seed").cast("string"))
    return result_rows(rows, run_id, F.lit(dataset))
