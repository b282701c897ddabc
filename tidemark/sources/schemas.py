"""Declared schemas of the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# The column layout of a raw impression (label, 13 numbers, 26 categories).
LOG_COLUMNS = [f"I{i}" for i in range(1, 6)]
STD_COLUMNS = [f"I{i}" for i in range(6, 14)]
NUMERIC_COLUMNS = LOG_COLUMNS + STD_COLUMNS
CATEGORY_COLUMNS = [f"C{i}" for i in range(1, 27)]
RAW_WIDTH = 1 + len(NUMERIC_COLUMNS) + len(CATEGORY_COLUMNS)
UNKNOWN_CATEGORY = "<UNK>"


def raw_schema(
    numeric: Sequence[str] = NUMERIC_COLUMNS, categories: Sequence[str] = CATEGORY_COLUMNS
) -> T.StructType:
    """Raw impression: all columns nullable, never inferred."""
    fields = [T.StructField("label", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in numeric]
    fields += [T.StructField(c, T.StringType()) for c in categories]
    return T.StructType(fields)


def envelope_schema(
    numeric: Sequence[str] = NUMERIC_COLUMNS, categories: Sequence[str] = CATEGORY_COLUMNS
) -> T.StructType:
    """Stream message: epoch milliseconds, label, two nested structs."""
    return T.StructType(
        [
            T.StructField("timestamp", T.LongType()),
            T.StructField("label", T.IntegerType()),
            T.StructField("numerical", T.StructType([T.StructField(c, T.DoubleType()) for c in numeric])),
            T.StructField("categorical", T.StructType([T.StructField(c, T.StringType()) for c in categories])),
        ]
    )


INDEX_MAP = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("idx", T.LongType()),
    ]
)

DRIFT_REFERENCE = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("edges", T.ArrayType(T.DoubleType())),
        T.StructField("expected", T.ArrayType(T.DoubleType())),
        T.StructField("n_ref", T.LongType()),
        T.StructField("cal_low", T.DoubleType()),
        T.StructField("cal_high", T.DoubleType()),
    ]
)

ITEM_METADATA = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("price_usd", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("popularity_score", T.DoubleType()),
        T.StructField("days_since_listing", T.IntegerType()),
        T.StructField("avg_rating", T.DoubleType()),
    ]
)

_FIT = T.StructType(
    [
        T.StructField("operator", T.StringType()),
        T.StructField("params", T.ArrayType(T.DoubleType())),
        T.StructField("formula", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("r2_mean", T.DoubleType()),
        T.StructField("r2_std", T.DoubleType()),
        T.StructField("r2_min", T.DoubleType()),
        T.StructField("operator_agreement", T.DoubleType()),
        T.StructField("n_dims_fitted", T.LongType()),
    ]
)

# Nested results document: seed -> field -> fit.
FORMULA_DOCUMENT = T.StructType(
    [
        T.StructField(
            "results_by_seed",
            T.MapType(T.StringType(), T.MapType(T.StringType(), _FIT)),
        )
    ]
)

# The natural key of a formula result, and the encoder tag rows get by default.
NATURAL_KEY = ("run_id", "dataset", "seed", "field_name")
DEFAULT_ENCODER = "spline"
