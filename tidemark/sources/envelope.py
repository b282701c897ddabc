"""JSON envelope of streamed impressions: encode from text lines, decode to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import dbl
from tidemark.sources.schemas import (
    CATEGORY_COLUMNS,
    NUMERIC_COLUMNS,
    UNKNOWN_CATEGORY,
    envelope_schema,
)


def to_line(
    df: DataFrame,
    label: str = "label",
    numeric: Sequence[str] = NUMERIC_COLUMNS,
    categories: Sequence[str] = CATEGORY_COLUMNS,
) -> Column:
    """Tab-separated text of one impression; missing cells are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (label, *numeric, *categories)]
    return F.concat_ws("\t", *cells)


def encode_lines(
    lines: DataFrame,
    timestamp: Column,
    line: str = "value",
    numeric: Sequence[str] = NUMERIC_COLUMNS,
    categories: Sequence[str] = CATEGORY_COLUMNS,
) -> DataFrame:
    """Text lines to JSON envelopes in column ``value``.

    Empty number -> 0.0, empty category -> ``<UNK>``, empty label -> 0.  Lines
    with too few cells are not impressions and are left out; the line is never
    stripped, so trailing empty categories survive.
    """
    width = 1 + len(numeric) + len(categories)
    cells = F.col("_cells")

    def cell(i: int) -> Column:
        return F.nullif(F.get(cells, F.lit(i)), F.lit(""))

    numbers = [
        F.coalesce(cell(1 + j).try_cast("double"), dbl(0)).alias(c) for j, c in enumerate(numeric)
    ]
    names = [
        F.coalesce(cell(1 + len(numeric) + j), F.lit(UNKNOWN_CATEGORY)).alias(c)
        for j, c in enumerate(categories)
    ]
    message = F.struct(
        F.col("_at").alias("timestamp"),
        F.coalesce(cell(0).try_cast("int"), F.lit(0)).alias("label"),
        F.struct(*numbers).alias("numerical"),
        F.struct(*names).alias("categorical"),
    )
    # split once per line, in its own projection
    parts = lines.select(
        timestamp.cast("long").alias("_at"), F.split(F.col(line), "\t").alias("_cells")
    )
    return parts.filter(F.size(cells) >= width).select(F.to_json(message).alias("value"))


def flatten(
    envelopes: DataFrame,
    numeric: Sequence[str] = NUMERIC_COLUMNS,
    categories: Sequence[str] = CATEGORY_COLUMNS,
) -> DataFrame:
    """Nested envelope columns to flat impression columns."""
    return envelopes.select(
        "timestamp",
        F.col("label").cast("int").alias("label"),
        *[F.col(f"numerical.{c}").alias(c) for c in numeric],
        *[F.col(f"categorical.{c}").alias(c) for c in categories],
    )


def decode_json(
    messages: DataFrame,
    value: str = "value",
    numeric: Sequence[str] = NUMERIC_COLUMNS,
    categories: Sequence[str] = CATEGORY_COLUMNS,
) -> DataFrame:
    """JSON text (or Kafka bytes) to flat impression columns."""
    parsed = F.from_json(F.col(value).cast("string"), envelope_schema(numeric, categories))
    return flatten(messages.select(parsed.alias("m")).select("m.*"), numeric, categories)
