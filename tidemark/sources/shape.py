"""Shape gate on raw text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schemas import RAW_WIDTH


def line_shape(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row: number of lines, and the fewest and most cells in a line."""
    width = F.size(F.split(F.col(line), "\t"))
    return lines.agg(
        F.count("*").alias("n_rows"),
        F.min(width).cast("long").alias("min_cells"),
        F.max(width).cast("long").alias("max_cells"),
    )


def check_shape(spark: SparkSession, path: str, expected_rows: int, width: int = RAW_WIDTH) -> None:
    """Raise unless the file has the expected number of rows, all of the same width."""
    found = line_shape(spark.read.text(path)).first()
    problems = []
    if found.n_rows != expected_rows:
        problems.append(f"{found.n_rows} rows, expected {expected_rows}")
    if (found.min_cells, found.max_cells) != (width, width):
        problems.append(f"{found.min_cells}..{found.max_cells} columns, expected {width}")
    if problems:
        raise ValueError(f"{path}: " + "; ".join(problems))
