"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.sampling import random_sample
from tidemark.sources.schemas import raw_schema


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated impressions without header; bad or missing cells read as null."""
    return (
        spark.read.schema(schema or raw_schema())
        .option("sep", "\t")
        .option("quote", "")  # hashes may hold quotes
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and inferred types, for small result files."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def register_csv(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """Load a CSV into a table; a file that cannot be read is skipped (None)."""
    try:
        overwrite_table(read_csv(spark, path), table)
    except PySparkException:
        return None
    return spark.read.table(table)


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.table(name)
    return df.select(*columns) if columns else df


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, merge_schema: bool = False
) -> DataFrame:
    """Parquet with the projection pushed into the scan."""
    df = spark.read.option("mergeSchema", merge_schema).parquet(path)
    return df.select(*columns) if columns else df


def overwrite_table(
    df: DataFrame, table: str, partition_by: Sequence[str] = (), path: str | None = None
) -> None:
    """Replace a table together with its schema; ``path`` keeps its files outside the warehouse."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def overwrite_path(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_path(df: DataFrame, path: str) -> None:
    """Append; read back with ``merge_schema=True`` when columns were added."""
    df.write.mode("append").parquet(path)


def append_stamped(df: DataFrame, path: str, time_column: str = "timestamp") -> None:
    """Append results or alerts, stamped with the time of writing."""
    append_path(df.withColumn(time_column, F.current_timestamp()), path)


def overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch as its own partition: a replay replaces it, never doubles it."""
    df.drop("batch_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def export_samples(
    splits: dict[str, DataFrame], sizes: dict[str, int], path: str, seed: int = 42, keys: Sequence[str] = ()
) -> dict[str, str]:
    """One sampled parquet folder per split, written by the executors; with ``keys`` always the same rows."""
    written = {}
    for name, df in splits.items():
        target = f"{path.rstrip('/')}/{name}_sample.parquet"
        overwrite_path(random_sample(df, sizes[name], seed, keys), target)
        written[name] = target
    return written


def set_where(df: DataFrame, column: str, value: Column, predicate: Column) -> DataFrame:
    """Bulk update: ``column`` becomes ``value`` where the predicate holds."""
    if column in df.columns:
        old = F.col(column)
    else:
        old = F.lit(None)
    return df.withColumn(column, F.when(predicate, value).otherwise(old))
