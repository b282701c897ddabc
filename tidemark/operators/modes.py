"""Most frequent value, first seen on ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_first_seen(
    df: DataFrame, keys: Sequence[str], value: str, position: str
) -> DataFrame:
    """(keys, mode, mode_count, n): the most frequent value per key.

    Ties go to the value whose first ``position`` is lowest (the built-in
    ``mode`` promises no such order).  Two aggregates; counts combine map-side.
    """
    counted = df.groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(position).alias("_first")
    )
    best = F.max(F.struct(F.col("_n"), (-F.col("_first")).alias("_late"), F.col(value).alias("_v")))
    return counted.groupBy(*keys).agg(best.alias("_best"), F.sum("_n").alias("n")).select(
        *keys, F.col("_best._v").alias("mode"), F.col("_best._n").alias("mode_count"), "n"
    )


def mode_state(value: Column, names: Sequence[str], position: Column) -> list[Column]:
    """Aggregates that count a known set of values inside a larger aggregate."""
    out = []
    for name in names:
        hit = value == F.lit(name)
        out.append(F.count_if(hit).alias(f"_n_{name}"))
        out.append(F.min(F.when(hit, position)).alias(f"_first_{name}"))
    return out


def mode_of_state(names: Sequence[str]) -> Column:
    """Struct (n, late, name) of the winner, from columns made by :func:`mode_state`."""
    entries = [
        F.struct(
            F.col(f"_n_{name}").alias("n"),
            (-F.col(f"_first_{name}")).alias("late"),
            F.lit(name).alias("name"),
        )
        for name in names
    ]
    return F.array_max(F.filter(F.array(*entries), lambda e: e["n"] > 0))


def with_single_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row."""
    one = F.broadcast(single.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")
