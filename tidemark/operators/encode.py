"""Categorical encoding by descending training frequency."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import global_row_number
from tidemark.session import pin, scratch_path


@dataclass(frozen=True)
class IndexMaps:
    """Long table (column, value, idx) and the number of ranks per column."""

    table: DataFrame
    sizes: dict[str, int]

    def slice(self, column: str) -> DataFrame:
        return self.table.filter(F.col("column") == column).select(
            F.col("value").alias(column), F.col("idx").alias(f"{column}_idx")
        )


def category_counts(df: DataFrame, columns: Sequence[str], null_rank: bool = True) -> DataFrame:
    """(column, value, count) of all columns in one pass; combines map-side."""
    pairs = F.inline(
        F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
        )
    )
    long = df.select(pairs)
    if not null_rank:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def rank_categories(counts: DataFrame) -> DataFrame:
    """(column, value, idx): by count descending, then value ascending, null first.

    Uses a global sort with per-task offsets, because one column alone may
    hold most of the distinct values.
    """
    order = [F.col("count").desc(), F.col("value").asc_nulls_first()]
    return global_row_number(counts, "column", order, "idx").select("column", "value", "idx")


def map_sizes(table: DataFrame) -> DataFrame:
    """Ranks per column of an index map table."""
    return table.groupBy("column").agg(F.count("*").alias("n"))


def build_index_maps(
    df: DataFrame, columns: Sequence[str], null_rank: bool = True
) -> IndexMaps:
    """Fit the maps of all columns on the training rows (an action), written once by column.

    A null group takes a rank by default, although it never matches the join:
    nulls and unseen values both end at the column's size.
    """
    path = scratch_path(df.sparkSession, "index-maps")
    save_index_maps(IndexMaps(rank_categories(category_counts(df, columns, null_rank)), {}), path)
    return load_index_maps(df.sparkSession, path, columns)


def index_maps_from(table: DataFrame, columns: Sequence[str]) -> IndexMaps:
    """Maps over an existing table; reads one count per column to the driver."""
    found = {r["column"]: r["n"] for r in map_sizes(table).collect()}
    return IndexMaps(table, {c: int(found.get(c, 0)) for c in columns})


def save_index_maps(maps: IndexMaps, path: str) -> None:
    """Persist as one long table, partitioned so that one column reads one folder."""
    maps.table.write.mode("overwrite").partitionBy("column").parquet(path)


def load_index_maps(spark: SparkSession, path: str, columns: Sequence[str]) -> IndexMaps:
    table = spark.read.schema("value string, idx bigint, column string").parquet(path)
    return index_maps_from(table.select("column", "value", "idx"), columns)


def union_of_maps(maps: dict[str, DataFrame]) -> DataFrame:
    """Tagged union of per-column maps (value column named like the column)."""
    out = None
    for c, mapping in maps.items():
        tagged = mapping.select(
            F.lit(c).alias("column"), F.col(c).alias("value"), F.col(f"{c}_idx").alias("idx")
        )
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no maps to unite")
    return out


def _apply_one(df: DataFrame, maps: IndexMaps, column: str) -> DataFrame:
    """One left join, whatever the map's size: run-time statistics choose between a
    broadcast and a shuffle, and the adaptive skew join splits a hot value, be it in
    the map, unseen or null."""
    idx = f"{column}_idx"
    joined = df.join(maps.slice(column), column, "left")
    return joined.withColumn(idx, F.coalesce(F.col(idx), F.lit(maps.sizes[column])).cast("int"))


def apply_index_maps(
    df: DataFrame,
    maps: IndexMaps,
    columns: Sequence[str],
    chunk: int = 6,
    materialize: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Adds ``<c>_idx``; unseen values and nulls get the column's size.

    ``materialize(df, i)`` may cut the plan after each ``chunk`` columns, for
    example with :func:`materialize_to_table`.
    """
    source = df.columns
    for i in range(0, len(columns), chunk):
        for c in columns[i : i + chunk]:
            df = _apply_one(df, maps, c)
        if materialize is not None:
            df = materialize(df, i)
    return df.select(*source, *[f"{c}_idx" for c in columns])


def apply_index_maps_wide(
    df: DataFrame, maps: IndexMaps, columns: Sequence[str], row_id: str | None = None, at_once: int = 0
) -> DataFrame:
    """As :func:`apply_index_maps`, all columns in one pass.

    The cells that are not null become (row, position, value) and meet the long map in
    one join, so the number of shuffles does not grow with the columns: cells by value,
    then indices and rows by row.  Indices are gathered per row before the second one;
    the adaptive skew join splits a hot value, and nulls and unseen values never get
    that far.  ``row_id`` names a column of unique whole numbers; without one the rows are
    pinned under generated ids.

    The smallest maps, up to ``at_once`` values together, are sent to every task instead:
    their cells are then neither written nor shuffled.
    """
    if at_once:
        sent, left = [], at_once
        for c in sorted(columns, key=lambda c: maps.sizes[c]):
            left -= maps.sizes[c]
            if left >= 0:
                sent.append(c)
        rest = [c for c in columns if c not in sent]
        out = apply_index_maps_wide(df, maps, rest, row_id) if rest else df
        for c in sent:  # the sizes are counted, so the hint stands on a proven bound
            out = _apply_one(out, IndexMaps(F.broadcast(maps.table), maps.sizes), c)
        return out.select(*df.columns, *[f"{c}_idx" for c in columns])
    rid = row_id or "_row"
    rows = df if row_id else pin(df.withColumn(rid, F.monotonically_increasing_id()))
    cells = F.array(
        *[F.struct(F.lit(i).alias("_at"), F.col(c).cast("string").alias("_value")) for i, c in enumerate(columns)]
    )
    pairs = rows.select(F.col(rid).alias("_id"), F.inline(F.filter(cells, lambda x: x["_value"].isNotNull())))
    names = F.array(*[F.lit(c) for c in columns])
    place = F.array_position(names, F.col("column")).cast("int") - 1
    long = maps.table.select(place.alias("_at"), F.col("value").alias("_value"), F.col("idx").cast("int").alias("_idx"))
    own = F.struct(*[F.col(c) for c in rows.columns])
    found = pairs.join(long.filter(F.col("_at") >= 0), ["_at", "_value"]).select(
        "_id", "_at", "_idx", F.lit(None).cast(rows.select(own.alias("s")).schema["s"].dataType).alias("_own")
    )
    bare = rows.select(
        F.col(rid).alias("_id"), F.lit(None).cast("int").alias("_at"), F.lit(None).cast("int").alias("_idx"), own.alias("_own")
    )
    picks = [F.max(F.when(F.col("_at") == i, F.col("_idx"))).alias(f"_i{i}") for i in range(len(columns))]
    joined = found.unionByName(bare).groupBy("_id").agg(F.first("_own", ignorenulls=True).alias("_own"), *picks)
    return joined.select(
        *[F.col("_own")[c].alias(c) for c in df.columns],
        *[F.coalesce(f"_i{i}", F.lit(maps.sizes[c])).cast("int").alias(f"{c}_idx") for i, c in enumerate(columns)],
    )


def materialize_to_table(df: DataFrame, i: int) -> DataFrame:
    """Cut the lineage with a table in the shared folder; outlives lost executors."""
    return pin(df)


def cardinalities(splits: Sequence[DataFrame], index_columns: Sequence[str]) -> DataFrame:
    """One row: largest index over all splits plus one, per column."""
    together = None
    for split in splits:
        part = split.select(*index_columns)
        together = part if together is None else together.unionByName(part)
    if together is None:
        raise ValueError("no splits given")
    return together.agg(*[(F.max(c).cast("long") + F.lit(1)).alias(c) for c in index_columns])


def index_overflow(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row: rows per column whose index is outside [0, limit)."""
    return df.agg(
        *[F.count_if((F.col(c) < 0) | (F.col(c) >= n)).alias(c) for c, n in limits.items()]
    )


def assert_index_range(df: DataFrame, limits: dict[str, int]) -> None:
    row = index_overflow(df, limits).first()
    bad = {c: row[c] for c in limits if row[c]}
    if bad:
        raise ValueError(f"indices out of range (column: rows): {bad}")


def clamp_report(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """One row: rows with at least one index that scoring would clamp."""
    outside = F.lit(False)
    for c, n in limits.items():
        outside = outside | (F.col(c) < 0) | (F.col(c) >= n)
    return df.agg(F.count("*").alias("n_rows"), F.count_if(outside).alias("n_clamped"))
