"""Upsert of formula results by natural key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import pin
from tidemark.sources.schemas import NATURAL_KEY
from tidemark.sources.versioned import VersionedTable, WriteConflict


def latest_per_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` value; null comes before all.

    Ties go to the greatest other values.  The maximum merges map-side, so a key
    repeated many times stays cheap.
    """
    rest = [c for c in df.columns if c not in key]
    place = F.struct(F.col(order).isNotNull(), F.col(order), *[F.col(c) for c in rest if c != order])
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), place).alias("_row"))
        .select(*key, *[F.col("_row")[c].alias(c) for c in rest])
    )


def _one_per_key(new: DataFrame, key: Sequence[str], order: str | None) -> DataFrame:
    rest = [c for c in new.columns if c not in key]
    return latest_per_key(new, key, order or rest[0]) if rest else new.distinct()


def upsert(
    existing: DataFrame,
    new: DataFrame,
    key: Sequence[str] = NATURAL_KEY,
    order: str | None = None,
    mark: str | None = None,
) -> DataFrame:
    """Existing rows updated by ``new`` where the key matches, the rest inserted.

    A null in ``new`` means "not given" and leaves the stored value alone.
    Columns present on one side only are kept.  Rows of ``new`` that share a
    key are reduced to the last one by ``order`` first; without ``order`` to the
    one with the greatest values.  ``mark`` names a column that says what became of
    a row: ``inserted``, ``changed`` or ``kept``.
    """
    fresh = _one_per_key(new, key, order).withColumn("_given", F.lit(True)).alias("new")
    old = existing.withColumn("_stored", F.lit(True)).alias("old")
    columns = existing.columns + [c for c in new.columns if c not in existing.columns]
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key]

    def merged(c: str) -> Column:
        sides = [F.col(f"{side}.{c}") for side, df in (("new", new), ("old", existing)) if c in df.columns]
        return F.coalesce(*sides)

    out = [merged(c).alias(c) for c in columns]
    if mark is not None:
        differs = F.lit(False)
        for c in new.columns:
            before = F.col(f"old.{c}") if c in existing.columns else F.lit(None)
            differs = differs | ~merged(c).eqNullSafe(before)
        became = F.when(F.col("_stored").isNull(), "inserted").when(F.col("_given") & differs, "changed").otherwise("kept")
        out.append(became.alias(mark))
    return old.join(fresh, on, "full_outer").select(*out)


def versions_of(spark: SparkSession, table: str) -> VersionedTable:
    """The versioned folders behind a table name, below the warehouse."""
    return VersionedTable(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}__versions")


def _point_at(spark: SparkSession, table: str, folder: str) -> None:
    """Let a table name stand for a folder; one catalog change moves it from version to version."""
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, path=folder, source="parquet")
        return
    have = set(spark.read.table(table).columns)
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema if f.name not in have]
    if more:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(more)})")
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}'")


def upsert_table(
    spark: SparkSession,
    table: str,
    new: DataFrame,
    key: Sequence[str] = NATURAL_KEY,
    order: str | None = None,
    attempts: int = 5,
) -> int:
    """Upsert into a table; returns how many keys were inserted or changed.

    The table's location is the folder of its latest version.  The merged rows are
    written whole before they become a version, so readers never miss the table and a
    failed write leaves the old one.  If another writer commits first, the merge is
    made again from that writer's version, so neither's rows are lost.  The counts are
    observed while the rows are written.
    """
    store = versions_of(spark, table)
    fresh = pin(_one_per_key(new, key, order))  # read once, whatever it takes to make
    if fresh.isEmpty():
        return 0
    for attempt in range(attempts):
        base = store.version()
        existing = store.read(base) if base else fresh.limit(0)
        counts = Observation()
        merged = upsert(existing, fresh, key, order, mark="_became").observe(
            counts,
            F.count_if(F.col("_became") == "inserted").alias("n_inserted"),
            F.count_if(F.col("_became") == "changed").alias("n_changed"),
        )
        staged = store.stage(merged.drop("_became"))
        try:
            store.commit(staged, base)
        except WriteConflict:
            if attempt + 1 == attempts:
                raise
            continue
        _point_at(spark, table, store.folder())
        return counts.get["n_inserted"] + counts.get["n_changed"]
    return 0
