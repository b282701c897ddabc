"""Fail-fast checks and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MAX_NORMALISED_STD = 5.0


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The frame itself, or an error if it is empty."""
    if df.isEmpty():
        raise RuntimeError(message)
    return df


def deviations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the sample deviation of every column."""
    return df.agg(*[F.stddev_samp(c).alias(c) for c in columns])


def assert_normalised(
    df: DataFrame, columns: Sequence[str], limit: float = MAX_NORMALISED_STD
) -> None:
    """Raise if any column's deviation shows that it was never standardised.

    Pass the re-read table, not the frame that was written.
    """
    found = deviations(df, columns).first()
    bad = [c for c in columns if found[c] is not None and found[c] > limit]
    if bad:
        raise RuntimeError(f"not normalised (deviation above {limit}): {', '.join(bad)}")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row identifying a table's content regardless of row order and layout.

    A single aggregate with constant-size state: row count, the sum and the
    xor of the row hashes.
    """
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"),
        F.lit(",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))).alias("schema"),
    )


def manifest(
    spark: SparkSession,
    artifacts: dict[str, DataFrame],
    numeric: Sequence[str],
    categories: Sequence[str],
    cardinalities: dict[str, int] | None = None,
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """Manifest table: one row per artifact, with the model's column order."""
    rows = None
    for name, df in artifacts.items():
        row = fingerprint(df).withColumn("artifact", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        raise ValueError("a manifest needs at least one artifact")
    pairs = [F.lit(p) for kv in (extra or {}).items() for p in kv]
    sizes = [F.lit(p) for kv in (cardinalities or {}).items() for p in kv]
    return rows.select(
        "artifact",
        "n_rows",
        "hash_sum",
        "hash_xor",
        "schema",
        F.array(*[F.lit(c) for c in numeric]).cast("array<string>").alias("numeric_columns"),
        F.array(*[F.lit(c) for c in categories]).cast("array<string>").alias("category_columns"),
        F.create_map(*sizes).cast("map<string,long>").alias("cardinalities"),
        F.create_map(*pairs).cast("map<string,string>").alias("extra"),
    )


def model_tag(name: str, row: Row) -> str:
    """Short tag ``name@hash`` of a fingerprinted model artifact."""
    digest = f"{int(row.hash_sum) & (2**64 - 1):016x}{row.hash_xor & (2**64 - 1):016x}"
    return f"{name}@{digest[:12]}"


def check_manifest(
    stored: DataFrame,
    artifacts: dict[str, DataFrame],
    numeric: Sequence[str] | None = None,
) -> list[Row]:
    """Compare artifacts with a stored manifest; one error lists every mismatch."""
    rows = {r.artifact: r for r in stored.collect()}  # one row per artifact
    problems = []
    for name, df in artifacts.items():
        if name not in rows:
            problems.append(f"{name}: not in the manifest")
            continue
        now, then = fingerprint(df).first(), rows[name]
        if (now.n_rows, now.hash_sum, now.hash_xor, now.schema) != (
            then.n_rows,
            then.hash_sum,
            then.hash_xor,
            then.schema,
        ):
            problems.append(f"{name}: content differs from the manifest")
    if numeric is not None:
        if any(list(r.numeric_columns) != list(numeric) for r in rows.values()):
            problems.append("numeric columns differ in name or order")
    if problems:
        raise RuntimeError("manifest mismatch: " + "; ".join(problems))
    return list(rows.values())
