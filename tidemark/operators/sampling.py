"""Sampling and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import pin

_SLOTS = 1 << 16


def key_uniform(keys: Sequence[str], seed: int) -> Column:
    """Number in [0, 1) made of the seed and a row's keys: the same in every run and engine.

    Keys should be whole numbers or text, whose text form is the same everywhere.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def random_sample(df: DataFrame, n_rows: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """``n_rows`` random rows, or all rows if there are no more.

    The rows with the smallest numbers stay: numbers made of ``keys``, so that the same
    rows come out of any run, or else random ones, which are pinned (an action).  No
    file or partition is favoured, and the class rate is the table's own.
    """
    drawn = df.withColumn("_u", key_uniform(keys, seed)) if keys else pin(df.withColumn("_u", F.rand(seed)))
    slotted = drawn.withColumn("_slot", F.floor(F.col("_u") * F.lit(float(_SLOTS))))
    slots = slotted.groupBy("_slot").agg(F.count("*").alias("_rows"))
    upto = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # at most 65,536 slot counts: small enough for one task and for a broadcast
    room = slots.select(
        "_slot", F.lit(n_rows) - F.coalesce(F.sum("_rows").over(upto), F.lit(0)), "_rows"
    ).toDF("_slot", "_room", "_rows")
    # the rows drawn and one slot more: written once for both parts
    kept = pin(slotted.join(F.broadcast(room.filter(F.col("_room") > 0)), "_slot"))
    whole = kept.filter(F.col("_rows") <= F.col("_room"))
    # the one slot that is cut: 1/65,536 of the drawn rows
    order = Window.partitionBy("_slot").orderBy("_u", F.xxhash64(*df.columns))
    cut = (
        kept.filter(F.col("_rows") > F.col("_room"))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= F.col("_room"))
    )
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def fraction_sample(df: DataFrame, fraction: float, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Bernoulli sample: every row stays with the same chance; with ``keys`` always the same rows."""
    if keys:
        return df.filter(key_uniform(keys, seed) < F.lit(float(fraction)))
    return df.sample(False, fraction, seed)


def random_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42):
    """Random train/val/test split."""
    return df.randomSplit(list(weights), seed)


def split_label(
    bucket: Column, shares: Sequence[tuple[str, int]] = (("train", 8), ("val", 1), ("test", 1))
) -> Column:
    """Name of the split a bucket number (modulo the sum of the shares) falls in."""
    total = sum(share for _, share in shares)
    place = F.pmod(bucket, F.lit(total))
    upto, out = 0, None
    for name, share in shares:
        upto += share
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return out


def split_by_key(
    df: DataFrame,
    key: str,
    shares: Sequence[tuple[str, int]] = (("train", 8), ("val", 1), ("test", 1)),
    name: str = "split",
    hashed: bool = True,
) -> DataFrame:
    """Split by a key: stable under re-partitioning, and a key never straddles splits."""
    bucket = F.xxhash64(F.col(key)) if hashed else F.col(key)
    return df.withColumn(name, split_label(bucket, shares))
