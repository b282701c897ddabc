"""Order-based operators that never sort a whole group in one task.

A running sum or a "previous row" normally needs one sorted window per group; one
hot group then lands on one task.  Here the rows are range-partitioned by group and
order first, which cuts any distribution into runs of like size: sorting happens
inside (group, run), and one small row per (group, run) is carried across.  There
are no more of those than runs plus groups.  Order statistics count coarse buckets
first and order only the few buckets that hold a wanted position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import dbl, finite_or_null
from tidemark.session import pin

COARSE = 10
_SPREAD = float(1 << 20)


def order_bucket(x: Column, bits: int = COARSE) -> Column:
    """Integer that never decreases as x grows, about 2**bits steps per factor e.

    Every step (abs, log1p, multiply, floor) is monotone in floating point, so
    x < y always gives bucket(x) <= bucket(y).
    """
    scaled = F.signum(x) * F.log1p(F.abs(x) * dbl(_SPREAD)) * dbl(float(1 << bits))
    return F.floor(scaled)


def in_runs(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``_run``, which never decreases along (keys, order); an action.

    The borders are sampled from the rows themselves, so values that lie close
    together are cut like any others.  Pinned, because another evaluation could
    sample other borders.
    """
    dealt = df.repartitionByRange(*keys, order)
    return pin(dealt.withColumn("_run", F.spark_partition_id()))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str]
) -> DataFrame:
    """Adds ``before_m`` (sum over smaller ``order``) and ``total_m`` for each measure.

    ``order`` is a finite number, unique within the keys: aggregate first, so
    that a hot value is a single row here.
    """
    keys = list(keys)
    cut = in_runs(df, keys, order)
    per_run = cut.groupBy(*keys, "_run").agg(*[F.sum(m).alias(f"_in_{m}") for m in measures])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select(
        *keys,
        "_run",
        *[F.coalesce(F.sum(f"_in_{m}").over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_in_{m}").over(group).alias(f"total_{m}") for m in measures],
    )
    local = (
        Window.partitionBy(*keys, "_run")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return cut.join(offsets, [*keys, "_run"]).select(
        *df.columns,
        *[
            (F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(local), F.lit(0))).alias(f"before_{m}")
            for m in measures
        ],
        *[F.col(f"total_{m}") for m in measures],
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]
) -> DataFrame:
    """Adds ``prev_c``: the value in the row before, by ``order`` within the keys.

    ``order`` is a finite number, unique within the keys.
    """
    keys = list(keys)
    row = F.struct(*columns)
    cut = in_runs(df, keys, order)
    last = cut.groupBy(*keys, "_run").agg(F.max_by(row, F.col(order)).alias("_last"))
    carried = last.select(
        *keys,
        "_run",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_run")).alias("_carried"),
    )
    local = Window.partitionBy(*keys, "_run").orderBy(order)
    return (
        cut.join(carried, [*keys, "_run"])
        .withColumn("_before", F.coalesce(F.lag(row).over(local), F.col("_carried")))
        .select(*df.columns, *[F.col("_before")[c].alias(f"prev_{c}") for c in columns])
    )


def unpivot(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, value) with finite values only."""
    values = F.inline(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    )
    return (
        df.select(*keys, values)
        .withColumn("value", finite_or_null(F.col("value")))
        .filter(F.col("value").isNotNull())
    )


def _position(total: Column, p: float) -> tuple[Column, Column, Column]:
    """Lower and upper row position of quantile p, and the fraction between them."""
    h = (total - F.lit(1)) * dbl(p)
    low = F.floor(h)
    high = F.least(low + F.lit(1), total - F.lit(1))
    return low, high, h - low


def exact_quantiles(
    df: DataFrame, fields: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), written: bool = False
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per (keys, field).

    Columns: ``n``, ``min_value``, ``max_value`` and ``quantiles`` (array in the
    order of ``probs``); only finite values count.

    The columns needed are pinned once, unless ``df`` is ``written`` already.  Pass 1 counts rows per coarse bucket (a
    few thousand rows per field).  The buckets holding a wanted position are few -
    at most two per quantile - and only their rows take part in pass 2, which
    orders them exactly; the list of buckets is written first, so that its size is
    known and no other rows are sent to meet it.  A value that repeats is one counted row before anything
    is ordered.
    """
    keys = list(keys)
    by = [*keys, "field"]
    narrow = df.select(*dict.fromkeys([*keys, *fields]))
    narrow = narrow if written else pin(narrow)
    long = unpivot(narrow, fields, keys).withColumn("coarse", order_bucket(F.col("value"), COARSE))
    histogram = long.groupBy(*by, "coarse").agg(
        F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.select(
        *by,
        "coarse",
        "rows",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("rows").over(group).alias("n"),
        F.min("low").over(group).alias("min_value"),
        F.max("high").over(group).alias("max_value"),
    )
    wanted = F.lit(False)
    for p in probs:
        low, high, _ = _position(F.col("n"), p)
        first, last = F.col("rows_before"), F.col("rows_before") + F.col("rows") - F.lit(1)
        wanted = wanted | ((low <= last) & (high >= first))
    needed = pin(placed.filter(wanted).drop("rows"))
    values = (
        long.join(needed, [*by, "coarse"])
        .groupBy(*by, "coarse", "value", "rows_before", "n", "min_value", "max_value")
        .agg(F.count("*").alias("copies"))
    )
    ranked = running_totals(values, [*by, "coarse"], "value", ["copies"]).withColumn(
        "start", F.col("rows_before") + F.col("before_copies")
    )
    # The value at a position is the greatest one starting at or before it.
    picks = []
    for i, p in enumerate(probs):
        low, high, _ = _position(F.col("n"), p)
        picks.append(F.max(F.when(F.col("start") <= low, F.col("value"))).alias(f"_low{i}"))
        picks.append(F.max(F.when(F.col("start") <= high, F.col("value"))).alias(f"_high{i}"))
    picked = ranked.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.first("min_value").alias("min_value"),
        F.first("max_value").alias("max_value"),
        *picks,
    )
    interpolated = []
    for i, p in enumerate(probs):
        _, _, fraction = _position(F.col("n"), p)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        interpolated.append(low + (high - low) * fraction)
    return picked.select(
        *by, "n", "min_value", "max_value", F.array(*interpolated).alias("quantiles")
    )


def global_row_number(
    df: DataFrame, group: str, order: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """Zero-based row number within ``group`` by ``order``, for groups of any size.

    The rows are range-sorted over all tasks and pinned, so each row keeps its
    position in its task's sorted run.  What crosses tasks is one count per
    (task, group), bounded by the number of tasks plus the number of groups.
    """
    ordered = df.orderBy(F.col(group), *order)
    pinned = pin(ordered.withColumn("_id", F.monotonically_increasing_id()))
    placed = pinned.withColumn("_run", F.shiftright("_id", 33))
    runs = placed.groupBy(group, "_run").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = (
        Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    )
    base = runs.select(
        group,
        "_run",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"),
    )
    return placed.join(base, [group, "_run"]).select(
        *df.columns, (F.col("_base") + F.col("_id") - F.col("_first")).alias(name)
    )
