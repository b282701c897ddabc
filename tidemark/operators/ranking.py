"""Feature ranking as aggregates: chi-square of categories, rank correlation of numbers.

Rows are counted once per (feature, value, label); everything else follows from those
counts.  No task holds a class or a feature: average ranks come from running totals
over range runs, expected counts from the margins of the counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import dbl, finite_or_null
from tidemark.operators.ordered import running_totals
from tidemark.session import pin


def upper_gamma_share(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    # continued fraction, from the front (modified Lentz)
    b, tiny = x + 1.0 - a, 1e-300
    c, d = 1.0 / tiny, 1.0 / b
    out = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or tiny)
        c = (b + step / c) or tiny
        out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, front * out)


def chi_square_p(statistic: float, dof: int) -> float:
    """Chance of a larger chi-square value; no degree of freedom gives 1."""
    return upper_gamma_share(dof / 2, statistic / 2) if dof > 0 else 1.0


def value_counts(df: DataFrame, features: Sequence[str], label: str, kind: str) -> DataFrame:
    """(feature, value, label, n) of rows with a label; combines map-side."""
    cell = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value"))
    rows = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), F.inline(F.array(*[cell(c) for c in features])))
    if kind == "double":  # missing numbers count 0, as in model inputs
        rows = rows.withColumn("value", F.coalesce(finite_or_null(F.col("value")), dbl(0)) + dbl(0))
    return rows.groupBy("feature", "value", "label").agg(F.count("*").alias("n"))


def chi_square(df: DataFrame, categories: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, chisq, dof) of each category column against the label.

    A null is a value of its own.  Cells without a row add their expected count,
    which is what is left of the total, so they are never made.
    """
    counts = pin(value_counts(df, categories, label, "string"))
    labels = counts.groupBy("feature", "label").agg(F.sum("n").alias("_column"))
    totals = labels.groupBy("feature").agg(F.sum("_column").alias("_all"), F.count("*").alias("_labels"))
    row = F.sum("n").over(Window.partitionBy("feature", "value"))  # at most one row a label
    cells = counts.withColumn("_row", row).join(labels.join(totals, "feature"), ["feature", "label"])
    expected = F.col("_row").cast("double") * F.col("_column") / F.col("_all")
    seen = F.first("_all").cast("double")
    first_of_value = F.row_number().over(Window.partitionBy("feature", "value").orderBy("label")) == 1
    return (
        cells.withColumn("_e", expected)
        .withColumn("_first", first_of_value)
        .groupBy("feature")
        .agg(
            (F.sum((F.col("n") - F.col("_e")) * (F.col("n") - F.col("_e")) / F.col("_e")) + (seen - F.sum("_e"))).alias("chisq"),
            ((F.count_if("_first") - 1) * (F.first("_labels") - 1)).alias("dof"),
        )
    )


def _average_rank(before: Column, ties: Column, total: Column) -> Column:
    """Average rank of a value's ties, less the mean rank."""
    return before + (ties + dbl(1)) / dbl(2) - (total + dbl(1)) / dbl(2)


def spearman(df: DataFrame, numeric: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, spearman): correlation of average ranks; null for a constant column."""
    counts = pin(value_counts(df, numeric, label, "double"))
    by_label = counts.filter(F.col("feature") == numeric[0]).groupBy("label").agg(F.sum("n").alias("n"))
    ranks = running_totals(by_label, [], "label", ["n"])
    y = _average_rank(F.col("before_n"), F.col("n"), F.col("total_n"))
    labels = pin(ranks.select(F.col("label"), y.alias("_y")))
    weighted = counts.join(labels, "label").groupBy("feature", "value").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_y")).alias("_ny"), F.sum(F.col("n") * F.col("_y") * F.col("_y")).alias("_nyy"))
    placed = running_totals(weighted, ["feature"], "value", ["n"])
    x = _average_rank(F.col("before_n"), F.col("n"), F.col("total_n"))
    n = F.col("n")
    both = F.sqrt(F.sum(n * F.col("_x") * F.col("_x")) * F.sum("_nyy"))
    return placed.withColumn("_x", x).groupBy("feature").agg(
        (F.sum(F.col("_ny") * F.col("_x")) / F.nullif(both, dbl(0))).alias("spearman"))


def feature_ranking(
    df: DataFrame, numeric: Sequence[str], categories: Sequence[str], label: str = "label"
) -> DataFrame:
    """(feature, chisq, p_value, chisq_rank, spearman), one row a feature; an action.

    Categories of any number of values are ranked by chi-square, the largest first;
    numbers are correlated by rank.  Rows without a label are left out.
    """
    if not numeric and not categories:
        raise ValueError("no features given")
    rows, schema = [], "feature string, chisq double, p_value double, chisq_rank int, spearman double"
    if categories:
        found = {r.feature: r for r in chi_square(df, categories, label).collect()}  # one row a feature
        order = sorted(found.values(), key=lambda r: (-r.chisq, r.feature))
        rows += [(r.feature, r.chisq, chi_square_p(r.chisq, r.dof), i + 1, None) for i, r in enumerate(order)]
    out = df.sparkSession.createDataFrame(rows, schema)
    if numeric:
        none = F.lit(None).cast("double")
        out = out.unionByName(spearman(df, numeric, label).select(
            "feature", none.alias("chisq"), none.alias("p_value"), F.lit(None).cast("int").alias("chisq_rank"), "spearman"))
    return out
