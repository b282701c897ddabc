"""Input drift per field: population stability index and calibrated-range coverage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import (
    COVERAGE_ALERT,
    dbl,
    double_table,
    finite_or_null,
    is_finite,
    psi_level,
)
from tidemark.operators.ordered import exact_quantiles
from tidemark.sources.schemas import DRIFT_REFERENCE

INF = float("inf")
NAN = float("nan")
PSI_EPS = 1e-4

Ranges = Mapping[str, tuple[float, float]]


@dataclass(frozen=True)
class DriftReference:
    """Bin edges and expected shares per field, fitted on the training rows."""

    fields: list[str]
    edges: dict[str, list[float]]
    expected: dict[str, list[float]]
    n_ref: int = 0
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        out = []
        for f in self.fields:
            low, high = self.ranges.get(f, (None, None))
            out.append((f, self.edges[f], self.expected[f], self.n_ref, low, high))
        return out

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row per field."""
        return spark.createDataFrame(self.rows(), DRIFT_REFERENCE)

    @classmethod
    def from_table(cls, table: DataFrame, fields: Sequence[str] | None = None) -> DriftReference:
        rows = {r.field: r for r in table.collect()}  # one row per field
        names = list(fields or rows)
        return cls(
            names,
            {f: list(rows[f].edges) for f in names},
            {f: list(rows[f].expected) for f in names},
            int(next(iter(rows.values())).n_ref) if rows else 0,
            {f: (rows[f].cal_low, rows[f].cal_high) for f in names if rows[f].cal_low is not None},
        )

    def to_json(self) -> str:
        """JSON text; infinities are written as "inf" and "-inf"."""
        text = {INF: "inf", -INF: "-inf"}
        return json.dumps(
            {
                "field_names": self.fields,
                "edges": [[text.get(e, e) for e in self.edges[f]] for f in self.fields],
                "expected": [self.expected[f] for f in self.fields],
                "n_ref": self.n_ref,
                "calibrated_ranges": [list(self.ranges[f]) for f in self.fields if f in self.ranges],
            }
        )

    @classmethod
    def from_json(cls, text: str) -> DriftReference:
        d = json.loads(text)
        names = d["field_names"]
        return cls(
            names,
            {f: [float(e) for e in row] for f, row in zip(names, d["edges"], strict=True)},
            dict(zip(names, d["expected"], strict=True)),
            int(d.get("n_ref", 0)),
            {f: tuple(r) for f, r in zip(names, d.get("calibrated_ranges", []), strict=False)},
        )


def _histogram_columns(f: str, inner: Sequence[float]) -> dict[str, Column]:
    """Aggregates for one field: rows at or above each inner edge, and finite rows."""
    v = finite_or_null(F.col(f))
    out = {f"{f}__finite": F.count(v)}
    for k, edge in enumerate(inner):
        out[f"{f}__ge{k}"] = F.count_if(v >= dbl(edge))
    return out


def _bin_counts(f: str, n_inner: int) -> Column:
    """Bin counts as array: differences of the at-or-above counts."""
    steps = [F.col(f"{f}__finite"), *[F.col(f"{f}__ge{k}") for k in range(n_inner)], F.lit(0)]
    return F.array(*[(a - b).cast("double") for a, b in zip(steps, steps[1:], strict=False)])


def bin_counts(
    df: DataFrame, edges: Mapping[str, Sequence[float]], keys: Sequence[str] = ()
) -> DataFrame:
    """Histogram on given edges: (keys, field, n, counts).

    One pass and one small shuffle: every task sends one row per key, whatever
    the number of rows, fields or bins.  Bins are closed on the left, the last
    one on both sides; values outside the outer edges are not counted.
    """
    aggs: dict[str, Column] = {}
    rows = []
    for f, e in edges.items():
        inner = list(e)[1:-1]
        clipped = F.when((F.col(f) >= dbl(e[0])) & (F.col(f) <= dbl(e[-1])), F.col(f))
        v = finite_or_null(clipped)
        aggs[f"{f}__finite"] = F.count(v)
        for k, edge in enumerate(inner):
            aggs[f"{f}__ge{k}"] = F.count_if(v >= dbl(edge))
        rows.append(
            F.struct(F.lit(f).alias("field"), F.col("n"), _bin_counts(f, len(inner)).alias("counts"))
        )
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[c.alias(name) for name, c in aggs.items()]
    )
    return wide.select(*keys, F.inline(F.array(*rows)))


def shares(counts: Column) -> Column:
    """Counts to relative frequencies (all zero for an empty histogram)."""
    total = F.aggregate(counts, dbl(0), lambda acc, v: acc + v)
    return F.transform(counts, lambda v: v / F.greatest(total, dbl(1)))


def psi(expected: Column, actual: Column, eps: float = PSI_EPS) -> Column:
    """Population stability index of two share arrays over the same bins.

    Both sides are floored at ``eps`` and normalised again, so empty bins stay
    finite and the index is symmetric.
    """

    def settled(a: Column) -> Column:
        floored = F.transform(a, lambda v: F.greatest(v, dbl(eps)))
        total = F.aggregate(floored, dbl(0), lambda acc, v: acc + v)
        return F.transform(floored, lambda v: v / total)

    terms = F.zip_with(settled(expected), settled(actual), lambda e, a: (a - e) * F.log(a / e))
    return F.aggregate(terms, dbl(0), lambda acc, v: acc + v)


def fit_reference(
    df: DataFrame, fields: Sequence[str], n_bins: int = 10, ranges: Ranges | None = None, written: bool = False
) -> DriftReference:
    """Fit quantile bins on all training rows (two actions; the result is one row per field).

    Inner edges are the quantiles k / n_bins of the finite values, repeated
    edges collapse, and the outer edges are infinite.  ``written``: the rows are a
    table already and need no other copy.
    """
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"reference lacks columns {missing}")
    if ranges is not None and set(ranges) != set(fields):
        raise ValueError("calibrated ranges must name exactly the reference fields")
    probs = [k / n_bins for k in range(1, n_bins)]
    quantiles = {r.field: r.quantiles for r in exact_quantiles(df, fields, probs, written=written).collect()}
    edges = {f: [-INF, *sorted(set(quantiles.get(f, []))), INF] for f in fields}
    expected, n_ref = {}, 0
    for r in bin_counts(df, edges).select("field", "n", shares(F.col("counts")).alias("e")).collect():
        expected[r.field], n_ref = list(r.e), r.n
    return DriftReference(list(fields), edges, expected, n_ref, dict(ranges or {}))


def range_coverage(x: Column, low: float, high: float) -> Column:
    """Aggregate: share of rows inside [low, high]; null, NaN and infinities are outside."""
    inside = is_finite(x) & (x >= dbl(low)) & (x <= dbl(high))
    return F.coalesce(F.avg(F.when(inside, dbl(1)).otherwise(dbl(0))), dbl(NAN))


def drift_report(
    df: DataFrame,
    reference: DriftReference,
    keys: Sequence[str] = (),
    calibrated: Ranges | None = None,
) -> DataFrame:
    """One row per (keys, field) with PSI, its level, coverage and shares outside.

    A single aggregate over the rows; the reference is a handful of literals.
    Without a calibrated range coverage is NaN and raises no alert.
    """
    missing = [f for f in reference.fields if f not in df.columns]
    if missing:
        raise ValueError(f"batch lacks columns {missing}")
    ranges = dict(calibrated if calibrated is not None else reference.ranges)
    aggs: dict[str, Column] = {}
    rows = []
    for f in reference.fields:
        inner = reference.edges[f][1:-1]
        aggs.update(_histogram_columns(f, inner))
        counts = _bin_counts(f, len(inner))
        entry = [
            F.lit(f).alias("field"),
            F.col("n"),
            psi(double_table(reference.expected[f]), shares(counts)).alias("psi"),
        ]
        if f in ranges:
            low, high = ranges[f]
            x = F.col(f)
            aggs[f"{f}__inside"] = F.count_if(is_finite(x) & (x >= dbl(low)) & (x <= dbl(high)))
            aggs[f"{f}__below"] = F.count_if(~F.isnan(x) & (x < dbl(low)))
            aggs[f"{f}__above"] = F.count_if(~F.isnan(x) & (x > dbl(high)))

            def share(name: str, f: str = f) -> Column:
                return F.coalesce(F.try_divide(F.col(f"{f}__{name}").cast("double"), F.col("n")), dbl(NAN))

            entry += [
                share("inside").alias("coverage"),
                share("below").alias("share_below"),
                share("above").alias("share_above"),
                dbl(low).alias("cal_low"),
                dbl(high).alias("cal_high"),
            ]
        else:
            entry += [
                dbl(NAN).alias(c)
                for c in ("coverage", "share_below", "share_above", "cal_low", "cal_high")
            ]
        rows.append(F.struct(*entry))
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[c.alias(name) for name, c in aggs.items()]
    )
    coverage = F.col("coverage")
    return wide.select(*keys, F.inline(F.array(*rows))).select(
        *keys,
        "field",
        "n",
        "psi",
        psi_level(F.col("psi")).alias("psi_level"),
        "coverage",
        (~F.isnan(coverage) & (coverage < dbl(COVERAGE_ALERT))).alias("coverage_alert"),
        "share_below",
        "share_above",
        "cal_low",
        "cal_high",
    )


def summarize(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: worst field, lowest coverage and the fields in alert.

    A report has one row per field, so the lists are bounded by the field count.
    Fields are listed in alphabetical order.
    """
    cov = F.when(~F.isnan("coverage"), F.col("coverage"))

    def fields_where(condition: Column) -> Column:
        return F.sort_array(F.collect_set(F.when(condition, F.col("field"))))

    return report.groupBy(*keys).agg(
        F.count("*").alias("n_fields"),
        F.max("psi").alias("max_psi"),
        F.min(F.struct((-F.col("psi")).alias("p"), F.col("field")))["field"].alias("worst_psi_field"),
        F.coalesce(F.min(cov), dbl(NAN)).alias("min_coverage"),
        fields_where(F.col("psi_level") == "alert").alias("fields_psi_alert"),
        fields_where(F.col("psi_level") == "warning").alias("fields_psi_warning"),
        fields_where(F.col("coverage_alert")).alias("fields_coverage_alert"),
    )
