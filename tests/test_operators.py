"""Edge cases of the operators on small analytic inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.formulas import OPERATORS, apply_operator, shape
from tidemark.functions.scalars import dbl
from tidemark.functions.splines import interval_polynomials
from tidemark.operators import ablation, drift, encode, extraction, guards, metrics, normalise, sampling
from tidemark.operators.ordered import exact_quantiles, in_runs, previous_row, running_totals
from tidemark.sources import envelope
from tidemark.sources.upsert import upsert

NAN = float("nan")
INF = float("inf")


def test_each_operator_recovers_itself(spark):
    x = (F.col("id") / dbl(50)) - dbl(2.9)
    parts = None
    for i, op in enumerate(OPERATORS):
        p = spark.range(300).select(
            F.lit(1).alias("seed"), F.lit(op).alias("field_name"), F.lit(i).alias("dim"), x.alias("x"),
            apply_operator(op, x, dbl(1.5), dbl(-0.25)).alias("phi"))
        parts = p if parts is None else parts.unionByName(p)
    for r in extraction.fit_curves(parts).collect():
        assert r.operator == r.field_name
        assert r.r2 > 0.999999
        assert r.param_a == pytest.approx(1.5, rel=1e-6) and r.param_b == pytest.approx(-0.25, rel=1e-4)


def test_flat_curve_has_no_fit(spark):
    flat = spark.range(20).selectExpr("1 seed", "'I1' field_name", "0 dim", "double(id) x", "3e0 phi")
    assert extraction.fit_curves(flat).isEmpty()
    row = extraction.monotonicity(flat).first()
    assert (row.direction, row.violation_rate, row.is_monotone) == ("flat", 0.0, True)


def test_operators_finite_at_extremes(spark):
    df = spark.createDataFrame([(v,) for v in (-800.0, -100.0, -3.0, 0.0, 3.0, 100.0, 800.0)], "x double")
    out = df.select(*[shape(op, F.col("x")).alias(op) for op in OPERATORS]).collect()
    assert all(math.isfinite(v) for r in out for v in r)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=2000), np.full(1500, 0.25), rng.exponential(1e4, 500)])
    rows = [(float(v),) for v in x] + [(None,), (NAN,), (INF,)]
    probs = [0.0, 0.1, 0.333, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "v double").repartition(7), ["v"], probs).first()
    assert got.n == len(x)
    assert np.allclose(got.quantiles, np.quantile(x, probs), rtol=1e-12)


def test_running_totals_and_previous_row(spark):
    rng = np.random.default_rng(5)
    v = sorted(set(np.round(rng.normal(size=500) * 1000, 3).tolist()))
    df = spark.createDataFrame([("k", x, i) for i, x in enumerate(v)], "k string, v double, m long").repartition(5)
    for r in running_totals(df, ["k"], "v", ["m"]).collect():
        assert r.before_m == sum(range(r.m))
    for r in previous_row(df, ["k"], "v", ["m"]).collect():
        assert r.prev_m == (r.m - 1 if r.m else None)


@pytest.mark.parametrize("start, step", [(1.7e9, 1.0), (1000.0, 1e-4)])
def test_no_run_holds_a_large_share_of_close_values(spark, start, step):
    """Seconds of one day, prices between 1000 and 1001."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 10_000
        df = spark.range(n).select((dbl(start) + F.col("id") * dbl(step)).alias("v"), F.lit(1).alias("m"))
        sizes = [r["count"] for r in in_runs(df, [], "v").groupBy("_run").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < n / 2
        wrong = running_totals(df, [], "v", ["m"]).filter(F.col("before_m") != F.round((F.col("v") - dbl(start)) / dbl(step)))
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.normal(size=400) + y * 0.5, 1)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, s double")
    assert metrics.auc(df, "label", "s").first().auc == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_nan(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7), (None, 0.1)], "label int, p_click double")
    row = metrics.batch_metrics(df).first()
    assert math.isnan(row.auc) and row.n_unlabelled == 1 and row.impressions == 2


def test_index_maps_nulls_unseen_and_both_paths(spark):
    rows = [("a",)] * 5 + [("b",)] * 3 + [("c",)] * 3 + [(None,)] * 4
    train = spark.createDataFrame(rows, "C1 string")
    maps = encode.build_index_maps(train, ["C1"])
    got = {r.value: r.idx for r in maps.table.collect()}
    assert got == {"a": 0, None: 1, "b": 2, "c": 3} and maps.sizes == {"C1": 4}
    new = spark.createDataFrame([("a",), ("c",), ("zz",), (None,)], "C1 string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            applied = encode.apply_index_maps(new, maps, ["C1"])
            assert {r.C1: r.C1_idx for r in applied.collect()} == {"a": 0, "c": 3, "zz": 4, None: 4}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    stats = normalise.fit_scaler(df, ["x"])
    assert stats == {"x": {"mean": 2.0, "std": 1.0}}
    assert normalise.apply_scaler(df, {"x": (1.0, 0.0)}, ["x"]).first().x == 1.0


def test_drift_quiet_shifted_and_broken_values(spark):
    rng = np.random.default_rng(11)
    ref = spark.createDataFrame([(float(v),) for v in rng.normal(size=5000)], "I1 double")
    fitted = drift.fit_reference(ref, ["I1"], ranges={"I1": (-3.0, 3.0)})
    assert sum(fitted.expected["I1"]) == pytest.approx(1) and fitted.n_ref == 5000
    assert drift.DriftReference.from_json(fitted.to_json()) == fitted
    quiet = spark.createDataFrame([(float(v),) for v in rng.normal(size=2000)], "I1 double")
    row = drift.drift_report(quiet, fitted).first()
    assert row.psi < 0.05 and row.psi_level == "ok" and not row.coverage_alert
    moved = quiet.select((F.col("I1") + 2).alias("I1"))
    row = drift.drift_report(moved, fitted).first()
    assert row.psi_level == "alert" and row.coverage_alert and row.share_above > 0.1
    broken = spark.createDataFrame([(NAN,), (INF,), (None,), (0.0,)], "I1 double")
    row = drift.drift_report(broken, fitted).first()
    assert row.n == 4 and row.coverage == 0.25 and row.share_above == 0.25


def test_drift_without_range_empty_and_wrong_columns(spark):
    ref = spark.range(100).select(F.col("id").cast("double").alias("I1"))
    fitted = drift.fit_reference(ref, ["I1"])
    row = drift.drift_report(ref, fitted).first()
    assert math.isnan(row.coverage) and not row.coverage_alert
    empty = drift.drift_report(ref.limit(0), fitted, calibrated={"I1": (0.0, 1.0)}).first()
    assert empty.n == 0 and math.isnan(empty.coverage)
    with pytest.raises(ValueError):
        drift.fit_reference(ref, ["I2"])
    with pytest.raises(ValueError):
        drift.drift_report(ref.select(F.col("I1").alias("x")), fitted)


def test_repeated_quantiles_collapse(spark):
    df = spark.range(100).select(F.when(F.col("id") < 60, 0.0).otherwise(F.col("id").cast("double")).alias("I1"))
    fitted = drift.fit_reference(df, ["I1"])
    assert len(set(fitted.edges["I1"])) == len(fitted.edges["I1"]) < 11


def test_random_sample_is_exact(spark):
    df = spark.range(5000).select(F.lit(1).alias("same"), F.lit("x").alias("also"))
    assert sampling.random_sample(df, 700, seed=1).count() == 700
    assert sampling.random_sample(df, 9999, seed=1).count() == 5000


def test_upsert_keeps_fields_not_given(spark):
    old = spark.createDataFrame([("r", 1, 0.5, 0.1), ("r", 2, 0.6, 0.2)], "run string, seed int, r2 double, gap double")
    new = spark.createDataFrame([("r", 2, 0.9), ("r", 3, 0.7)], "run string, seed int, r2 double")
    got = {r.seed: (r.r2, r.gap) for r in upsert(old, new, ["run", "seed"]).collect()}
    assert got == {1: (0.5, 0.1), 2: (0.9, 0.2), 3: (0.7, None)}


def test_envelope_keeps_trailing_empty_categories(spark):
    num, cat = ["I1", "I2"], ["C1", "C2"]
    lines = spark.createDataFrame([("1\t\t2.5\ta\t",), ("\tx\t1\t\tb",), ("1\t2\t3",)], "value string")
    coded = envelope.encode_lines(lines, F.lit(5), "value", num, cat)
    got = sorted(tuple(r) for r in envelope.decode_json(coded, "value", num, cat).collect())
    assert got == [(5, 0, 0.0, 1.0, "<UNK>", "b"), (5, 1, 0.0, 2.5, "a", "<UNK>")]


def test_spline_pieces_sum_to_one():
    pieces = interval_polynomials([-3, -2, -1, 0, 0.5, 2, 3, 4, 5], 3)
    for i in range(3, 5):
        assert np.allclose(pieces[i].sum(axis=0), [1, 0, 0, 0])


def test_guards(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    with pytest.raises(RuntimeError, match="not normalised"):
        guards.assert_normalised(df, ["x"])
    with pytest.raises(RuntimeError):
        guards.require_rows(df.limit(0), "empty")
    stored = guards.manifest(spark, {"t": df}, ["x"], ["c"])
    guards.check_manifest(stored, {"t": df.repartition(5)}, ["x"])
    with pytest.raises(RuntimeError, match="content differs.*differ in name"):
        guards.check_manifest(stored, {"t": df.withColumn("x", F.col("x") + 1)}, ["y"])


def test_ablation_needs_an_accepted_formula():
    with pytest.raises(ValueError):
        ablation.usable_formulas({"I1": ablation.Formula("log", 1, 0, accepted=False)}, ["I1"])
    got = ablation.usable_formulas({0: ablation.Formula("log", 1, 0), "zz": ablation.Formula("log", 1, 0)}, ["I1"])
    assert list(got) == ["I1"]


def test_ablation_drops_non_finite(spark):
    df = spark.createDataFrame([(1, 0.9, 0.8), (0, 0.2, 0.3), (1, 0.6, NAN)], "label int, p double, q double")
    row = ablation.ablation_report(df, "label", "p", "q").first()
    assert row.n_dropped == 1 and row.auc_substituted == 1.0 and row.delta_auc == 0.0
