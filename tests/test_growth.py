"""Work that has to grow no faster than the input: passes over the joined tables, tasks, encodings."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import encode, models, ordered, sampling
from tidemark.plans import catalog_models, catalog_monitoring, catalog_tables
from tidemark.plans import fixtures as fx
from tidemark.session import pin, shared_dir


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_manifest_checks_a_layout_of_as_many_tasks_as_needed(spark, sf_dir, monkeypatch):
    seen = {}
    monkeypatch.setattr(catalog_monitoring.guards, "check_manifest", lambda stored, again, numeric: seen.update(again))
    catalog_monitoring.artifact_manifest(spark, sf_dir)
    assert "REPARTITION_BY_NUM" not in _plan(seen["impressions"])


def test_reports_and_samples_do_not_repeat_the_joins(spark, sf_dir):
    assert "Join" not in _plan(catalog_monitoring.drift_of(spark, sf_dir))
    assert "lineitem" not in _plan(catalog_models.encoded(spark, sf_dir))
    rows = spark.range(1000).join(spark.range(500), "id")
    sample = sampling.random_sample(rows, 20, 42, ["id"])
    assert "Join" not in _plan(sample) and sample.count() == 20


def test_small_maps_are_sent_and_large_ones_met(spark):
    rows = spark.range(3000).select(
        "id", *[F.concat(F.lit("v"), (F.col("id") * 7 % n).cast("string")).alias(c) for c, n in (("a", 5), ("b", 40), ("c", 900))])
    rows = rows.withColumn("b", F.when(F.col("id") % 6 != 0, F.col("b")))
    maps = encode.build_index_maps(rows.filter("id % 3 > 0"), ["c", "a", "b"])
    plain = encode.apply_index_maps(rows, maps, ["c", "a", "b"])
    for most in (50, 100_000):
        wide = encode.apply_index_maps_wide(rows, maps, ["c", "a", "b"], at_once=most)
        assert wide.columns == plain.columns
        assert wide.exceptAll(plain).count() == plain.exceptAll(wide).count() == 0
    assert "Exchange hashpartitioning" not in wide._jdf.queryExecution().executedPlan().toString()


def test_bucket_and_spline_rows(spark):
    df = spark.range(400).select((F.col("id") / 7.0 - 20.0).alias("x"), (F.col("id") % 9).cast("double").alias("y"))
    grids = [[-10.0, 0.0, 3.5], [1.0, 4.0]]
    slow = F.concat(*[models.soft_buckets(F.col(c), g, 2.0) for c, g in zip("xy", grids)])
    got = df.select(slow.alias("a"), models.bucket_features(grids, 2.0)("x", "y").alias("b")).collect()
    assert all(np.allclose(r.a, r.b, atol=1e-14) for r in got)
    knots = [float(k) for k in range(-4, 8)]
    basis = df.select(models.spline_features([knots], 3)("y").alias("b"), "y").collect()
    for r in basis:
        assert len(r.b) == len(knots) - 3 and r.b[0] == pytest.approx(r.y / (1 + np.exp(-r.y)))


def test_inbox_grows_with_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog_tables, "INBOX_ROWS", 500)
    monkeypatch.setattr(catalog_tables, "drain", lambda *a: None)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    catalog_tables.drained(spark, sf_dir)
    inbox = [f for f in os.listdir(folder) if f.startswith("inbox-") and f not in before]
    files = [f for f in os.listdir(f"{folder}/{inbox[0]}") if f.endswith(".parquet")]
    assert len(files) == -(-fx.impressions(spark, sf_dir).count() // 500)


def _sent(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_quantiles_send_wanted_buckets_alone(spark):
    values = (F.pmod(F.hash("id"), F.lit(1_000_003)) / 1_000_003 + 1).alias("x")
    rows = pin(spark.range(400_000).select(values, (F.col("id") % 2).alias("k")))
    before = _sent(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # the rows are no side to broadcast
    try:
        got = ordered.exact_quantiles(rows, ["x"], [0.5], ["k"], written=True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _sent(spark) - before < 800_000  # two bytes a row
    for r in got:
        xs = np.array([x for x, k in rows.collect() if k == r.k])
        assert r.quantiles[0] == np.quantile(xs, 0.5) and r.n == len(xs)


def test_drift_sends_lines_twice(spark, sf_dir):
    plain, first = (fx.impressions(spark, sf_dir, customers_first=x) for x in (False, True))
    assert plain.columns == first.columns
    assert plain.exceptAll(first).count() == first.exceptAll(plain).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = first.select("batch_id", *fx.DRIFT_FIELDS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [k for k in ("l_orderkey", "l_partkey", "o_custkey") if f"hashpartitioning({k}#" in plan]
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(keys) == 3 and len(joins) == 3 and "o_orderkey" in joins[0]  # customers meet orders, not lines
