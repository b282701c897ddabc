"""What stays on disk while a query runs: exchanges behind written tables, tables no longer read."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.plans import catalog_models, catalog_monitoring
from tidemark.session import _CLEANUP, exchanges_removed, pin, scratch_path, shared_dir


def _exchanged(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
    return {f for f in files.split("|") if f.endswith(".data") and "shuffle_" in f}


def test_a_written_table_leaves_no_exchange(spark):
    was, before = spark.conf.get(_CLEANUP), _exchanged(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    assert len(pin(rows).collect()) == len(pin(rows).collect()) == 7  # read without an exchange
    for _ in range(50):  # executors are told, not waited for
        if not (left := _exchanged(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(_CLEANUP) == was


def test_the_setting_comes_back(spark):
    was = spark.conf.get(_CLEANUP)
    with pytest.raises(ZeroDivisionError), exchanges_removed(spark):
        with exchanges_removed(spark):
            pass
        assert spark.conf.get(_CLEANUP) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(_CLEANUP) == was


def test_manifest_joins_its_tables_once(spark, sf_dir, monkeypatch):
    seen = {}
    check = catalog_monitoring.guards.check_manifest

    def spy(stored, again, numeric):
        seen["plans"] = [df._jdf.queryExecution().toString() for df in (stored, again["impressions"])]
        return check(stored, again, numeric)

    monkeypatch.setattr(catalog_monitoring.guards, "check_manifest", spy)
    rows = {r.artifact: r.n_rows for r in catalog_monitoring.artifact_manifest(spark, sf_dir).collect()}
    assert rows["impressions"] == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert not any("Join" in p for p in seen["plans"])


def _staged(spark) -> set[str]:
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_splits_leave_no_joined_rows(spark, sf_dir):
    before = _staged(spark)
    parts, sizes = catalog_models._splits(spark, sf_dir)
    assert [f.split("-")[0] for f in _staged(spark) - before] == ["splits"]
    assert all(parts[s].count() for s in parts) and set(sizes) == set(catalog_models.INDICES)


def test_a_comparison_leaves_its_log(spark):
    rows = pin(spark.range(2000).select(
        (F.col("id") % 50 / 10.0).alias("x"), (F.col("id") % 3).cast("int").alias("k"), (F.col("id") % 7 % 2).cast("int").alias("label")))
    spec = models.ModelSpec(["x"], ["k"], "bucket", n_buckets=4, max_iter=3)
    before, log = _staged(spark), scratch_path(spark, "log")
    out = models.compare_models(rows, rows, rows, [spec], [1], log).collect()
    assert len(out) == 1 and out[0].val_auc == out[0].test_auc
    assert [f.split("-")[0] for f in _staged(spark) - before] == ["log"]


@pytest.mark.parametrize("kind", models.ENCODERS)
def test_features_are_made_in_one_step(spark, kind):
    rows = spark.range(300).select((F.col("id") * 37 % 100 / 10.0 - 5).alias("x"), (F.col("id") % 11 * 1.0).alias("y"), (F.col("id") % 9 - 1).cast("int").alias("k"))
    encoder = models.numeric_encoder(kind, pin(rows), ["x", "y"], grid_size=5, n_buckets=4)
    for r in models.FeatureEncoder(encoder, ["k"], [7]).transform(encoder.transform(rows)).collect():
        want = [*r.num_vec.toArray(), *[float(i == min(max(r.k, 0), 6)) for i in range(7)]]
        assert list(r.features.toArray()) == want and (r.features.values != 0).all()
