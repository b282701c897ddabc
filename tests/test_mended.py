"""Answers that once were wrong: null order, broken scores, NaN inputs, empty columns, quotes."""

import math

from pyspark.sql import functions as F

from tidemark.functions.scalars import winsorise
from tidemark.operators import metrics, normalise, sampling
from tidemark.plans.ingest import distinct_values
from tidemark.sources.tables import read_delimited
from tidemark.sources.upsert import latest_per_key, upsert

NAN = float("nan")


def test_latest_row_with_null_order_and_ties(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("b", 2, 5), ("c", 1, 7), ("c", 3, 7)], "k string, v int, o int")
    got = {r.k: (r.v, r.o) for r in latest_per_key(df, ["k"], "o").collect()}
    assert got == {"a": (1, None), "b": (2, 5), "c": (3, 7)}


def test_upsert_without_order_leaves_one_row_per_key(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [("a", 2), ("b", 4)]


def test_broken_scores_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.5), (0, NAN), (1, float("inf")), (0, None)], "label int, p_click double")
    row = metrics.batch_metrics(df).first()
    assert row.logloss == math.log(2) and row.ctr_predicted == 0.5 and row.impressions == 4


def test_winsorise_keeps_nan(spark):
    df = spark.createDataFrame([(NAN,), (99.0,), (-99.0,), (None,)], "x double")
    got = [r[0] for r in df.select(winsorise(F.col("x"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [10.0, -10.0, None]


def test_scaler_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "x double, y double")
    stats = normalise.fit_scaler(df, ["x", "y"])
    assert stats["x"] == {"mean": 0.0, "std": 1.0}
    assert normalise.apply_scaler(df, stats, ["x", "y"]).count() == 2


def test_quotes_are_ordinary_characters(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('1\t2\t"a\tb\nabc\t3\n')
    rows = read_delimited(spark, str(tmp_path), "l int, n int, c string, d string").collect()
    assert [tuple(r) for r in rows] == [(1, 2, '"a', "b"), (None, 3, None, None)]


def test_no_value_is_dropped_and_samples_are_exact(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("v"))
    assert distinct_values(df, "v").count() == 20_000
    assert sampling.random_sample(df, 15_000, seed=2).distinct().count() == 15_000
    assert sampling.random_sample(df, 30_000, seed=2).count() == 20_000
    assert 8_000 < sampling.fraction_sample(df, 0.5, seed=2).count() < 12_000


def test_curve_export_holds_all_fields(spark, sf_dir):
    from tidemark.plans import fixtures as fx
    from tidemark.plans.catalog import CATALOG

    rows = CATALOG["curve_export"].run(spark, sf_dir).groupBy("field_name").count().collect()
    assert {r.field_name: r["count"] for r in rows} == {f: 2 * 2 * 60 for f in fx.DRIFT_FIELDS}
