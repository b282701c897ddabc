"""Streaming drain: replay, batch/stream parity, table upsert."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import sigmoid
from tidemark.operators import drift
from tidemark.operators.models import linear_logit
from tidemark.plans.ingest import fit_artifacts
from tidemark.session import scratch_path, shared_dir
from tidemark.sources.schemas import envelope_schema
from tidemark.sources.upsert import upsert_table
from tidemark.streaming.drain import BatchJob, Sinks, drain, parquet_stream, read_sink

NUM, CAT = ["I1", "I2"], ["C1"]


def test_drain_incremental_and_replay(spark):
    rows = spark.range(300).select(
        F.col("id").alias("timestamp"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.struct(F.col("id").cast("double").alias("I1"), (F.col("id") % 7).cast("double").alias("I2")).alias("numerical"),
        F.struct((F.col("id") % 4).cast("string").alias("C1")).alias("categorical"))
    flat = rows.select("label", "numerical.*", "categorical.*")
    art = fit_artifacts(flat, ["I1"], ["I2"], CAT)
    ref = drift.fit_reference(art.apply_numeric(flat), NUM)
    inbox, root = scratch_path(spark, "in"), scratch_path(spark, "out")
    job = BatchJob(art, lambda d: d.withColumn("p_click", sigmoid(linear_logit(0.0, {"I2": 0.5}))),
                   ref, "m@1", "test", Sinks(root))
    rows.filter("timestamp < 200").coalesce(1).write.parquet(inbox)
    stream = parquet_stream(spark, inbox, envelope_schema(NUM, CAT))
    drain(stream, job, f"{root}/a")
    assert read_sink(spark, job.sinks.predictions).count() == 200
    rows.filter("timestamp >= 200").coalesce(1).write.mode("append").parquet(inbox)
    drain(stream, job, f"{root}/a")  # only what is new
    metrics = read_sink(spark, job.sinks.metrics).orderBy("batch_id").collect()
    assert [m.impressions for m in metrics] == [200, 100]
    # a replayed batch replaces itself
    again = rows.filter("timestamp >= 200").select("timestamp", "label", "numerical.*", "categorical.*")
    job.run(again, 1)
    assert read_sink(spark, job.sinks.predictions).count() == 300
    assert read_sink(spark, job.sinks.metrics).count() == 2
    # what a batch pinned is gone once its sinks are written
    pinned = sorted(os.listdir(path := shared_dir(spark).removeprefix("file:")))
    job.run(again, 2)
    assert sorted(os.listdir(path)) == pinned
    with pytest.raises(ValueError):
        drain(stream, job, f"{root}/b", layout="xml")


def test_upsert_table(spark):
    key, table = ["k"], "upserted_results"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert upsert_table(spark, table, first.limit(0), key) == 0
    assert upsert_table(spark, table, first, key) == 2
    assert upsert_table(spark, table, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), key) == 2
    assert {r.k: r.v for r in spark.read.table(table).collect()} == {1: "a", 2: "c", 3: "d"}
    spark.sql(f"DROP TABLE {table}")
