"""Incremental drain of impressions: normalise, score, store, measure, watch drift."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.drift import DriftReference, drift_report, summarize
from tidemark.operators.metrics import batch_metrics
from tidemark.operators.modes import with_single_row
from tidemark.plans.ingest import Artifacts
from tidemark.session import pin, scratch_scope
from tidemark.sources.envelope import decode_json, flatten
from tidemark.sources.tables import overwrite_batch

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Sinks:
    """Output folders below one root; each batch owns one partition of each."""

    root: str

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions"

    @property
    def processed(self) -> str:
        return f"{self.root}/processed"

    @property
    def metrics(self) -> str:
        return f"{self.root}/metrics"

    @property
    def drift(self) -> str:
        return f"{self.root}/drift"


@dataclass(frozen=True)
class BatchJob:
    """Everything one micro-batch needs; the same for every batch."""

    artifacts: Artifacts
    score: Scorer
    reference: DriftReference
    model: str
    source: str
    sinks: Sinks

    def run(self, flat: DataFrame, batch_id: int) -> None:
        """Process one flat micro-batch into the four sinks; a replay overwrites itself.

        Tables pinned on the way are removed once the sinks are written.
        """
        with scratch_scope(flat.sparkSession):
            self._run(flat, batch_id)

    def _run(self, flat: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        if flat.isEmpty():
            return
        a = self.artifacts
        columns = ["timestamp", "label", *a.numeric, *a.index_columns]
        scored = (
            self.score(a.apply(flat).select(*columns))
            .withColumns(
                {
                    "batch_id": F.lit(batch_id).cast("long"),
                    "model": F.lit(self.model),
                    "scored_at": F.current_timestamp(),
                }
            )
            .persist()
        )
        try:
            overwrite_batch(
                scored.select("timestamp", "label", "p_click", "batch_id", "model", "scored_at"),
                self.sinks.predictions,
                batch_id,
            )
            overwrite_batch(scored.select(*columns, "batch_id"), self.sinks.processed, batch_id)
            stamp = {"timestamp": F.current_timestamp(), "model": F.lit(self.model)}
            report = pin(drift_report(scored, self.reference).withColumns(stamp))  # a row per field
            overwrite_batch(report, self.sinks.drift, batch_id)
            digest = summarize(report).select(
                "max_psi",
                "worst_psi_field",
                "min_coverage",
                F.size("fields_psi_alert").cast("long").alias("n_fields_psi_alert"),
                F.size("fields_coverage_alert").cast("long").alias("n_fields_coverage_alert"),
            )
            metrics = with_single_row(batch_metrics(scored), digest).withColumns(
                {**stamp, "source": F.lit(self.source)}
            )
            row = pin(metrics)  # one row
            elapsed = F.lit(round(time.monotonic() - started, 2))
            overwrite_batch(row.withColumn("processing_seconds", elapsed), self.sinks.metrics, batch_id)
        finally:
            scored.unpersist()


def parquet_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of an append-only folder of parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Stream of JSON envelopes from Kafka; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .select("value")
    )


def drain(
    stream: DataFrame, job: BatchJob, checkpoint: str, layout: str = "envelope"
) -> StreamingQuery:
    """Process what arrived since the last run, then stop.

    Offsets live in ``checkpoint``; a new checkpoint folder replays everything.
    ``layout`` says how a row looks: nested ``envelope``, ``json`` text in
    column ``value``, or already ``flat``.
    """
    a = job.artifacts
    unpack = {
        "envelope": lambda df: flatten(df, a.numeric, a.categories),
        "json": lambda df: decode_json(df, "value", a.numeric, a.categories),
        "flat": lambda df: df,
    }
    if layout not in unpack:
        raise ValueError(f"unknown layout {layout!r}; expected one of {', '.join(unpack)}")

    def each(df: DataFrame, batch_id: int) -> None:
        job.run(unpack[layout](df), batch_id)

    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """A sink's batches as one table (``batch_id`` comes from the folder names)."""
    return spark.read.option("mergeSchema", True).parquet(path).withColumn(
        "batch_id", F.col("batch_id").cast("long")
    )


def describe_processed(spark: SparkSession, sinks: Sinks, columns: list[str]) -> DataFrame:
    """count, mean, stddev, min and max of the processed columns."""
    return read_sink(spark, sinks.processed).select(*columns).describe()
