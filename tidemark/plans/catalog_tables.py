"""Queries: sources, sinks, upserts and the streaming drain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import dbl, rounded, sigmoid
from tidemark.operators import drift
from tidemark.operators.models import linear_logit
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog_features import DRAWN_SQL, KEYS, KEYS_SQL, NORMED, PREPARED, SCALER, encoded_sql, maps_sql
from tidemark.plans.catalog_formulas import (
    CHAIN, RESULT_NUMBERS, RESULTS, SUMMARY, results_of, rounds,
)
from tidemark.plans.fixtures import (
    CATEGORIES, EXPERIMENTS, IMPRESSIONS, LOG, NUMERIC, STD, impressions, r6, with_ctes,
)
from tidemark.plans.ingest import fit_artifacts
from tidemark.plans.registry import query
from tidemark.session import pin, scratch_path
from tidemark.sources import envelope, shape, tables
from tidemark.sources.schemas import envelope_schema, raw_schema
from tidemark.sources.upsert import latest_per_key, upsert
from tidemark.streaming.drain import BatchJob, Sinks, drain, parquet_stream, read_sink


@query("S3 S4", """SELECT l_orderkey, l_quantity FROM lineitem WHERE l_discount > 0.08""")
def projected_scan(spark, sf_dir):
    """Two columns out, one filter pushed down."""
    scan = tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_discount"])
    return scan.filter(F.col("l_discount") > 0.08).drop("l_discount")


FLAT_SQL = ", ".join(["label", *NUMERIC, *CATEGORIES])


@query("S1 S7", with_ctes(IMPRESSIONS) + f"SELECT {FLAT_SQL} FROM impressions")
def delimited_read(spark, sf_dir):
    """Impressions written as tab-separated lines and read with the declared schema."""
    df = impressions(spark, sf_dir)
    lines = df.select(envelope.to_line(df, "label", NUMERIC, CATEGORIES))
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    return tables.read_delimited(spark, path, raw_schema(NUMERIC, CATEGORIES))


@query("S2", with_ctes(EXPERIMENTS) + f"SELECT encoder, seed, dataset, {r6('test_auc')} AS test_auc, epochs FROM experiments")
def csv_with_header(spark, sf_dir):
    path = scratch_path(spark, "csv")
    results = rounds(fx.experiments(spark, sf_dir).drop("test_logloss"), "test_auc")
    results.write.option("header", True).csv(path)
    out = tables.read_csv(spark, path)
    return out.select("encoder", "seed", "dataset", "test_auc", F.col("epochs").cast("long").alias("epochs"))


@query("S6 S3", with_ctes(EXPERIMENTS) + f"SELECT encoder, dataset, {r6('test_auc')} AS test_auc, seed FROM experiments")
def table_overwrite(spark, sf_dir):
    """A table replaced by one with another schema, read back by name."""
    path, table = scratch_path(spark, "table"), "tidemark_overwritten"
    results = rounds(fx.experiments(spark, sf_dir), "test_auc")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    tables.overwrite_table(results.select("encoder", "epochs"), table, path=f"{path}/1")
    tables.overwrite_table(results.select("encoder", "dataset", "test_auc", "seed"), table, ["seed"], f"{path}/2")
    return tables.read_table(spark, table, ["encoder", "dataset", "test_auc", "seed"])


@query("S7 S8 S11", with_ctes(EXPERIMENTS) + f"""SELECT encoder, {r6('test_auc')} AS test_auc, CAST(NULL AS BIGINT) AS epochs,
  true AS is_stamped FROM experiments UNION ALL SELECT encoder, {r6('test_auc')}, epochs, true FROM experiments WHERE seed = 0""")
def append_with_schema_merge(spark, sf_dir):
    """Overwrite, then append rows with one more column, read back merged."""
    path = scratch_path(spark, "appended")
    results = rounds(fx.experiments(spark, sf_dir), "test_auc")
    stamp = F.current_timestamp()
    tables.overwrite_path(results.select("encoder", "test_auc", stamp.alias("timestamp")), path)
    tables.append_stamped(results.filter("seed = 0").select("encoder", "test_auc", "epochs"), path)
    out = tables.read_parquet(spark, path, merge_schema=True)
    return out.select("encoder", "test_auc", "epochs", F.col("timestamp").isNotNull().alias("is_stamped"))


SAMPLE_SIZES = {"train": 500, "val": 100, "test": 100}


@query("S9", with_ctes(IMPRESSIONS) + f"""SELECT {KEYS_SQL}, label, split AS split_name FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {DRAWN_SQL}) AS n FROM impressions)
  WHERE n <= CASE split {' '.join(f"WHEN '{s}' THEN {n}" for s, n in SAMPLE_SIZES.items())} END""")
def export_samples(spark, sf_dir):
    """A sample a split, written to folders and read back."""
    df = impressions(spark, sf_dir)
    splits = {s: df.filter(F.col("split") == s) for s in SAMPLE_SIZES}
    written = tables.export_samples(splits, SAMPLE_SIZES, scratch_path(spark, "export"), keys=KEYS)
    out = None
    for name, path in written.items():
        part = spark.read.parquet(path).select(*KEYS, "label", F.lit(name).alias("split_name"))
        out = part if out is None else out.unionByName(part)
    return out


UPSERT_SQL = f"""SELECT coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.seed, o.seed) AS seed,
  coalesce(n.field_name, o.field_name) AS field_name, coalesce(n.operator, o.operator) AS operator,
  {r6('coalesce(n.r2, o.r2)')} AS r2, {r6('coalesce(n.gap_rmse, o.gap_rmse)')} AS gap_rmse
  FROM (SELECT *, 0.5e0 AS gap_rmse FROM results WHERE seed < 2) o
  FULL OUTER JOIN (SELECT run_id, seed, field_name, operator, CAST(NULL AS DOUBLE) AS gap_rmse, r2 + 1e0 AS r2 FROM results WHERE seed > 0) n
  ON o.run_id = n.run_id AND o.seed = n.seed AND o.field_name = n.field_name"""


@query("S10", with_ctes(*CHAIN, SUMMARY, RESULTS) + UPSERT_SQL)
def upsert_results(spark, sf_dir):
    """Seeds 0-1 stored, seeds 1-2 written twice; the later write wins, gaps are kept."""
    results = results_of(spark, sf_dir)
    stored = results.filter("seed < 2").withColumn("gap_rmse", dbl(0.5))
    later = results.filter("seed > 0").withColumn("r2", F.col("r2") + dbl(1)).withColumn("written", F.lit(2))
    first = results.filter("seed > 0").withColumn("written", F.lit(1))
    out = upsert(stored, later.unionByName(first), order="written")
    return rounds(out.select("run_id", "seed", "field_name", "operator", "r2", "gap_rmse"), "r2", "gap_rmse")


@query("S10 W5", """SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
  FROM orders GROUP BY o_custkey""")
def latest_row_per_key(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ordered = orders.withColumn("o", F.struct("o_orderdate", "o_orderkey"))
    return latest_per_key(ordered, ["o_custkey"], "o").drop("o")


@query("S12", with_ctes(*CHAIN, SUMMARY, RESULTS) + """SELECT seed, field_name,
  CASE WHEN seed = 1 THEN 0.0123e0 END AS gap_rmse FROM results""")
def set_column_where(spark, sf_dir):
    results = results_of(spark, sf_dir)
    predicate = (F.col("dataset") == fx.DATASET) & (F.col("seed") == 1)
    return tables.set_where(results, "gap_rmse", dbl(0.0123), predicate).select("seed", "field_name", "gap_rmse")


@query("S14 S15", with_ctes(IMPRESSIONS) + "SELECT CAST(l_orderkey AS BIGINT) AS timestamp, label, "
       + ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in NUMERIC) + ", "
       + ", ".join(f"coalesce({c}, '<UNK>') AS {c}" for c in CATEGORIES) + " FROM impressions")
def envelope_round_trip(spark, sf_dir):
    """Lines to JSON envelopes and back to flat columns."""
    df = impressions(spark, sf_dir)
    lines = df.select("l_orderkey", envelope.to_line(df, "label", NUMERIC, CATEGORIES).alias("value"))
    messages = envelope.encode_lines(lines, F.col("l_orderkey"), "value", NUMERIC, CATEGORIES)
    return envelope.decode_json(messages, "value", NUMERIC, CATEGORIES)


@query("S16", "SELECT count(*) AS n_rows, CAST(13 AS BIGINT) AS min_cells, CAST(13 AS BIGINT) AS max_cells FROM lineitem")
def line_shape(spark, sf_dir):
    df = impressions(spark, sf_dir)
    return shape.line_shape(df.select(envelope.to_line(df, "label", NUMERIC, CATEGORIES).alias("value")))


# ── streaming ───────────────────────────────────────────────────────────────

COEFFICIENTS = {"I1": 0.2, "I4": -0.3, "I6": 0.1}
INTERCEPT = -0.7
SCORE_SQL = "1e0 / (1e0 + exp(-(-0.7e0 + 0.2e0 * I1 - 0.3e0 * I4 + 0.1e0 * I6)))"


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("p_click", sigmoid(linear_logit(INTERCEPT, COEFFICIENTS)))


def _envelopes(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("l_orderkey").alias("timestamp"),
        "label",
        F.struct(*NUMERIC).alias("numerical"),
        F.struct(*CATEGORIES).alias("categorical"),
    )


#: Rows of an inbox file, so that files and the tasks that write them grow with the table.
INBOX_ROWS = 500_000


def drained(spark: SparkSession, sf_dir: str) -> Sinks:
    """All impressions as a stream of parquet files, drained in several micro-batches."""
    # written once: artifacts, reference and inbox read it five times
    df = pin(impressions(spark, sf_dir).select("l_orderkey", "label", *NUMERIC, *CATEGORIES, "split"))
    train = df.filter(F.col("split") == "train")
    artifacts = fit_artifacts(train, LOG, STD, CATEGORIES)
    reference = drift.fit_reference(artifacts.apply_numeric(train), NUMERIC)
    inbox, root = scratch_path(spark, "inbox"), scratch_path(spark, "drained")
    files = max(6, -(-df.count() // INBOX_ROWS))
    _envelopes(df).repartition(files).write.parquet(inbox)
    job = BatchJob(artifacts, _score, reference, "linear@fixed", "parquet", Sinks(root))
    stream = parquet_stream(spark, inbox, envelope_schema(NUMERIC, CATEGORIES), files_per_trigger=-(-files // 3))
    drain(stream, job, f"{root}/offsets")
    return job.sinks


STREAM_CTES = (IMPRESSIONS, maps_sql(), PREPARED, SCALER, NORMED, encoded_sql("normed"))


@query("T1 T2 T3 T4 S5 S8", with_ctes(*STREAM_CTES) + "SELECT l_orderkey AS timestamp, label, "
       + ", ".join(f"{r6(c)} AS {c}" for c in NUMERIC) + ", " + ", ".join(f"{c}_idx" for c in CATEGORIES) + " FROM encoded")
def stream_processed_rows(spark, sf_dir):
    """What the drain stored equals the static transformation, row by row."""
    rows = read_sink(spark, drained(spark, sf_dir).processed)
    return rounds(rows.drop("batch_id"), *NUMERIC)


@query("T2 T4", with_ctes(*STREAM_CTES, f"scored AS (SELECT *, {SCORE_SQL} AS p FROM encoded)")
       + f"""SELECT count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicks, {r6('avg(p)')} AS ctr_predicted,
  {r6('avg(-(label * ln(p) + (1 - label) * ln(1e0 - p)))')} AS logloss FROM scored""")
def stream_metrics(spark, sf_dir):
    """Per-batch metrics of the drain, combined over the batches."""
    per_batch = read_sink(spark, drained(spark, sf_dir).metrics)
    n = F.sum("impressions")

    def weighted(c: str):
        return F.sum(F.col(c) * F.col("impressions")) / n

    return per_batch.agg(
        n.alias("impressions"),
        F.sum("clicks").alias("clicks"),
        rounded(weighted("ctr_predicted")).alias("ctr_predicted"),
        rounded(weighted("logloss")).alias("logloss"),
    )


@query("T4 T5", "SELECT field, count(*) AS n_rows FROM lineitem CROSS JOIN (VALUES "
       + ", ".join(f"('{c}')" for c in NUMERIC) + ") AS f(field) GROUP BY field")
def stream_drift(spark, sf_dir):
    """Rows each drift report covers, over all batches."""
    report = read_sink(spark, drained(spark, sf_dir).drift)
    return report.groupBy("field").agg(F.sum("n").alias("n_rows"))
