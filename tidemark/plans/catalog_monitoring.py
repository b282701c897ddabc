"""Queries: evaluation metrics, drift, monitoring rules, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import dbl, rounded
from tidemark.operators import drift, guards, metrics
from tidemark.plans import fixtures as fx
from tidemark.plans import monitoring
from tidemark.plans.catalog_features import NORMED, PREPARED, SCALER, _prepared
from tidemark.plans.catalog_formulas import rounds, sql_round
from tidemark.plans.fixtures import DRIFT_FIELDS, IMPRESSIONS, NUMERIC, STD, impressions, r6, with_ctes
from tidemark.plans.registry import query
from tidemark.operators import normalise
from tidemark.session import exchanges_removed, pin, scratch_scope

METRIC_NUMBERS = ("ctr_observed", "ctr_predicted", "logloss", "auc")

METRICS = """levels AS (SELECT batch_id, p_click, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
  FROM impressions GROUP BY batch_id, p_click),
ordered AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY batch_id ORDER BY p_click ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0e0) AS before FROM levels),
areas AS (SELECT batch_id, sum(pos * (before + 0.5e0 * neg)) / (sum(pos) * sum(neg)) AS auc FROM ordered GROUP BY batch_id),
counts AS (SELECT batch_id, count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicks, avg(CAST(label AS DOUBLE)) AS ctr_observed,
  avg(p_click) AS ctr_predicted, avg(-(label * ln(p_click) + (1 - label) * ln(1e0 - p_click))) AS logloss
  FROM impressions GROUP BY batch_id),
metrics AS (SELECT c.*, a.auc, CASE WHEN c.batch_id >= 3 THEN 'model@b' ELSE 'model@a' END AS model
  FROM counts c JOIN areas a ON c.batch_id = a.batch_id)"""


def metrics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-batch metrics table, with a model change at batch 3."""
    table = metrics.batch_metrics(impressions(spark, sf_dir), keys=["batch_id"])
    return table.withColumn("model", F.when(F.col("batch_id") >= 3, "model@b").otherwise("model@a"))


@query("M2 M3 M4 W8", with_ctes(IMPRESSIONS, METRICS) + f"""SELECT batch_id, impressions, clicks,
  CAST(0 AS BIGINT) AS n_unlabelled, {sql_round(*METRIC_NUMBERS)} FROM metrics""")
def batch_metrics(spark, sf_dir):
    return rounds(metrics.batch_metrics(impressions(spark, sf_dir), keys=["batch_id"]), *METRIC_NUMBERS)


@query("M2", with_ctes(IMPRESSIONS) + f"""SELECT split,
  {r6('avg(-(label * ln(greatest(least(p_click, 0.6e0), 0.4e0)) + (1 - label) * ln(1e0 - greatest(least(p_click, 0.6e0), 0.4e0))))')} AS logloss
  FROM impressions GROUP BY split""")
def clipped_log_loss(spark, sf_dir):
    loss = metrics.log_loss(F.col("label"), F.col("p_click"), eps=0.4)
    return rounds(impressions(spark, sf_dir).groupBy("split").agg(loss.alias("logloss")), "logloss")


def auc_sql(source: str, score: str) -> str:
    return f"""lv AS (SELECT {score} AS s, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM {source} GROUP BY {score})
SELECT {r6('sum(pos * (before + 0.5e0 * neg)) / (sum(pos) * sum(neg))')} AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before FROM lv)"""


@query("M3 W8", with_ctes(IMPRESSIONS, "x AS (SELECT label, I4 - I7 / 3e0 AS s FROM impressions)") + ", " + auc_sql("x", "s"))
def auc_of_many_levels(spark, sf_dir):
    """One group, almost as many score levels as rows."""
    df = impressions(spark, sf_dir).select("label", (F.col("I4") - F.col("I7") / dbl(3)).alias("s"))
    return rounds(metrics.auc(df, "label", "s"), "auc")


@query("M3", with_ctes(IMPRESSIONS, "x AS (SELECT label, floor(p_click * 50e0) AS s FROM impressions)") + ", " + auc_sql("x", "s"))
def binned_auc(spark, sf_dir):
    return rounds(metrics.binned_auc(impressions(spark, sf_dir), "label", "p_click", 50), "auc")


@query("M13", with_ctes(IMPRESSIONS) + f"""SELECT bool_and(p_click = round(p_click, 4)) AS is_equal,
  {r6('max(abs(p_click - round(p_click, 4)))', 9)} AS max_abs_diff,
  max(abs(p_click - round(p_click, 4))) <= 1e-3 AS within_tolerance FROM impressions""")
def scoring_parity(spark, sf_dir):
    df = impressions(spark, sf_dir).select("p_click", F.round("p_click", 4).alias("p4"))
    out = metrics.parity(df, "p_click", "p4", 1e-3)
    return out.withColumn("max_abs_diff", rounded(F.col("max_abs_diff"), 9))


# ── drift ───────────────────────────────────────────────────────────────────

RANGES = {
    "I1": (2.0, 49.0), "I2": (1.0, 6.0), "I3": (3.0, 48.0), "I4": (1000.0, 110000.0),
    "I5": (0.01, 0.09), "I6": (-900.0, 9950.0), "I7": (2000.0, 300000.0),
}
N_BINS = 10


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drift looks at, written once: reference and report read it several times."""
    return pin(impressions(spark, sf_dir, customers_first=True).select("batch_id", *DRIFT_FIELDS))


def _reference(rows: DataFrame) -> drift.DriftReference:
    return drift.fit_reference(rows.filter(F.col("batch_id") < fx.REFERENCE_BATCHES), DRIFT_FIELDS, N_BINS, RANGES, written=True)


def reference_of(spark: SparkSession, sf_dir: str) -> drift.DriftReference:
    return _reference(_watched(spark, sf_dir))


_DECILES = ", ".join(str(k / N_BINS) for k in range(1, N_BINS))
REFERENCE = (
    "long AS (" + " UNION ALL ".join(
        f"SELECT batch_id, '{f}' AS field, {f} AS v, {RANGES[f][0]}e0 AS lo, {RANGES[f][1]}e0 AS hi FROM impressions"
        for f in DRIFT_FIELDS) + "),\n"
    f"""edges AS (SELECT field, list_sort(list_distinct(quantile_cont(v, [{_DECILES}]))) AS e FROM long
  WHERE batch_id < {fx.REFERENCE_BATCHES} GROUP BY field),
binned AS (SELECT batch_id, l.field, len(list_filter(e, lambda q: q <= v)) AS bin FROM long l JOIN edges d ON l.field = d.field
  WHERE isfinite(v)),
bins AS (SELECT field, CAST(unnest(range(len(e) + 1)) AS BIGINT) AS bin FROM edges),
ref_counts AS (SELECT field, bin, count(*) AS n FROM binned WHERE batch_id < {fx.REFERENCE_BATCHES} GROUP BY field, bin),
expected AS (SELECT b.field, b.bin, coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY b.field) AS DOUBLE) AS share
  FROM bins b LEFT JOIN ref_counts c ON b.field = c.field AND b.bin = c.bin)"""
)
DRIFT = """batch_counts AS (SELECT batch_id, field, bin, count(*) AS n FROM binned GROUP BY batch_id, field, bin),
batch_list AS (SELECT DISTINCT batch_id FROM long),
cells AS (SELECT t.batch_id, e.field, e.bin, greatest(e.share, 1e-4) AS ec,
  coalesce(c.n, 0) / CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY t.batch_id, e.field) AS DOUBLE) AS ash
  FROM batch_list t CROSS JOIN expected e LEFT JOIN batch_counts c
  ON c.batch_id = t.batch_id AND c.field = e.field AND c.bin = e.bin),
settled AS (SELECT batch_id, field, ec / sum(ec) OVER (PARTITION BY batch_id, field) AS e,
  greatest(ash, 1e-4) / sum(greatest(ash, 1e-4)) OVER (PARTITION BY batch_id, field) AS a FROM cells),
psis AS (SELECT batch_id, field, sum((a - e) * ln(a / e)) AS psi FROM settled GROUP BY batch_id, field),
cover AS (SELECT batch_id, field, count(*) AS n, avg(CASE WHEN v BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END) AS coverage,
  avg(CASE WHEN v < lo THEN 1e0 ELSE 0e0 END) AS share_below, avg(CASE WHEN v > hi THEN 1e0 ELSE 0e0 END) AS share_above,
  min(lo) AS cal_low, min(hi) AS cal_high FROM long GROUP BY batch_id, field),
drift AS (SELECT c.*, p.psi, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warning' ELSE 'ok' END AS psi_level,
  coverage < 0.99 AS coverage_alert FROM cover c JOIN psis p ON c.batch_id = p.batch_id AND c.field = p.field)"""
DRIFT_CTES = (IMPRESSIONS, REFERENCE, DRIFT)
DRIFT_NUMBERS = ("psi", "coverage", "share_below", "share_above", "cal_low", "cal_high")


def drift_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _watched(spark, sf_dir)
    return pin(drift.drift_report(rows, _reference(rows), ["batch_id"]))  # a row per batch and field


REFERENCE_ROWS = f"""SELECT e.field, CAST(e.bin AS INT) AS bin, {r6('share')} AS expected,
  {r6('CASE WHEN e.bin = 0 THEN NULL ELSE d.e[e.bin] END')} AS lower_edge,
  (SELECT count(*) FROM impressions WHERE batch_id < {fx.REFERENCE_BATCHES}) AS n_ref
  FROM expected e JOIN edges d ON e.field = d.field"""


def reference_rows(table: DataFrame) -> DataFrame:
    rows = table.select("field", "n_ref", "edges", F.posexplode("expected").alias("bin", "expected"))
    edge = F.when(F.col("bin") > 0, F.get("edges", F.col("bin")))
    return rows.select(
        "field", "bin", rounded(F.col("expected")).alias("expected"), rounded(edge).alias("lower_edge"), "n_ref"
    )


@query("D1 A10 A11", with_ctes(IMPRESSIONS, REFERENCE) + REFERENCE_ROWS)
def drift_reference(spark, sf_dir):
    return reference_rows(reference_of(spark, sf_dir).to_table(spark))


@query("D6", with_ctes(IMPRESSIONS, REFERENCE) + REFERENCE_ROWS)
def drift_reference_round_trip(spark, sf_dir):
    fitted = reference_of(spark, sf_dir)
    from_text = drift.DriftReference.from_json(fitted.to_json())
    again = drift.DriftReference.from_table(from_text.to_table(spark), DRIFT_FIELDS)
    return reference_rows(again.to_table(spark))


@query("D2 D3 D4 J4 P16", with_ctes(*DRIFT_CTES)
       + f"SELECT batch_id, field, n, psi_level, coverage_alert, {sql_round(*DRIFT_NUMBERS)} FROM drift")
def drift_report(spark, sf_dir):
    return rounds(drift_of(spark, sf_dir), *DRIFT_NUMBERS)


@query("D3", with_ctes(IMPRESSIONS) + f"""SELECT batch_id,
  {r6('avg(CASE WHEN I3 BETWEEN 5e0 AND 45e0 THEN 1e0 ELSE 0e0 END)')} AS coverage FROM impressions GROUP BY batch_id""")
def range_coverage(spark, sf_dir):
    cover = drift.range_coverage(F.col("I3"), 5, 45)
    return rounds(impressions(spark, sf_dir).groupBy("batch_id").agg(cover.alias("coverage")), "coverage")


@query("D5 W7", with_ctes(*DRIFT_CTES) + f"""SELECT batch_id, count(*) AS n_fields, {r6('max(psi)')} AS max_psi,
  arg_max(field, psi) AS worst_psi_field, {r6('min(coverage)')} AS min_coverage,
  coalesce(list_sort(list(field) FILTER (WHERE psi_level = 'alert')), []) AS fields_psi_alert,
  coalesce(list_sort(list(field) FILTER (WHERE psi_level = 'warning')), []) AS fields_psi_warning,
  coalesce(list_sort(list(field) FILTER (WHERE coverage_alert)), []) AS fields_coverage_alert FROM drift GROUP BY batch_id""")
def drift_summary(spark, sf_dir):
    return rounds(drift.summarize(drift_of(spark, sf_dir), ["batch_id"]), "max_psi", "min_coverage")


@query("U4", with_ctes(*DRIFT_CTES) + f"SELECT field, batch_id, {r6('psi')} AS psi FROM drift")
def drift_matrix(spark, sf_dir):
    """The matrix over whatever batches there are, unfolded again to compare its cells."""
    out = monitoring.drift_matrix(drift_of(spark, sf_dir))
    cells = F.explode(F.map_entries(F.create_map(*[x for c in out.columns[1:] for x in (F.lit(int(c)), F.col(f"`{c}`"))])))
    return out.select("field", cells.alias("cell")).select(
        "field", F.col("cell.key").cast("bigint").alias("batch_id"), rounded(F.col("cell.value")).alias("psi"))


# ── monitoring rules ────────────────────────────────────────────────────────

METRIC_CTES = (IMPRESSIONS, METRICS)


@query("K1 W3", with_ctes(*METRIC_CTES) + f"""SELECT batch_id, {r6('100e0 * (ctr_predicted - ctr_observed)')} AS calibration_gap_pp
  FROM metrics WHERE batch_id = (SELECT max(batch_id) FROM metrics)""")
def calibration_gap(spark, sf_dir):
    return rounds(monitoring.calibration_gap(metrics_of(spark, sf_dir)), "calibration_gap_pp")


@query("K2 W3", with_ctes(*DRIFT_CTES) + """SELECT batch_id, count(*) FILTER (WHERE psi_level = 'alert' OR coverage_alert) AS n_fields_alert
  FROM drift WHERE batch_id = (SELECT max(batch_id) FROM drift) GROUP BY batch_id""")
def fields_in_alert(spark, sf_dir):
    return monitoring.fields_in_alert(drift_of(spark, sf_dir))


@query("K3 W4", with_ctes(*METRIC_CTES) + f"""SELECT batch_id, {sql_round('ctr_observed', 'ctr_predicted')} FROM (
  SELECT *, abs(ctr_predicted - ctr_observed) > 0.005 AS off,
  lag(abs(ctr_predicted - ctr_observed) > 0.005) OVER (ORDER BY batch_id) AS prev_off FROM metrics) WHERE off AND prev_off""")
def miscalibrated_batches(spark, sf_dir):
    out = monitoring.miscalibrated(metrics_of(spark, sf_dir), limit=0.005)
    return rounds(out, "ctr_observed", "ctr_predicted")


@query("K4", with_ctes(*DRIFT_CTES) + f"""SELECT batch_id, count(*) AS n_fields, {r6('max(psi)')} AS max_psi
  FROM drift WHERE psi_level = 'alert' GROUP BY batch_id""")
def input_drift_batches(spark, sf_dir):
    return rounds(monitoring.input_drift(drift_of(spark, sf_dir)), "max_psi")


@query("K4", with_ctes(*DRIFT_CTES) + f"""SELECT batch_id, count(*) AS n_fields, {r6('min(coverage)')} AS min_coverage
  FROM drift WHERE coverage < 0.99 GROUP BY batch_id""")
def off_curve_batches(spark, sf_dir):
    return rounds(monitoring.off_curve(drift_of(spark, sf_dir)), "min_coverage")


@query("K5 W4", with_ctes(*METRIC_CTES) + """SELECT batch_id, prev AS previous_model, model FROM (SELECT *,
  lag(model) OVER (ORDER BY batch_id) AS prev FROM metrics) WHERE model <> prev""")
def model_changes(spark, sf_dir):
    return monitoring.model_changed(metrics_of(spark, sf_dir))


@query("K6", with_ctes(IMPRESSIONS) + """SELECT CAST(least(floor(p_click * 20e0) + 1, 20) AS INT) AS bin, count(*) AS n_rows
  FROM impressions WHERE batch_id = (SELECT max(batch_id) FROM impressions) GROUP BY 1""")
def score_histogram(spark, sf_dir):
    return monitoring.score_histogram(impressions(spark, sf_dir))


@query("W6 T5", with_ctes(*METRIC_CTES) + f"""SELECT batch_id, impressions, clicks, {sql_round('auc')} FROM metrics
  ORDER BY batch_id DESC LIMIT 5""")
def last_batches(spark, sf_dir):
    out = monitoring.last_batches(metrics_of(spark, sf_dir), 5)
    return rounds(out.select("batch_id", "impressions", "clicks", "auc"), "auc")


# ── guards ──────────────────────────────────────────────────────────────────


@query("G1", with_ctes(IMPRESSIONS, PREPARED, SCALER, NORMED) + "SELECT "
       + ", ".join(f"{r6(f'stddev_samp({c})')} AS {c}" for c in STD) + " FROM normed WHERE split = 'train'")
def normalised_deviations(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    train = prepared.filter(F.col("split") == "train")
    scaled = normalise.apply_scaler(train, normalise.fit_scaler(train, STD), STD)
    guards.assert_normalised(scaled, STD)
    return rounds(guards.deviations(scaled, STD), *STD)


@query("G2")
def artifact_manifest(spark, sf_dir):
    with scratch_scope(spark), exchanges_removed(spark):
        # joined and written once: both layouts come from it
        df = pin(impressions(spark, sf_dir, customers_first=True))
        artifacts = {"impressions": df, "items": fx.item_metadata(spark, sf_dir)}
        found = guards.manifest(spark, artifacts, NUMERIC, fx.CATEGORIES, {"C1": 3}, {"seed": "42"})
        stored = spark.createDataFrame(found.collect(), found.schema)  # one row an artifact
        # another layout, whose tasks are as many as the rows need
        shuffled = {"impressions": df.repartition("l_partkey", "l_linenumber"), "items": artifacts["items"]}
        guards.check_manifest(stored, shuffled, NUMERIC)
    return stored
