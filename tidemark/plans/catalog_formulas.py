"""Queries: formulas, curves, extraction, formula reports, experiment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.formulas import OPERATORS, number_text, shape
from tidemark.functions.scalars import dbl, fidelity_verdict, monotone_verdict, psi_level, rounded
from tidemark.functions.splines import with_basis, with_curve_values
from tidemark.operators import ablation, curves, extraction
from tidemark.operators.modes import mode_first_seen
from tidemark.plans import fixtures as fx
from tidemark.plans import reports
from tidemark.plans.catalog_features import KEYS, KEYS_SQL
from tidemark.plans.fixtures import (
    CURVES, DATASET, EXPERIMENTS, IMPRESSIONS, NORMS, TIMINGS, impressions, r6, with_ctes,
)
from tidemark.plans.registry import query
from tidemark.sources.results_json import flatten_document, result_rows
from tidemark.sources.schemas import FORMULA_DOCUMENT

THRESHOLD = 0.05  # the fixture's fits are weak

# ── SQL twins ───────────────────────────────────────────────────────────────

SHAPES_SQL = {
    "log": "ln(abs({x}) + 1e0)",
    "exp": "exp(greatest(least({x}, 500e0), -500e0))",
    "square": "{x} * {x}",
    "sqrt": "sqrt(abs({x}))",
    "inverse": "1e0 / (abs({x}) + 1e-6)",
    "sigmoid": "1e0 / (1e0 + exp(greatest(least(-{x}, 500e0), -500e0)))",
    "linear": "{x}",
}
TEXT_SQL = {
    "log": "{a} || '·log(|x|+1) + ' || {b}",
    "exp": "{a} || '·exp(x) + ' || {b}",
    "square": "{a} || '·x² + ' || {b}",
    "sqrt": "{a} || '·√|x| + ' || {b}",
    "inverse": "{a} || '/(|x|+ε) + ' || {b}",
    "sigmoid": "{a} || '·σ(x) + ' || {b}",
    "linear": "{a} || '·x + ' || {b}",
}


def shape_sql(operator: str, x: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {operator} = '{op}' THEN {SHAPES_SQL[op].format(x=x)}" for op in OPERATORS
    ) + " END"


def number_sql(x: str) -> str:
    fixed = f"CAST(CAST(round({x}, 4) AS DECIMAL(38,4)) AS VARCHAR)"
    text = f"regexp_replace(regexp_replace({fixed}, '0+$', ''), '\\.$', '.0')"
    return f"(CASE WHEN {x} < 0 AND {text} IN ('0.0', '-0.0') THEN '-0.0' ELSE {text} END)"


def text_sql(operator: str, a: str, b: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {operator} = '{op}' THEN {TEXT_SQL[op].format(a=number_sql(a), b=number_sql(b))}"
        for op in OPERATORS
    ) + " END"


CANDIDATES = (
    "ops AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{op}')" for i, op in enumerate(OPERATORS))
    + ") AS t(op_no, operator)),\n"
    f"shaped AS (SELECT seed, field_name, dim, op_no, operator, phi, {shape_sql('operator', 'x')} AS f "
    "FROM curves CROSS JOIN ops),\n"
    "raw_candidates AS (SELECT seed, field_name, dim, op_no, operator, regr_slope(phi, f) AS a, "
    "regr_intercept(phi, f) AS b, regr_r2(phi, f) AS rho2, count(*) * var_pop(phi) AS ss "
    "FROM shaped GROUP BY seed, field_name, dim, op_no, operator),\n"
    "candidates AS (SELECT *, 1e0 - ss * (1e0 - rho2) / (ss + 1e-10) AS r2 FROM raw_candidates "
    "WHERE ss >= 1e-12 AND a IS NOT NULL AND isfinite(a) AND isfinite(b) AND isfinite(rho2))"
)
FITS = (
    "fits AS (SELECT seed, field_name, dim, operator, r2, a, b, "
    f"{text_sql('operator', 'a', 'b')} AS formula FROM ("
    "SELECT *, row_number() OVER (PARTITION BY seed, field_name, dim ORDER BY round(r2, 9) DESC, op_no) AS rn "
    "FROM candidates) WHERE rn = 1)"
)
SUMMARY = (
    "op_counts AS (SELECT seed, field_name, operator, count(*) AS n_op, min(dim) AS first_dim FROM fits "
    "GROUP BY seed, field_name, operator),\n"
    "dominant AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, field_name "
    "ORDER BY n_op DESC, first_dim) AS rn FROM op_counts) WHERE rn = 1),\n"
    "representative AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.seed, f.field_name "
    "ORDER BY f.r2 DESC, f.dim) AS rn FROM fits f JOIN dominant d ON f.seed = d.seed AND "
    "f.field_name = d.field_name AND f.operator = d.operator) WHERE rn = 1),\n"
    "spread AS (SELECT seed, field_name, count(*) AS n_dims_fitted, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, "
    "min(r2) AS r2_min, max(r2) AS r2_max, arg_min(operator, dim) AS dim0_operator, arg_min(r2, dim) AS dim0_r2 "
    "FROM fits GROUP BY seed, field_name),\n"
    "summary AS (SELECT s.seed, s.field_name, d.operator, r.a AS param_a, r.b AS param_b, r.formula, "
    f"s.r2_mean >= {THRESHOLD}e0 AS accepted, s.n_dims_fitted, "
    "CAST(d.n_op AS DOUBLE) / s.n_dims_fitted AS operator_agreement, r2_mean, r2_std, r2_min, r2_max, "
    "dim0_operator, dim0_r2 FROM spread s JOIN dominant d ON s.seed = d.seed AND s.field_name = d.field_name "
    "JOIN representative r ON s.seed = r.seed AND s.field_name = r.field_name)"
)
RESULTS = (
    "results AS (SELECT 'run-s' || CAST(seed AS VARCHAR) AS run_id, "
    f"'{DATASET}' AS dataset, seed, field_name, 'spline' AS encoder, operator, formula AS formula_str, "
    "r2_mean AS r2, accepted AS is_accepted, param_a, param_b, r2_mean, r2_std, r2_min, operator_agreement, "
    "n_dims_fitted FROM summary)"
)
CHAIN = (CURVES, CANDIDATES, FITS)


def fits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.fit_curves(fx.curves(spark, sf_dir))


def summary_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.field_summary(fits_of(spark, sf_dir), THRESHOLD)


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_id = F.concat(F.lit("run-s"), F.col("seed").cast("string"))
    return result_rows(summary_of(spark, sf_dir), run_id, F.lit(DATASET))


def sql_round(*columns: str) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in columns)


def rounds(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


# ── operator library and text ───────────────────────────────────────────────


@query("P11", with_ctes(IMPRESSIONS) + f"SELECT {KEYS_SQL}, " + ", ".join(
    f"{r6(f'2e0 * ({s}) - 1e0'.format(x='((I6 - 4000e0) / 300e0)'))} AS f_{op}" for op, s in SHAPES_SQL.items()
    if op != "exp") + f", {r6('ln(' + SHAPES_SQL['exp'].format(x='((I6 - 4000e0) / 3e0)') + ')')} AS ln_f_exp FROM impressions")
def operator_library(spark, sf_dir):
    x = (F.col("I6") - dbl(4000)) / dbl(300)
    steep = (F.col("I6") - dbl(4000)) / dbl(3)
    values = [
        rounded(dbl(2) * shape(op, x) - dbl(1)).alias(f"f_{op}") for op in OPERATORS if op != "exp"
    ]
    return impressions(spark, sf_dir).select(
        *KEYS, *values, rounded(F.log(shape("exp", steep))).alias("ln_f_exp")
    )


@query("P12", with_ctes(*CHAIN) + "SELECT seed, field_name, dim, formula, "
       f"{number_sql('r2')} AS r2_text FROM fits")
def formula_text(spark, sf_dir):
    return fits_of(spark, sf_dir).select(
        "seed", "field_name", "dim", "formula", number_text(F.col("r2")).alias("r2_text")
    )


# ── splines and curves ──────────────────────────────────────────────────────

KNOTS = [-2.5, -1.5, -0.75, -0.25, 0.0, 0.5, 1.25, 2.0, 2.75, 3.5, 4.0]
ORDER = 3
N_BASIS = len(KNOTS) - ORDER - 1
X_SQL = "(I6 - 4000e0) / 2000e0"


def recurrence_sql(source: str, knots: list[str], carry: str, name: str = "b") -> str:
    """Full recurrence over all functions, one common table expression per degree.

    ``source`` has column x and the carried columns; knots are SQL expressions.
    """
    n = len(knots)
    cells = ", ".join(
        f"CASE WHEN x >= {knots[i]} AND x < {knots[i + 1]} THEN 1e0 ELSE 0e0 END AS n{i}" for i in range(n - 1)
    )
    levels = [f"{name}0 AS (SELECT {carry}, x, {cells} FROM {source})"]
    for k in range(1, ORDER + 1):
        cols = []
        for i in range(n - 1 - k):
            up = f"(x - {knots[i]}) / ({knots[i + k]} - {knots[i]}) * n{i}"
            down = f"({knots[i + k + 1]} - x) / ({knots[i + k + 1]} - {knots[i + 1]}) * n{i + 1}"
            cols.append(f"{up} + {down} AS n{i}")
        levels.append(f"{name}{k} AS (SELECT {carry}, x, {', '.join(cols)} FROM {name}{k - 1})")
    return ", ".join(levels)


def basis_sql() -> str:
    source = f"(SELECT *, {X_SQL} AS x FROM impressions)"
    return recurrence_sql(source, [f"({t}e0)" for t in KNOTS], KEYS_SQL)


@query("P13", with_ctes(IMPRESSIONS, basis_sql()) + f"SELECT {KEYS_SQL}, "
       + ", ".join(f"{r6(f'n{i}')} AS n{i}" for i in range(N_BASIS)) + f" FROM b{ORDER}")
def spline_basis(spark, sf_dir):
    x = (F.col("I6") - dbl(4000)) / dbl(2000)
    values = with_basis(impressions(spark, sf_dir), {"b": (x, KNOTS)}, ORDER)
    return values.select(*KEYS, *[rounded(F.col("b")[i]).alias(f"n{i}") for i in range(N_BASIS)])


def curve_weights_of(dim: int) -> tuple[float, list[float]]:
    return (dim + 1) / 4, [((7 * k + 3 * dim) % 11 - 5) / 10 for k in range(N_BASIS)]


def curve_sql(dim: int, x: str) -> str:
    base, w = curve_weights_of(dim)
    return f"{x} / (1e0 + exp(-({x}))) * {base}e0 + " + " + ".join(f"n{i} * ({v}e0)" for i, v in enumerate(w))


@query("P14", with_ctes(IMPRESSIONS, basis_sql()) + f"SELECT {KEYS_SQL}, "
       + ", ".join(f"{r6(curve_sql(d, 'x'))} AS phi{d}" for d in range(2)) + f" FROM b{ORDER}")
def curve_values(spark, sf_dir):
    x = (F.col("I6") - dbl(4000)) / dbl(2000)
    asked = {}
    for d in range(2):
        base, w = curve_weights_of(d)
        asked[f"phi{d}"] = (x, KNOTS, base, w)
    out = with_curve_values(impressions(spark, sf_dir), asked, ORDER)
    return rounds(out.select(*KEYS, *asked), *asked)


GRID_SIZE = 5


def knots_sql() -> str:
    parts = []
    for f in fx.DRIFT_FIELDS:
        step = "(hi - lo + 0.02e0) / 5e0"
        inner = [
            f"0.02e0 * (lo - 0.01e0 + {k}e0 * {step}) + 0.98e0 * q{k}" for k in range(GRID_SIZE + 1)
        ]
        cells = [f"({inner[0]}) - {j}e0 * {step}" for j in range(ORDER, 0, -1)]
        cells += inner
        cells += [f"({inner[-1]}) + {j}e0 * {step}" for j in range(1, ORDER + 1)]
        qs = ", ".join(f"quantile_cont({f}, {k / GRID_SIZE}) AS q{k}" for k in range(GRID_SIZE + 1))
        picks = " UNION ALL ".join(f"SELECT {i} AS k, {c} AS knot FROM s{f}" for i, c in enumerate(cells))
        parts.append(
            f"s{f} AS (SELECT min({f}) AS lo, max({f}) AS hi, {qs} FROM impressions WHERE split = 'train'), "
            f"k{f} AS ({picks})"
        )
    return ", ".join(parts)


def all_knots_sql() -> str:
    return "knots AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS field, k, knot FROM k{f}" for f in fx.DRIFT_FIELDS) + ")"


def knots_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = impressions(spark, sf_dir).filter(F.col("split") == "train")
    return curves.knot_table(train, fx.DRIFT_FIELDS, GRID_SIZE, ORDER)


@query("M5", with_ctes(IMPRESSIONS, knots_sql(), all_knots_sql())
       + f"SELECT field, CAST(k AS INT) AS k, {r6('knot')} AS knot FROM knots")
def knot_calibration(spark, sf_dir):
    out = knots_of(spark, sf_dir).select("field", F.posexplode("knots").alias("k", "knot"))
    return rounds(out, "knot")


@query("D7 D8", with_ctes(IMPRESSIONS, knots_sql(), all_knots_sql()) + f"""SELECT field,
  {r6('min(knot) FILTER (WHERE k = 3)')} AS cal_low, {r6('max(knot) FILTER (WHERE k = 8)')} AS cal_high,
  true AS is_calibrated FROM knots GROUP BY field""")
def calibrated_ranges(spark, sf_dir):
    knots = knots_of(spark, sf_dir)
    both = curves.calibrated_ranges(knots, ORDER).join(curves.calibration_check(knots, ORDER), "field")
    return rounds(both, "cal_low", "cal_high")


EXPORT_SEEDS, EXPORT_DIMS, EXPORT_POINTS = (1, 2), (0, 1), 60
EXPORT_FIELDS = fx.DRIFT_FIELDS


def export_weight(k: int, seed: int, dim: int) -> float:
    return ((k + seed + dim) % 5) / 5


def export_sql() -> str:
    parts, picks = [], []
    n_knots, n_basis = GRID_SIZE + 1 + 2 * ORDER, GRID_SIZE + ORDER
    for f in EXPORT_FIELDS:
        wide = ", ".join(f"max(knot) FILTER (WHERE k = {i}) AS t{i}" for i in range(n_knots))
        low, high = f"t{ORDER}", f"t{n_knots - 1 - ORDER}"
        start = f"({low} - 0.1e0 * ({high} - {low}))"
        step = f"({high} - {low}) * 1.2e0 / {EXPORT_POINTS - 1}e0"
        knots = [f"t{i}" for i in range(n_knots)]
        parts.append(f"w{f} AS (SELECT {wide} FROM k{f})")
        parts.append(
            f"g{f} AS (SELECT *, {start} + i * {step} AS gx, "
            f"greatest(least({start} + i * {step}, 10e0), -10e0) AS x "
            f"FROM w{f} CROSS JOIN generate_series(0, {EXPORT_POINTS - 1}) AS s(i))"
        )
        parts.append(recurrence_sql(f"g{f}", knots, "gx, " + ", ".join(knots), f"v{f}_"))
        for s in EXPORT_SEEDS:
            for d in EXPORT_DIMS:
                total = " + ".join(f"n{k} * {export_weight(k, s, d)}e0" for k in range(n_basis))
                picks.append(
                    f"SELECT {s} AS seed, '{f}' AS field_name, {d} AS dim, {r6('gx')} AS x, "
                    f"{r6(f'x / (1e0 + exp(-x)) * 0.5e0 + {total}')} AS phi FROM v{f}_{ORDER}"
                )
    return with_ctes(IMPRESSIONS, knots_sql(), *parts) + " UNION ALL ".join(picks)


@query("M11 U3", export_sql())
def curve_export(spark, sf_dir):
    """Curves on knots fitted to the train rows, two seeds and dimensions."""
    knots = curves.load_knots(knots_of(spark, sf_dir))
    table = curves.weight_table(spark, [
        curves.Curve(s, f, d, 0.5, tuple(export_weight(k, s, d) for k in range(GRID_SIZE + ORDER)))
        for s in EXPORT_SEEDS for f in EXPORT_FIELDS for d in EXPORT_DIMS])
    return rounds(curves.curve_points(table, knots, ORDER, n_points=EXPORT_POINTS), "x", "phi")


# ── extraction ──────────────────────────────────────────────────────────────


@query("F1", with_ctes(CURVES, CANDIDATES) + f"""SELECT seed, field_name, dim, operator,
  {r6('a * 1e0', 6)} AS a, {r6('b')} AS b, {r6('r2')} AS r2 FROM candidates""")
def operator_fits(spark, sf_dir):
    fits = extraction.operator_fits(fx.curves(spark, sf_dir))
    out = fits.select("seed", "field_name", "dim", F.inline("fits"))
    return rounds(out, "a", "b", "r2").drop("rank", "late")


@query("F1", with_ctes(*CHAIN) + f"SELECT seed, field_name, dim, operator, {sql_round('r2')}, "
       f"{r6('a')} AS param_a, {r6('b')} AS param_b, formula FROM fits")
def fit_curves(spark, sf_dir):
    return rounds(fits_of(spark, sf_dir), "r2", "param_a", "param_b")


NUMBERS = ("param_a", "param_b", "operator_agreement", "r2_mean", "r2_std", "r2_min", "r2_max", "dim0_r2")


@query("F2 A9 W5", with_ctes(*CHAIN, SUMMARY) + "SELECT seed, field_name, operator, formula, accepted, "
       f"n_dims_fitted, dim0_operator, {sql_round(*NUMBERS)} FROM summary")
def field_summary(spark, sf_dir):
    return rounds(summary_of(spark, sf_dir), *NUMBERS)


@query("A9", with_ctes(*CHAIN) + """, counted AS (SELECT seed, field_name, operator, count(*) AS n, min(dim) AS d
  FROM fits GROUP BY seed, field_name, operator)
  SELECT seed, field_name, arg_min(operator, -n * 1000 + d) AS mode, CAST(max(n) AS BIGINT) AS mode_count,
  CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY seed, field_name""")
def operator_mode(spark, sf_dir):
    return mode_first_seen(fits_of(spark, sf_dir), ["seed", "field_name"], "operator", "dim")


@query("F3", with_ctes(NORMS) + f"""SELECT n.seed, field_name, {sql_round('norm', 'threshold')} FROM norms n
  JOIN (SELECT seed, quantile_cont(norm, 0.2) AS threshold FROM norms GROUP BY seed) t ON n.seed = t.seed
  WHERE norm >= threshold""")
def prune_by_norm(spark, sf_dir):
    return rounds(extraction.prune_by_norm(fx.norms(spark, sf_dir)), "norm", "threshold")


EDGE_SQL = """edges AS (SELECT CAST(label AS INT) AS seed, 'I' || CAST(vec_id % 13 AS VARCHAR) AS field_name,
  list_sum(list_transform(embedding, lambda w: abs(CAST(w AS DOUBLE)))) AS size FROM embeddings),
norms AS (SELECT seed, field_name, sum(size) AS norm FROM edges GROUP BY seed, field_name)"""


@query("F3", with_ctes(EDGE_SQL) + f"""SELECT n.seed, field_name, {sql_round('norm', 'threshold')} FROM norms n
  JOIN (SELECT seed, quantile_cont(norm, 0.2) AS threshold FROM norms GROUP BY seed) t ON n.seed = t.seed
  WHERE norm >= threshold""")
def prune_by_edge_norm(spark, sf_dir):
    """Fields kept by the norms of their curves' weights: one curve per (field, dim)."""
    weights = fx.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("int").alias("seed"),
        F.concat(F.lit("I"), (F.col("vec_id") % 13).cast("string")).alias("field_name"),
        F.floor(F.col("vec_id") / 13).alias("dim"),
        F.col("embedding").cast("array<double>").alias("weights"),
    )
    return rounds(extraction.prune_by_norm(curves.edge_norms(weights)), "norm", "threshold")


STEPS = """diffs AS (SELECT seed, field_name, dim, phi - lag(phi) OVER (PARTITION BY seed, field_name, dim ORDER BY x) AS d
  FROM curves),
steps AS (SELECT seed, field_name, dim, count(*) FILTER (WHERE d > 1e-4) AS n_up,
  count(*) FILTER (WHERE d < -1e-4) AS n_down, count(d) AS n_steps FROM diffs GROUP BY seed, field_name, dim)"""


def monotone_sql(wanted: str) -> str:
    return f"""directed AS (SELECT *, {wanted} AS wanted FROM steps),
rates AS (SELECT seed, field_name, dim, CASE WHEN n_up + n_down = 0 THEN 0e0 ELSE
  (CASE WHEN wanted = 'increasing' THEN n_down ELSE n_up END) / CAST(n_steps AS DOUBLE) END AS rate,
  CASE WHEN n_up + n_down = 0 THEN 'flat' ELSE wanted END AS direction FROM directed),
modes AS (SELECT seed, field_name, arg_min(direction, d - 1000 * n) AS direction FROM (
  SELECT seed, field_name, direction, count(*) AS n, min(dim) AS d FROM rates GROUP BY seed, field_name, direction)
  GROUP BY seed, field_name),
monotone AS (SELECT r.seed, r.field_name, avg(rate) AS violation_rate, stddev_pop(rate) AS violation_std,
  m.direction, avg(rate) < 0.05 AS is_monotone FROM rates r JOIN modes m ON r.seed = m.seed AND r.field_name = m.field_name
  GROUP BY r.seed, r.field_name, m.direction)"""


OWN = "CASE WHEN n_up >= n_down THEN 'increasing' ELSE 'decreasing' END"
EXPECTED = {"click": "increasing", "view": "decreasing"}
WANTED = "CASE " + " ".join(f"WHEN field_name = '{k}' THEN '{v}'" for k, v in EXPECTED.items()) + f" ELSE {OWN} END"


@query("W2", with_ctes(CURVES, STEPS) + "SELECT seed, field_name, dim, n_up, n_down, n_steps FROM steps")
def curve_steps(spark, sf_dir):
    return extraction.curve_steps(fx.curves(spark, sf_dir))


@query("F4 P16", with_ctes(CURVES, STEPS, monotone_sql(OWN)) + f"""SELECT seed, field_name, direction, is_monotone,
  {sql_round('violation_rate', 'violation_std')}, CASE WHEN violation_rate < 0.05 THEN 'monotone'
  WHEN violation_rate < 0.15 THEN 'almost' ELSE 'not monotone' END AS verdict FROM monotone""")
def monotonicity(spark, sf_dir):
    out = extraction.monotonicity(fx.curves(spark, sf_dir))
    out = out.withColumn("verdict", monotone_verdict(F.col("violation_rate")))
    return rounds(out, "violation_rate", "violation_std")


@query("F5", with_ctes(CURVES, STEPS, monotone_sql(WANTED)) + f"""SELECT seed, field_name, direction, is_monotone,
  {sql_round('violation_rate', 'violation_std')} FROM monotone""")
def monotonicity_against(spark, sf_dir):
    out = extraction.monotonicity_against(fx.curves(spark, sf_dir), EXPECTED)
    return rounds(out, "violation_rate", "violation_std")


SCALED = f"""formula_points AS (SELECT c.*, s.operator, s.param_a * ({shape_sql('s.operator', 'c.x')}) + s.param_b AS f
  FROM curves c JOIN summary s ON c.seed = s.seed AND c.field_name = s.field_name),
scales AS (SELECT seed, field_name, dim, operator, CASE WHEN var_pop(f) < 1e-12 THEN 0e0 ELSE regr_slope(phi, f) END AS scale,
  CASE WHEN var_pop(f) < 1e-12 THEN avg(phi) ELSE regr_intercept(phi, f) END AS "offset"
  FROM formula_points GROUP BY seed, field_name, dim, operator),
scaled AS (SELECT p.seed, p.field_name, p.dim, p.operator, scale, "offset",
  sqrt(avg(pow(scale * f + "offset" - phi, 2))) / (stddev_pop(phi) + 1e-9) AS curve_rel_error
  FROM formula_points p JOIN scales s ON p.seed = s.seed AND p.field_name = s.field_name AND p.dim = s.dim
  GROUP BY p.seed, p.field_name, p.dim, p.operator, scale, "offset"),
errors AS (SELECT seed, field_name, operator, avg(curve_rel_error) AS curve_rel_error FROM scaled
  GROUP BY seed, field_name, operator)"""


def scaled_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.scale_offset(fx.curves(spark, sf_dir), summary_of(spark, sf_dir))


@query("F6", with_ctes(*CHAIN, SUMMARY, SCALED) + f"""SELECT seed, field_name, dim, operator,
  {sql_round('scale', 'curve_rel_error')}, {r6('"offset"')} AS "offset" FROM scaled""")
def scale_offset(spark, sf_dir):
    return rounds(scaled_of(spark, sf_dir), "scale", "offset", "curve_rel_error")


@query("F7 P16", with_ctes(*CHAIN, SUMMARY, SCALED) + f"""SELECT seed, count(*) AS n_fields_substituted,
  {r6('avg(curve_rel_error)')} AS curve_rel_error_mean, {r6('max(curve_rel_error)')} AS curve_rel_error_max,
  CASE WHEN avg(curve_rel_error) < 0.2 THEN 'faithful' WHEN avg(curve_rel_error) < 0.4 THEN 'fair' ELSE 'low' END AS verdict
  FROM errors GROUP BY seed""")
def curve_error_report(spark, sf_dir):
    out = extraction.curve_error_report(extraction.curve_errors(scaled_of(spark, sf_dir)))
    out = out.withColumn("verdict", fidelity_verdict(F.col("curve_rel_error_mean")))
    return rounds(out, "curve_rel_error_mean", "curve_rel_error_max")


FORMULAS = {
    "I1": ablation.Formula("sqrt", 0.08, -0.1, 0.9, 0.02),
    "4": ablation.Formula("linear", -1.5, 0.01, 1.1, -0.01),
    "I6": ablation.Formula("log", 3.0, 0.0, accepted=False),
}
SUB_SQL = """scored AS (SELECT label, p_click AS p, round(1e0 / (1e0 + exp(-(-0.7e0
  + (0.08e0 * sqrt(abs(least(I1, 10e0))) - 0.1e0) * 0.9e0 + 0.02e0 + (-1.5e0 * I5 + 0.01e0) * 1.1e0 - 0.01e0))), 9) AS q
  FROM impressions)"""


def auc_sql(score: str, name: str) -> str:
    return f"""{name}_levels AS (SELECT {score} AS s, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
  FROM scored GROUP BY {score}),
{name} AS (SELECT sum(pos * (before + 0.5e0 * neg)) / (sum(pos) * sum(neg)) AS v FROM (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before
  FROM {name}_levels))"""


@query("F8 J5", with_ctes(IMPRESSIONS, SUB_SQL, auc_sql("p", "auc_p"), auc_sql("q", "auc_q")) + f"""SELECT
  CAST(0 AS BIGINT) AS n_dropped, {r6('avg(-(label * ln(p) + (1 - label) * ln(1e0 - p)))')} AS logloss_original,
  {r6('avg(-(label * ln(q) + (1 - label) * ln(1e0 - q)))')} AS logloss_substituted,
  {r6('sqrt(avg(pow(p - q, 2)))')} AS prediction_rmse,
  {r6('(SELECT v FROM auc_p)')} AS auc_original, {r6('(SELECT v FROM auc_q)')} AS auc_substituted,
  {r6('(SELECT v FROM auc_p) - (SELECT v FROM auc_q)')} AS delta_auc FROM scored""")
def substitution_ablation(spark, sf_dir):
    terms = {c: dbl(0) for c in fx.NUMERIC}
    terms.update({"I1": dbl(0.01) * F.col("I1"), "I5": dbl(-2) * F.col("I5")})
    logit = dbl(-0.7) + terms["I1"] + terms["I5"]
    q = ablation.substituted_logit(logit, terms, FORMULAS)
    # scores rounded so that equal scores tie alike in both engines
    df = impressions(spark, sf_dir).select(
        "label",
        "p_click",
        F.round(dbl(1) / (dbl(1) + F.exp(-q)), 9).alias("q"),
    )
    out = ablation.ablation_report(df, "label", "p_click", "q")
    return rounds(out, *[c for c in out.columns if c != "n_dropped"])


#: The score with both formulas, and with one of them.
FIELD_SCORES = {
    "all": "(0.08e0 * sqrt(abs(least(I1, 10e0))) - 0.1e0) * 0.9e0 + 0.02e0 + (-1.5e0 * I5 + 0.01e0) * 1.1e0 - 0.01e0",
    "I1": "(0.08e0 * sqrt(abs(least(I1, 10e0))) - 0.1e0) * 0.9e0 + 0.02e0 - 2e0 * I5",
    "I5": "0.01e0 * I1 + (-1.5e0 * I5 + 0.01e0) * 1.1e0 - 0.01e0",
}
FIELD_SQL = with_ctes(
    IMPRESSIONS,
    "scored AS (SELECT label, p_click AS p, " + ", ".join(
        f"round(1e0 / (1e0 + exp(-(-0.7e0 + {x}))), 9) AS q_{f}" for f, x in FIELD_SCORES.items()) + " FROM impressions)",
    auc_sql("p", "auc_p"), *[auc_sql(f"q_{f}", f"auc_{f}") for f in FIELD_SCORES],
) + " UNION ALL ".join(f"""SELECT '{f}' AS field, CAST(0 AS BIGINT) AS n_dropped,
  {r6('avg(-(label * ln(p) + (1 - label) * ln(1e0 - p)))')} AS logloss_original,
  {r6(f'avg(-(label * ln(q_{f}) + (1 - label) * ln(1e0 - q_{f})))')} AS logloss_substituted,
  {r6(f'sqrt(avg(pow(p - q_{f}, 2)))')} AS prediction_rmse, {r6('(SELECT v FROM auc_p)')} AS auc_original,
  {r6(f'(SELECT v FROM auc_{f})')} AS auc_substituted,
  {r6(f'(SELECT v FROM auc_p) - (SELECT v FROM auc_{f})')} AS delta_auc FROM scored""" for f in FIELD_SCORES)


@query("F8 J5", FIELD_SQL)
def ablation_by_field(spark, sf_dir):
    """Both formulas substituted together, and each of them alone."""
    terms = {c: dbl(0) for c in fx.NUMERIC}
    terms.update({"I1": dbl(0.01) * F.col("I1"), "I5": dbl(-2) * F.col("I5")})
    logit = dbl(-0.7) + terms["I1"] + terms["I5"]
    usable = ablation.usable_formulas(FORMULAS, list(terms))
    names = {ablation.ALL_FIELDS: usable, **{f: {f: x} for f, x in usable.items()}}
    # scores rounded so that equal scores tie alike in both engines
    scores = [
        F.round(dbl(1) / (dbl(1) + F.exp(-ablation.substituted_logit(logit, terms, some))), 9).alias(f"q_{name}")
        for name, some in names.items()
    ]
    df = impressions(spark, sf_dir).select("label", "p_click", *scores)
    out = ablation.ablation_by_field(df, "label", "p_click", {name: f"q_{name}" for name in names})
    return rounds(out, *[c for c in out.columns if c not in ("field", "n_dropped")])


@query("F9", with_ctes(IMPRESSIONS) + f"""SELECT split,
  {r6('sqrt(avg(pow(p_click - 1e0 / (1e0 + exp(-(0.01e0 * I1 - 0.7e0 + (-2e0 * ln(abs(I5) + 1e0) + 0.05e0)))), 2)))')} AS gap_rmse
  FROM impressions GROUP BY split""")
def formula_gap(spark, sf_dir):
    score = extraction.additive_score([("I1", "linear", 0.01, -0.7), ("I5", "log", -2.0, 0.05)])
    return rounds(extraction.gap_rmse(impressions(spark, sf_dir), "p_click", score, ["split"]), "gap_rmse")


@query("F10", with_ctes(*CHAIN, SUMMARY) + """, placed AS (SELECT seed, accepted, formula,
  dense_rank() OVER (ORDER BY field_name) - 1 AS p FROM summary)
  SELECT seed, CASE WHEN count(*) FILTER (WHERE accepted) = 0 THEN 'No accepted operators found.' ELSE
  'ŷ ≈ f(' || string_agg('F' || CAST(p AS VARCHAR), ', ' ORDER BY p) FILTER (WHERE accepted) || ') where:' || chr(10) ||
  string_agg('  φ_F' || CAST(p AS VARCHAR) || '(x) ≈ ' || formula, chr(10) ORDER BY p) FILTER (WHERE accepted) END
  AS formula_text FROM placed GROUP BY seed""")
def scoring_text(spark, sf_dir):
    summary = summary_of(spark, sf_dir)
    # one row per field of a model
    placed = summary.select("field_name").distinct().withColumn("p", F.row_number().over(Window.orderBy("field_name")) - 1)
    return reports.field_formula_text(summary.join(placed, "field_name"), F.col("p"))


@query("F11", with_ctes(CURVES) + f"""SELECT seed, field_name, dim,
  {r6('1e0 - count(*) * var_pop(phi) * (1e0 - regr_r2(phi, x)) / (count(*) * var_pop(phi) + 1e-12)')} AS linear_r2
  FROM curves GROUP BY seed, field_name, dim""")
def curve_linearity(spark, sf_dir):
    return rounds(extraction.linear_r2(fx.curves(spark, sf_dir)), "linear_r2")


RESULT_NUMBERS = ("r2", "param_a", "param_b", "r2_mean", "r2_std", "r2_min", "operator_agreement")
RESULT_SQL = (
    "run_id, dataset, seed, field_name, encoder, operator, formula_str, is_accepted, n_dims_fitted, "
    + sql_round(*RESULT_NUMBERS)
)
RESULT_COLUMNS = [
    "run_id", "dataset", "seed", "field_name", "encoder", "operator", "formula_str", "is_accepted",
    "n_dims_fitted", *RESULT_NUMBERS,
]


@query("F12", with_ctes(*CHAIN, SUMMARY, RESULTS) + f"SELECT {RESULT_SQL} FROM results")
def formula_results(spark, sf_dir):
    return rounds(results_of(spark, sf_dir).select(*RESULT_COLUMNS), *RESULT_NUMBERS)


@query("S13", with_ctes(*CHAIN, SUMMARY, RESULTS) + f"SELECT {RESULT_SQL} FROM results")
def flatten_results_document(spark, sf_dir):
    """Fits to a nested JSON document per seed, and back to result rows."""
    fit = F.struct(
        "operator", F.array("param_a", "param_b").alias("params"), "formula", "accepted",
        F.col("r2_mean").alias("r2"), "r2_mean", "r2_std", "r2_min", "operator_agreement", "n_dims_fitted",
    )
    fields = F.map_from_entries(F.collect_list(F.struct("field_name", fit)))  # one entry per field
    nested = summary_of(spark, sf_dir).groupBy("seed").agg(fields.alias("fields"))
    text = nested.select(
        F.to_json(F.struct(F.create_map(F.col("seed").cast("string"), F.col("fields")).alias("results_by_seed"))).alias("doc")
    )
    documents = text.select(F.from_json("doc", FORMULA_DOCUMENT).alias("d")).select("d.*")
    rows = result_rows(
        flatten_document(documents), F.concat(F.lit("run-s"), F.col("seed").cast("string")), F.lit(DATASET)
    )
    return rounds(rows.select(*RESULT_COLUMNS), *RESULT_NUMBERS)


# ── formula reports ─────────────────────────────────────────────────────────

OPERATOR_MODE = """accepted AS (SELECT * FROM results WHERE is_accepted),
mode_counts AS (SELECT field_name, operator, count(*) AS n, min(seed) AS s FROM accepted GROUP BY field_name, operator),
stability AS (SELECT field_name, arg_min(operator, s - 1000 * n) AS operator, max(n) AS seeds_agreeing,
  (SELECT count(DISTINCT seed) FROM results) AS n_seeds FROM mode_counts GROUP BY field_name)"""
REPORT = with_ctes(*CHAIN, SUMMARY, RESULTS, OPERATOR_MODE)
SEEDS = [0, 1, 2]


@query("R1", REPORT + f"""SELECT field_name, operator, seeds_agreeing, n_seeds,
  {r6('seeds_agreeing / CAST(n_seeds AS DOUBLE)')} AS stability, n_seeds < 2 AS is_trivial FROM stability""")
def dominant_stability(spark, sf_dir):
    return rounds(reports.dominant_stability(results_of(spark, sf_dir)), "stability")


@query("R2 W6", REPORT + f"""SELECT field_name AS field, operator, count(*) AS seeds_count,
  {r6('count(*) / 3e0')} AS stability_pct, {r6('avg(r2)', 4)} AS avg_r2, CAST(NULL AS DOUBLE) AS avg_gap_rmse
  FROM accepted GROUP BY field_name, operator""")
def operator_stability(spark, sf_dir):
    out = reports.operator_stability(results_of(spark, sf_dir), DATASET, SEEDS)
    return rounds(out, "stability_pct", "avg_r2")


@query("R3 A8", REPORT + f"""SELECT field_name, list_sort(list(DISTINCT operator)) AS operators, {r6('avg(r2)')} AS avg_r2,
  count(*) AS n_seeds, count(DISTINCT operator) AS n_operators, count(DISTINCT operator) = 1 AS is_stable
  FROM accepted GROUP BY field_name""")
def operator_sets(spark, sf_dir):
    return rounds(reports.operator_sets(results_of(spark, sf_dir)), "avg_r2")


@query("R4 G3", REPORT + f"""SELECT s.field_name, operator, seeds_agreeing, n_seeds,
  {r6('seeds_agreeing / CAST(n_seeds AS DOUBLE)')} AS stability, {r6('r2_mean')} AS r2_mean FROM stability s
  JOIN (SELECT field_name, avg(r2) AS r2_mean FROM results GROUP BY field_name) m ON s.field_name = m.field_name""")
def full_stability(spark, sf_dir):
    results = reports.require_accepted(results_of(spark, sf_dir))
    return rounds(reports.full_stability(results), "stability", "r2_mean")


@query("R4", REPORT + f"""SELECT count(*) AS n_fields, count(*) FILTER (WHERE seeds_agreeing = n_seeds) AS n_perfect,
  {r6('avg(seeds_agreeing / CAST(n_seeds AS DOUBLE))')} AS mean_stability FROM stability""")
def stability_totals(spark, sf_dir):
    out = reports.stability_totals(reports.full_stability(results_of(spark, sf_dir)))
    return rounds(out, "mean_stability")


@query("R5", REPORT + f"""SELECT dataset, operator, count(*) AS count, {r6('avg(r2)')} AS avg_r2 FROM accepted
  WHERE field_name = 'click' GROUP BY dataset, operator""")
def cross_dataset(spark, sf_dir):
    return rounds(reports.cross_dataset(results_of(spark, sf_dir), "click"), "avg_r2")


@query("R6 W5", REPORT + f"""SELECT dataset, field_name, seed, operator, formula_str, {r6('r2')} AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, field_name ORDER BY r2 DESC, seed) AS rn FROM accepted) WHERE rn = 1""")
def best_formulas(spark, sf_dir):
    out = reports.best_formulas(results_of(spark, sf_dir))
    return rounds(out.select("dataset", "field_name", "seed", "operator", "formula_str", "r2"), "r2")


@query("F10 J3", REPORT + f""", lead_rows AS (SELECT field_name, operator, count(*) AS n, round(avg(r2), 4) AS r FROM accepted
  GROUP BY field_name, operator),
leaders AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY n DESC, operator) AS rn FROM lead_rows),
bests AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY r2 DESC, seed) AS rn FROM accepted)
SELECT 'ŷ ≈ f(' || string_agg(l.field_name, ', ' ORDER BY l.field_name) || ') where:' || chr(10) ||
  string_agg('  φ_' || l.field_name || '(x) ≈ ' || b.formula_str || '   [stability ' || CAST(l.n AS VARCHAR) || '/3  R²=' ||
  {number_sql('l.r')} || ']', chr(10) ORDER BY l.field_name) AS scoring_formula
FROM leaders l JOIN bests b ON l.field_name = b.field_name WHERE l.rn = 1 AND b.rn = 1""")
def scoring_summary(spark, sf_dir):
    return reports.scoring_summary(results_of(spark, sf_dir), DATASET, SEEDS)


@query("R7", with_ctes(*CHAIN, SUMMARY, SCALED) + f""", per_seed AS (SELECT seed, avg(curve_rel_error) AS e,
  min(curve_rel_error) AS d FROM errors GROUP BY seed)
SELECT count(*) AS n_seeds, {r6('avg(e)')} AS curve_error_mean, {r6('stddev_samp(e)')} AS curve_error_std,
  {r6('avg(d)')} AS delta_auc_mean, {r6('stddev_samp(d)')} AS delta_auc_std FROM per_seed""")
def fidelity_summary(spark, sf_dir):
    errors = extraction.curve_errors(scaled_of(spark, sf_dir))
    smallest = errors.groupBy("seed").agg(F.min("curve_rel_error").alias("delta_auc"))
    out = reports.fidelity_summary(extraction.curve_error_report(errors).join(smallest, "seed"))
    return rounds(out, "curve_error_mean", "curve_error_std", "delta_auc_mean", "delta_auc_std")


@query("R7", with_ctes(CURVES, STEPS, monotone_sql(OWN)) + f"""SELECT seed,
  count(*) FILTER (WHERE violation_rate < 0.05) AS n_monotone, count(*) AS n_fields,
  {r6('avg(violation_rate)')} AS violation_mean FROM monotone GROUP BY seed""")
def monotone_summary(spark, sf_dir):
    out = reports.monotone_summary(extraction.monotonicity(fx.curves(spark, sf_dir)))
    return rounds(out, "violation_mean")


# ── experiment reports and timings ──────────────────────────────────────────

ENCODER_SQL = f"""SELECT encoder, count(*) AS n_seeds, {r6('avg(test_auc)')} AS auc_mean,
  {r6('stddev_samp(test_auc)')} AS auc_std, {r6('avg(test_logloss)')} AS logloss_mean,
  {r6('stddev_samp(test_logloss)')} AS logloss_std FROM experiments GROUP BY encoder"""


@query("A5", with_ctes(EXPERIMENTS) + ENCODER_SQL)
def encoder_summary(spark, sf_dir):
    out = reports.encoder_summary(fx.experiments(spark, sf_dir))
    return rounds(out, "auc_mean", "auc_std", "logloss_mean", "logloss_std")


@query("A5 P15 W6", with_ctes(EXPERIMENTS) + f"""SELECT encoder, {r6('avg(test_auc)', 4)} AS auc_mean,
  {r6('stddev_samp(test_auc)', 4)} AS auc_std, {r6('avg(test_logloss)', 4)} AS logloss_mean, count(*) AS n_seeds
  FROM experiments GROUP BY encoder""")
def encoder_ranking(spark, sf_dir):
    return reports.encoder_ranking(reports.encoder_summary(fx.experiments(spark, sf_dir)))


@query("A13", with_ctes(EXPERIMENTS) + f"""SELECT {r6("avg(test_auc) FILTER (WHERE encoder = 'Brand#11')")} AS left_mean,
  {r6("avg(test_auc) FILTER (WHERE encoder = 'Brand#12')")} AS right_mean,
  {r6("avg(test_auc) FILTER (WHERE encoder = 'Brand#11') - avg(test_auc) FILTER (WHERE encoder = 'Brand#12')")} AS difference
  FROM experiments""")
def encoder_difference(spark, sf_dir):
    out = reports.encoder_difference(fx.experiments(spark, sf_dir), "Brand#11", "Brand#12")
    return rounds(out, "left_mean", "right_mean", "difference")


@query("A13", with_ctes(EXPERIMENTS) + f"""SELECT dataset, encoder, {r6('avg(test_auc)')} AS mean_value FROM experiments
  GROUP BY dataset, encoder""")
def mean_by_dataset(spark, sf_dir):
    return rounds(reports.mean_by_dataset(fx.experiments(spark, sf_dir)), "mean_value")


@query("A13", REPORT + f"""SELECT count(*) AS n_results,
  {r6('count(*) FILTER (WHERE is_accepted) / CAST(count(*) AS DOUBLE)')} AS accepted_share,
  {r6('avg(r2) FILTER (WHERE is_accepted)')} AS r2_mean_accepted FROM results""")
def accepted_share(spark, sf_dir):
    return rounds(reports.accepted_share(results_of(spark, sf_dir)), "accepted_share", "r2_mean_accepted")


@query("A8", with_ctes(IMPRESSIONS) + """SELECT C5, list_sort(list(DISTINCT C4)) AS "values",
  count(DISTINCT C4) AS n_values FROM impressions GROUP BY C5""")
def distinct_sets(spark, sf_dir):
    return reports.collapse_sets(impressions(spark, sf_dir), ["C5"], "C4")


TIMING_SQL = """timing AS (SELECT encoder, count(*) AS n_runs, avg(full_ms) AS full_ms_mean, stddev_pop(full_ms) AS full_ms_std,
  quantile_cont(full_ms, 0.5) AS full_ms_p50, quantile_cont(full_ms, 0.95) AS full_ms_p95, avg(encoder_ms) AS encoder_ms_mean,
  stddev_pop(encoder_ms) AS encoder_ms_std, quantile_cont(encoder_ms, 0.95) AS encoder_ms_p95,
  avg(encoder_ms) / avg(full_ms) AS encoder_share, 4096000e0 / avg(full_ms) AS rows_per_s FROM timings GROUP BY encoder)"""
TIMING_NUMBERS = (
    "full_ms_mean", "full_ms_std", "full_ms_p50", "full_ms_p95", "encoder_ms_mean", "encoder_ms_std",
    "encoder_ms_p95", "encoder_share", "rows_per_s",
)


def timing_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timing_summary(fx.timings(spark, sf_dir), ["encoder"], 4096)


@query("A12", with_ctes(TIMINGS, TIMING_SQL) + f"SELECT encoder, n_runs, {sql_round(*TIMING_NUMBERS)} FROM timing")
def timing_summary(spark, sf_dir):
    return rounds(timing_of(spark, sf_dir), *TIMING_NUMBERS)


@query("A14", with_ctes(TIMINGS, TIMING_SQL) + f"""SELECT encoder,
  {r6('full_ms_mean / (SELECT min(full_ms_mean) FROM timing)')} AS vs_fastest FROM timing""")
def versus_fastest(spark, sf_dir):
    out = reports.versus_fastest(timing_of(spark, sf_dir)).select("encoder", "vs_fastest")
    return rounds(out, "vs_fastest")


@query("A14", with_ctes(TIMINGS, TIMING_SQL) + f"""SELECT a.encoder AS numerator, b.encoder AS denominator,
  {r6('a.full_ms_mean / b.full_ms_mean')} AS ratio FROM timing a JOIN timing b
  ON (a.encoder, b.encoder) IN (('click', 'view'), ('view', 'purchase'))""")
def ratio_pairs(spark, sf_dir):
    out = reports.ratio_pairs(timing_of(spark, sf_dir), "encoder", [("click", "view"), ("view", "purchase")])
    return rounds(out, "ratio")


@query("K7", with_ctes(TIMINGS, TIMING_SQL, EXPERIMENTS) + f"""SELECT t.encoder, {sql_round('full_ms_mean')}, {r6('auc_mean')} AS auc_mean
  FROM timing t JOIN (SELECT dataset AS encoder, avg(test_auc) AS auc_mean FROM
  (SELECT CASE WHEN dataset = 'even' THEN 'click' ELSE 'view' END AS dataset, test_auc FROM experiments) GROUP BY dataset) e
  ON t.encoder = e.encoder""")
def latency_versus_auc(spark, sf_dir):
    from tidemark.plans.monitoring import latency_versus_auc as versus

    named = fx.experiments(spark, sf_dir).withColumn(
        "encoder", F.when(F.col("dataset") == "even", "click").otherwise("view")
    )
    out = versus(timing_of(spark, sf_dir), reports.encoder_summary(named))
    return rounds(out, "full_ms_mean", "auc_mean")


@query("K7", with_ctes(EXPERIMENTS) + f"""SELECT grid_size, {r6('test_auc')} AS test_auc,
  CAST(row_number() OVER (ORDER BY test_auc DESC, grid_size) AS INT) AS auc_rank FROM (
  SELECT (seed + 1) * 5 AS grid_size, avg(test_auc) AS test_auc FROM experiments GROUP BY seed)""")
def grid_size_table(spark, sf_dir):
    from tidemark.plans.monitoring import grid_size_table as table_of

    named = fx.experiments(spark, sf_dir).withColumn("grid_size", (F.col("seed") + 1) * 5)
    return rounds(table_of(named), "test_auc")


@query("U2", with_ctes(EXPERIMENTS) + f"""SELECT encoder, {sql_round('test_auc')}, epochs, CAST(NULL AS VARCHAR) AS device FROM experiments
  UNION ALL SELECT p_type, NULL, NULL, p_brand FROM part WHERE p_size = 1""")
def add_rows(spark, sf_dir):
    results = rounds(fx.experiments(spark, sf_dir).select("encoder", "test_auc", "epochs"), "test_auc")
    more = fx.table(spark, sf_dir, "part").filter("p_size = 1").select(
        F.col("p_type").alias("encoder"), F.col("p_brand").alias("device")
    )
    return reports.add_rows(results, more)


@query("W5", REPORT + """, c AS (SELECT field_name, operator, count(*) AS n FROM accepted GROUP BY field_name, operator)
  SELECT field_name, operator, n AS n_seeds FROM (SELECT *, row_number() OVER (PARTITION BY field_name
  ORDER BY n DESC, operator) AS rn FROM c) WHERE rn = 1""")
def dominant_operator(spark, sf_dir):
    from tidemark.plans.monitoring import dominant_operator as dominant

    return dominant(results_of(spark, sf_dir))
