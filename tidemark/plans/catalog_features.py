"""Queries: normalisation, encoding, sampling, plain aggregates."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp_index, dbl, is_finite, rounded, winsorise
from tidemark.operators import encode, normalise, sampling
from tidemark.operators.metrics import positive_rate as positive_rate_of
from tidemark.operators.ordered import exact_quantiles
from tidemark.operators.drift import bin_counts
from tidemark.plans import fixtures as fx
from tidemark.plans.fixtures import (
    CATEGORIES, IMPRESSIONS, ITEM_METADATA, LOG, NUMERIC, STD, impressions, r6, with_ctes,
)
from tidemark.plans.ingest import distinct_values as distinct_values_of
from tidemark.plans.ingest import enrich_with_metadata, fit_artifacts
from tidemark.plans.registry import query
from tidemark.session import scratch_path

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey"


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impressions(spark, sf_dir).filter(F.col("split") == "train")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.impute_and_log(impressions(spark, sf_dir), NUMERIC, LOG)


PREPARED = (
    "prepared AS (SELECT l_orderkey, l_linenumber, l_partkey, label, split, batch_id, p_click, "
    + ", ".join(CATEGORIES)
    + ", "
    + ", ".join(f"ln(1e0 + coalesce(abs({c}), 0e0)) AS {c}" for c in LOG)
    + ", "
    + ", ".join(f"coalesce(abs({c}), 0e0) AS {c}" for c in STD)
    + " FROM impressions)"
)
SCALER = (
    "scaler AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in STD)
    + " FROM prepared WHERE split = 'train')"
)
NORMED = (
    "normed AS (SELECT l_orderkey, l_linenumber, l_partkey, label, split, batch_id, p_click, "
    + ", ".join(CATEGORIES)
    + ", "
    + ", ".join(LOG)
    + ", "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in STD)
    + " FROM prepared CROSS JOIN scaler)"
)


def maps_sql(columns: list[str] = CATEGORIES, nulls: str = "", source: str = "impressions") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {source} "
        f"WHERE split = 'train' {nulls.format(c=c)} GROUP BY {c}"
        for c in columns
    )
    return (
        'maps AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" '
        f"ORDER BY n DESC, value ASC NULLS FIRST) - 1 AS idx FROM ({parts}))"
    )


def encoded_sql(source: str, columns: list[str] = CATEGORIES) -> str:
    joins = " ".join(
        f"LEFT JOIN maps {c}m ON {c}m.\"column\" = '{c}' AND {c}m.value = s.{c}" for c in columns
    )
    picks = ", ".join(
        f"CAST(coalesce({c}m.idx, (SELECT count(*) FROM maps WHERE \"column\" = '{c}')) AS INT) AS {c}_idx"
        for c in columns
    )
    return f"encoded AS (SELECT s.*, {picks} FROM {source} s {joins})"


# ── projections and scalar functions ────────────────────────────────────────


@query("P1", with_ctes(IMPRESSIONS, PREPARED) + f"SELECT {KEYS_SQL}, "
       + ", ".join(f"{r6(c)} AS {c}" for c in NUMERIC) + " FROM prepared")
def impute_and_log(spark, sf_dir):
    return _prepared(spark, sf_dir).select(*KEYS, *[rounded(F.col(c)).alias(c) for c in NUMERIC])


@query("P2", with_ctes(IMPRESSIONS) + f"SELECT {KEYS_SQL}, "
       + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}_is_null" for c in NUMERIC)
       + " FROM impressions")
def missing_indicators(spark, sf_dir):
    flagged = normalise.missing_indicators(impressions(spark, sf_dir), NUMERIC)
    return flagged.select(*KEYS, *[f"{c}_is_null" for c in NUMERIC])


@query("P3 A1", with_ctes(IMPRESSIONS, PREPARED, SCALER, NORMED) + f"SELECT {KEYS_SQL}, split, "
       + ", ".join(f"{r6(c)} AS {c}" for c in STD) + " FROM normed")
def standardise(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    stats = normalise.fit_scaler(prepared.filter(F.col("split") == "train"), STD)
    scaled = normalise.apply_scaler(prepared, stats, STD)
    return scaled.select(*KEYS, "split", *[rounded(F.col(c)).alias(c) for c in STD])


@query("P4", with_ctes(IMPRESSIONS, PREPARED, SCALER, NORMED) + f"SELECT {KEYS_SQL}, "
       + ", ".join(f"{r6(c)} AS {c}" for c in STD) + " FROM normed")
def apply_fitted_stages(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    stages = Pipeline(
        stages=[
            VectorAssembler(inputCols=STD, outputCol="num_raw"),
            StandardScaler(inputCol="num_raw", outputCol="num_scaled", withMean=True),
        ]
    )
    model = stages.fit(prepared.filter(F.col("split") == "train").select(*STD))
    out = normalise.apply_fitted_stages(prepared, model, STD)
    return out.select(*KEYS, *[rounded(F.col(c)).alias(c) for c in STD])


@query("P5", with_ctes(IMPRESSIONS) + f"""SELECT {KEYS_SQL},
  {r6('greatest(least((I6 - 4000e0) / 300e0, 10e0), -10e0)')} AS clipped FROM impressions""")
def winsorised(spark, sf_dir):
    z = (F.col("I6") - dbl(4000)) / dbl(300)
    return impressions(spark, sf_dir).select(*KEYS, rounded(winsorise(z)).alias("clipped"))


@query("P6", with_ctes(IMPRESSIONS) + f"""SELECT {KEYS_SQL}, CAST(I1 AS INT) - 10 AS idx,
  greatest(least(CAST(I1 AS INT) - 10, 29), 0) AS clamped FROM impressions""")
def clamp_indices(spark, sf_dir):
    idx = F.col("I1").cast("int") - 10
    return impressions(spark, sf_dir).select(
        *KEYS, idx.alias("idx"), clamp_index(idx, 30).alias("clamped")
    )


@query("P6", with_ctes(IMPRESSIONS) + """SELECT count(*) AS n_rows,
  CAST(sum(CASE WHEN I1 - 10 < 0 OR I1 - 10 >= 30 OR I2 - 2 < 0 OR I2 - 2 >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_clamped
  FROM impressions""")
def clamp_counts(spark, sf_dir):
    df = impressions(spark, sf_dir).select(
        (F.col("I1").cast("int") - 10).alias("a_idx"), (F.col("I2").cast("int") - 2).alias("b_idx")
    )
    return encode.clamp_report(df, {"a_idx": 30, "b_idx": 4})


@query("P7", with_ctes(IMPRESSIONS) + f"""SELECT {KEYS_SQL}, coalesce(I3, 0e0) AS I3,
  coalesce(CASE WHEN C2 IS NOT NULL THEN CAST(I2 AS INT) END, 0) AS c2_idx FROM impressions""")
def fill_model_inputs(spark, sf_dir):
    idx = F.when(F.col("C2").isNotNull(), F.col("I2").cast("int"))
    gaps = impressions(spark, sf_dir).withColumns(
        {"I3": F.coalesce("I3", dbl(float("nan"))), "c2_idx": idx}
    )
    return normalise.fill_model_inputs(gaps, ["I3"], ["c2_idx"]).select(*KEYS, "I3", "c2_idx")


@query("P9", with_ctes(IMPRESSIONS) + f"""SELECT {KEYS_SQL}, I1 AS quantity, 'I1' AS "column",
  CAST(7 AS BIGINT) AS batch_id, 'model@0123456789ab' AS model FROM impressions""")
def rename_and_tag(spark, sf_dir):
    df = impressions(spark, sf_dir).select(*KEYS, "I1").withColumnRenamed("I1", "quantity")
    return df.withColumns(
        {"column": F.lit("I1"), "batch_id": F.lit(7).cast("long"), "model": F.lit("model@0123456789ab")}
    )


@query("P10 P15", with_ctes(IMPRESSIONS) + f"""SELECT {KEYS_SQL}, C2, {r6('ln(I6)', 4)} AS log_i6
  FROM impressions WHERE C2 IS NOT NULL AND C1 = 'O' AND I3 IS NOT NULL AND I6 > 0""")
def filters(spark, sf_dir):
    df = impressions(spark, sf_dir).withColumn(
        "log_i6", F.when(F.col("I6") > 0, F.log("I6")).otherwise(dbl(float("nan")))
    )
    kept = df.filter(
        F.col("C2").isNotNull() & (F.col("C1") == "O") & is_finite(F.col("I3")) & is_finite(F.col("log_i6"))
    )
    return kept.select(*KEYS, "C2", rounded(F.col("log_i6"), 4).alias("log_i6"))


@query("T3", with_ctes(IMPRESSIONS, maps_sql(), PREPARED, SCALER, NORMED, encoded_sql("normed"))
       + f"SELECT {KEYS_SQL}, split, " + ", ".join(f"{r6(c)} AS {c}" for c in NUMERIC) + ", "
       + ", ".join(f"{c}_idx" for c in CATEGORIES) + " FROM encoded")
def normalise_like_train(spark, sf_dir):
    artifacts = fit_artifacts(_train(spark, sf_dir), LOG, STD, CATEGORIES)
    out = artifacts.apply(impressions(spark, sf_dir))
    return out.select(
        *KEYS, "split", *[rounded(F.col(c)).alias(c) for c in NUMERIC], *artifacts.index_columns
    )


# ── joins ───────────────────────────────────────────────────────────────────


@query("J2 P8", with_ctes(IMPRESSIONS, ITEM_METADATA) + f"""SELECT {KEYS_SQL}, label,
  {r6('coalesce(price_usd, 0e0)')} AS price_usd, {r6('coalesce(popularity_score, 0.5e0)')} AS popularity_score,
  coalesce(days_since_listing, 365) AS days_since_listing, coalesce(avg_rating, 3e0) AS avg_rating
  FROM impressions LEFT JOIN item_metadata ON l_partkey = item_id""")
def enrich_items(spark, sf_dir):
    df = impressions(spark, sf_dir)
    out = enrich_with_metadata(
        df, fx.item_metadata(spark, sf_dir), "l_partkey", ["l_orderkey", "l_linenumber", "label"]
    )
    return out.withColumns(
        {c: rounded(F.col(c)) for c in ("price_usd", "popularity_score")}
    )


# ── categorical encoding ────────────────────────────────────────────────────


@query("C1 C3 W1", with_ctes(IMPRESSIONS, maps_sql()) + 'SELECT "column", value, idx FROM maps')
def index_maps(spark, sf_dir):
    return encode.build_index_maps(_train(spark, sf_dir), CATEGORIES).table


@query("C1", with_ctes(IMPRESSIONS, maps_sql(nulls="AND {c} IS NOT NULL"))
       + 'SELECT "column", value, idx FROM maps')
def index_maps_without_null(spark, sf_dir):
    return encode.build_index_maps(_train(spark, sf_dir), CATEGORIES, null_rank=False).table


@query("C2 J1", with_ctes(IMPRESSIONS, maps_sql(), encoded_sql("impressions"))
       + f"SELECT {KEYS_SQL}, " + ", ".join(f"{c}_idx" for c in CATEGORIES) + " FROM encoded")
def apply_index_maps(spark, sf_dir):
    maps = encode.build_index_maps(_train(spark, sf_dir), CATEGORIES)
    out = encode.apply_index_maps(impressions(spark, sf_dir), maps, CATEGORIES)
    return out.select(*KEYS, *[f"{c}_idx" for c in CATEGORIES])


@query("C2 J1", with_ctes(IMPRESSIONS, maps_sql(), encoded_sql("impressions"))
       + f"SELECT {KEYS_SQL}, C2_idx, C3_idx FROM encoded")
def apply_large_index_maps(spark, sf_dir):
    """The plan cut after every column, as many or large maps need."""
    maps = encode.build_index_maps(_train(spark, sf_dir), ["C2", "C3"])
    out = encode.apply_index_maps(
        impressions(spark, sf_dir), maps, ["C2", "C3"], chunk=1, materialize=encode.materialize_to_table,
    )
    return out.select(*KEYS, "C2_idx", "C3_idx")


@query("C2 C3", with_ctes(IMPRESSIONS, maps_sql(), encoded_sql("impressions"))
       + f"SELECT {KEYS_SQL}, " + ", ".join(f"{c}_idx" for c in CATEGORIES) + " FROM encoded")
def index_maps_reloaded(spark, sf_dir):
    """Maps saved to a path and loaded again, as the stream does."""
    path = scratch_path(spark, "saved-maps")
    encode.save_index_maps(encode.build_index_maps(_train(spark, sf_dir), CATEGORIES), path)
    maps = encode.load_index_maps(spark, path, CATEGORIES)
    out = encode.apply_index_maps(impressions(spark, sf_dir), maps, CATEGORIES)
    return out.select(*KEYS, *[f"{c}_idx" for c in CATEGORIES])


@query("C2 J1", with_ctes(
    IMPRESSIONS, maps_sql(),
    "hot AS (SELECT * REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN C3 ELSE 'launched today' END AS C3) FROM impressions)",
    encoded_sql("hot")) + f"SELECT {KEYS_SQL}, C3_idx FROM encoded")
def hot_unseen_value(spark, sf_dir):
    """Two thirds of the rows hold one value that training never saw."""
    maps = encode.build_index_maps(_train(spark, sf_dir), ["C3"])
    hot = impressions(spark, sf_dir).withColumn(
        "C3", F.when(F.col("l_linenumber") % 3 == 0, F.col("C3")).otherwise("launched today"))
    return encode.apply_index_maps(hot, maps, ["C3"]).select(*KEYS, "C3_idx")


@query("C2 C1 J1", with_ctes(
    IMPRESSIONS, fx.WIDE, maps_sql(fx.WIDE_CATEGORIES, source="wide"), encoded_sql("wide", fx.WIDE_CATEGORIES))
    + f"SELECT {KEYS_SQL}, " + ", ".join(f"{c}_idx" for c in fx.WIDE_CATEGORIES) + " FROM encoded")
def wide_index_maps(spark, sf_dir):
    """13 numbers and 26 categories, every category encoded in one pass."""
    df = fx.wide_impressions(spark, sf_dir)
    maps = encode.build_index_maps(df.filter(F.col("split") == "train"), fx.WIDE_CATEGORIES)
    out = encode.apply_index_maps_wide(df, maps, fx.WIDE_CATEGORIES, at_once=500_000)
    return out.select(*KEYS, *[f"{c}_idx" for c in fx.WIDE_CATEGORIES])


@query("C4", with_ctes(IMPRESSIONS, maps_sql()) + 'SELECT "column", count(*) AS n FROM maps GROUP BY "column"')
def index_map_sizes(spark, sf_dir):
    return encode.map_sizes(encode.build_index_maps(_train(spark, sf_dir), CATEGORIES).table)


@query("C5 U1", with_ctes(IMPRESSIONS, maps_sql(), encoded_sql("impressions")) + "SELECT "
       + ", ".join(f"CAST(max({c}_idx) + 1 AS BIGINT) AS {c}_idx" for c in CATEGORIES) + " FROM encoded")
def index_cardinalities(spark, sf_dir):
    maps = encode.build_index_maps(_train(spark, sf_dir), CATEGORIES)
    united = encode.union_of_maps({c: maps.slice(c) for c in CATEGORIES})
    again = encode.IndexMaps(united, maps.sizes)
    out = encode.apply_index_maps(impressions(spark, sf_dir), again, CATEGORIES)
    splits = [out.filter(F.col("split") == s) for s in ("train", "val", "test")]
    return encode.cardinalities(splits, [f"{c}_idx" for c in CATEGORIES])


@query("C6", with_ctes(IMPRESSIONS, maps_sql(), encoded_sql("impressions")) + "SELECT "
       + ", ".join(f"CAST(sum(CASE WHEN {c}_idx >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS {c}_idx" for c in CATEGORIES)
       + " FROM encoded WHERE split <> 'train'")
def index_overflow(spark, sf_dir):
    maps = encode.build_index_maps(_train(spark, sf_dir), CATEGORIES)
    rest = impressions(spark, sf_dir).filter(F.col("split") != "train")
    out = encode.apply_index_maps(rest, maps, CATEGORIES)
    return encode.index_overflow(out, {f"{c}_idx": 4 for c in CATEGORIES})


# ── aggregates ──────────────────────────────────────────────────────────────


@query("A1", with_ctes(IMPRESSIONS, PREPARED) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std
    FROM prepared WHERE split = 'train'""" for c in STD))
def scaler_statistics(spark, sf_dir):
    train = _prepared(spark, sf_dir).filter(F.col("split") == "train")
    out = normalise.scaler_table(train, STD)
    return out.select("column", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query("A2", with_ctes(IMPRESSIONS) + "SELECT split, count(*) AS n_rows FROM impressions GROUP BY split")
def split_counts(spark, sf_dir):
    return impressions(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"))


def _describe_sql() -> str:
    measures = {"count": "CAST(count({c}) AS DOUBLE)", "mean": "avg({c})", "stddev": "stddev_samp({c})",
                "min": "min({c})", "max": "max({c})"}
    return with_ctes(IMPRESSIONS) + " UNION ALL ".join(
        f"SELECT '{m}' AS summary, " + ", ".join(f"{r6(e.format(c=c), 4)} AS {c}" for c in NUMERIC)
        + " FROM impressions" for m, e in measures.items()
    )


@query("A3", _describe_sql())
def describe_columns(spark, sf_dir):
    out = impressions(spark, sf_dir).select(*NUMERIC).describe()
    return out.select("summary", *[rounded(F.col(c).cast("double"), 4).alias(c) for c in NUMERIC])


@query("A4", with_ctes(IMPRESSIONS) + "SELECT " + ", ".join(f"max({c}) AS {c}" for c in NUMERIC)
       + " FROM impressions")
def column_maxima(spark, sf_dir):
    return impressions(spark, sf_dir).agg(*[F.max(c).alias(c) for c in NUMERIC])


@query("A6 O4", with_ctes(IMPRESSIONS) + f"""SELECT split, count(*) AS n_rows,
  {r6('avg(CAST(label AS DOUBLE))')} AS positive_rate FROM impressions GROUP BY split""")
def positive_rate(spark, sf_dir):
    out = positive_rate_of(impressions(spark, sf_dir), keys=["split"])
    return out.withColumn("positive_rate", rounded(F.col("positive_rate")))


@query("A7", with_ctes(IMPRESSIONS) + "SELECT DISTINCT C2 FROM impressions WHERE C2 IS NOT NULL")
def distinct_values(spark, sf_dir):
    return distinct_values_of(impressions(spark, sf_dir), "C2")


PROBS = [0.1, 0.25, 0.5, 0.75, 0.95]


@query("A10", with_ctes(IMPRESSIONS) + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS n, "
    + ", ".join(f"{r6(f'quantile_cont({c}, {p})')} AS q{int(p * 100)}" for p in PROBS)
    + " FROM impressions" for c in NUMERIC))
def exact_field_quantiles(spark, sf_dir):
    out = exact_quantiles(impressions(spark, sf_dir), NUMERIC, PROBS)
    picks = [rounded(F.col("quantiles")[i]).alias(f"q{int(p * 100)}") for i, p in enumerate(PROBS)]
    return out.select("field", "n", *picks)


@query("A10", with_ctes(IMPRESSIONS) + " UNION ALL ".join(
    f"SELECT batch_id, '{c}' AS field, {r6(f'quantile_cont({c}, 0.5)')} AS median "
    f"FROM impressions GROUP BY batch_id" for c in NUMERIC))
def exact_batch_medians(spark, sf_dir):
    out = exact_quantiles(impressions(spark, sf_dir), NUMERIC, [0.5], ["batch_id"])
    return out.select("batch_id", "field", rounded(F.col("quantiles")[0]).alias("median"))


EDGES = {"I1": [0.5, 10.5, 20.5, 30.5, 50.0], "I5": [0.005, 0.025, 0.055, 0.1]}


def _histogram_sql() -> str:
    out = []
    for f, e in EDGES.items():
        for i, (a, b) in enumerate(zip(e, e[1:])):
            upper = "<=" if i == len(e) - 2 else "<"
            out.append(
                f"SELECT '{f}' AS field, CAST({i} AS INT) AS bin, CAST(count(*) FILTER (WHERE {f} >= {a}e0 "
                f"AND {f} {upper} {b}e0) AS DOUBLE) AS n_values FROM impressions"
            )
    return with_ctes(IMPRESSIONS) + " UNION ALL ".join(out)


@query("A11", _histogram_sql())
def histogram(spark, sf_dir):
    out = bin_counts(impressions(spark, sf_dir), EDGES)
    return out.select("field", F.posexplode("counts").alias("bin", "n_values"))


# ── sampling and splitting ──────────────────────────────────────────────────


@query("O2", with_ctes(IMPRESSIONS) + f"SELECT {KEYS_SQL}, split FROM impressions")
def split_by_key(spark, sf_dir):
    df = impressions(spark, sf_dir).drop("split")
    return sampling.split_by_key(df, "l_orderkey", hashed=False).select(*KEYS, "split")


#: A row's number in [0, 1) from its keys, as the samples draw it.
DRAWN_SQL = ("CAST('0x' || substr(md5(concat_ws(':', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
             f"CAST(l_partkey AS VARCHAR))), 1, 13) AS BIGINT) / {16**13}e0")


@query("O1 O4", with_ctes(IMPRESSIONS) + f"SELECT {KEYS_SQL}, label FROM impressions ORDER BY {DRAWN_SQL} LIMIT 2000")
def random_sample(spark, sf_dir):
    """Exactly 2,000 rows, the same in every run."""
    return sampling.random_sample(impressions(spark, sf_dir), 2000, 42, KEYS).select(*KEYS, "label")


@query("O3", with_ctes(IMPRESSIONS) + f"SELECT {KEYS_SQL}, label FROM impressions WHERE {DRAWN_SQL} < 0.07e0")
def fraction_sample(spark, sf_dir):
    return sampling.fraction_sample(impressions(spark, sf_dir), 0.07, 42, KEYS).select(*KEYS, "label")


@query("O2", "SELECT count(*) AS n_rows FROM lineitem")
def random_split(spark, sf_dir):
    parts = sampling.random_split(impressions(spark, sf_dir).select(*KEYS))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.agg(F.count("*").alias("n_rows"))
