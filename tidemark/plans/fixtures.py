"""Impression-shaped views over the driver's star-schema tables, in Spark and in SQL.

Each Spark view has a SQL twin of the same name, given as a common table
expression for the oracle queries.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import dbl
from tidemark.operators.sampling import split_by_key

LOG = ["I1", "I2", "I3"]
STD = ["I4", "I5", "I6", "I7"]
NUMERIC = LOG + STD
CATEGORIES = ["C1", "C2", "C3", "C4", "C5"]
DRIFT_FIELDS = NUMERIC
REFERENCE_BATCHES = 5
DATASET = "clicks"


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(spark: SparkSession, sf_dir: str, customers_first: bool = False) -> DataFrame:
    """One impression per line item; nulls, a shift in I4 from batch 5 on, split by key.

    Scores are rounded so that equal ones tie alike in both engines.  ``customers_first``
    joins customers to orders before lines, so that lines are sent twice instead of three
    times, for readers of few columns; the rows are the same.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus",
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    by_order, by_part = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey") == F.col("p_partkey")
    by_customer = F.col("o_custkey") == F.col("c_custkey")
    if customers_first:
        joined = lines.join(parts, by_part).join(orders.join(customers, by_customer), by_order)
    else:
        joined = lines.join(orders, by_order).join(parts, by_part).join(customers, by_customer)
    logit = dbl(-0.7) + dbl(0.01) * F.col("l_quantity") - dbl(2) * F.col("l_discount")
    columns = joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_quantity").alias("I1"),
        F.col("l_linenumber").cast("double").alias("I2"),
        F.when(F.col("l_orderkey") % 17 != 0, F.col("p_size").cast("double")).alias("I3"),
        (F.col("l_extendedprice") * F.when(F.col("year") >= 2000, dbl(1.5)).otherwise(dbl(1))).alias("I4"),
        F.col("l_discount").alias("I5"),
        F.col("c_acctbal").alias("I6"),
        F.col("o_totalprice").alias("I7"),
        F.col("l_linestatus").alias("C1"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("p_brand")).alias("C2"),
        F.col("p_type").alias("C3"),
        F.col("o_orderpriority").alias("C4"),
        F.col("c_mktsegment").alias("C5"),
        (F.col("year") - 1995).cast("long").alias("batch_id"),
        F.round(dbl(1) / (dbl(1) + F.exp(-logit)), 9).alias("p_click"),
    )
    return split_by_key(columns, "l_orderkey", hashed=False)


IMPRESSIONS = """impressions AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    l_quantity AS I1, CAST(l_linenumber AS DOUBLE) AS I2,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS I3,
    l_extendedprice * CASE WHEN year(o_orderdate) >= 2000 THEN 1.5e0 ELSE 1e0 END AS I4,
    l_discount AS I5, c_acctbal AS I6, o_totalprice AS I7,
    l_linestatus AS C1,
    CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE p_brand END AS C2,
    p_type AS C3, o_orderpriority AS C4, c_mktsegment AS C5,
    CAST(year(o_orderdate) - 1995 AS BIGINT) AS batch_id,
    CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split,
    round(1e0 / (1e0 + exp(-(-0.7e0 + 0.01e0 * l_quantity - 2e0 * l_discount))), 9) AS p_click
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""


def clicks(spark: SparkSession, sf_dir: str, customers_first: bool = False) -> DataFrame:
    """Impressions with targets that depend on their columns.

    ``clicked`` is 0 or 1, ``action`` 0, 1 or 2; a number made of the keys is held against
    a chance that grows with I1 and falls with I5, differs by C5, and is curved in I6.
    """
    df = impressions(spark, sf_dir, customers_first)
    draw = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 10007 + dbl(0.5)) / dbl(10007)
    logit = (
        dbl(-2.5) + dbl(0.06) * F.col("I1") - dbl(8) * F.col("I5")
        + F.when(F.col("C5") == "BUILDING", dbl(1.2)).otherwise(dbl(0))
        + F.col("I6") * F.col("I6") / dbl(4e7)
    )
    chance = dbl(1) / (dbl(1) + F.exp(-logit))
    return df.select(
        "*",
        F.when(draw < chance, 1).otherwise(0).alias("clicked"),
        F.when(draw < dbl(0.4) * chance, 2).when(draw < chance, 1).otherwise(0).alias("action"),
    )


CLICKS = """clicks AS (SELECT *, CASE WHEN draw < chance THEN 1 ELSE 0 END AS clicked,
    CASE WHEN draw < 0.4e0 * chance THEN 2 WHEN draw < chance THEN 1 ELSE 0 END AS action
  FROM (SELECT *, ((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 10007 + 0.5e0) / 10007e0 AS draw,
    1e0 / (1e0 + exp(-(-2.5e0 + 0.06e0 * I1 - 8e0 * I5 + CASE WHEN C5 = 'BUILDING' THEN 1.2e0 ELSE 0e0 END + I6 * I6 / 4e7))) AS chance
  FROM impressions))"""


WIDE_NUMERIC = NUMERIC + [f"I{k}" for k in range(8, 14)]
WIDE_CATEGORIES = CATEGORIES + [f"C{k}" for k in range(6, 27)]


def _wide_size(k: int) -> int:
    """Distinct values of C6 to C26: from a few to more than there are rows at small scale."""
    return 3 ** (1 + (k - 6) % 11) + k


def wide_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with 13 numbers and 26 categories.

    Every category has nulls; C24 to C26 hold one value that training never sees in two
    thirds of the other rows.
    """
    df = impressions(spark, sf_dir)
    mixed = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")
    numbers = [
        F.when(F.col("l_partkey") % k != 0, F.col("I4") / dbl(k) + F.col("I2")).alias(f"I{k}") for k in range(8, 14)
    ]
    categories = []
    for k in range(6, 27):
        value = F.concat(F.lit(f"v{k}_"), ((mixed * k) % _wide_size(k)).cast("string"))
        if k >= 24:
            value = F.when((F.col("split") != "train") & (F.col("l_linenumber") % 3 != 0), F.lit("launched today")).otherwise(value)
        categories.append(F.when(mixed % (k + 5) != 0, value).alias(f"C{k}"))
    return df.select("*", *numbers, *categories)


def _wide_sql() -> str:
    mixed = "(l_orderkey * 31 + l_partkey * 7 + l_linenumber)"
    cells = [f"CASE WHEN l_partkey % {k} <> 0 THEN I4 / {k}e0 + I2 END AS I{k}" for k in range(8, 14)]
    for k in range(6, 27):
        value = f"'v{k}_' || CAST(({mixed} * {k}) % {_wide_size(k)} AS VARCHAR)"
        if k >= 24:
            value = f"CASE WHEN split <> 'train' AND l_linenumber % 3 <> 0 THEN 'launched today' ELSE {value} END"
        cells.append(f"CASE WHEN {mixed} % {k + 5} <> 0 THEN {value} END AS C{k}")
    return f"wide AS (SELECT *, {', '.join(cells)} FROM impressions)"


WIDE = _wide_sql()


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve points: mean event value per day, by seed, field and dimension."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        (F.col("user_id") % 3).cast("int").alias("seed"),
        F.col("event_type").alias("field_name"),
        (F.col("user_id") % 4).cast("int").alias("dim"),
        F.day("ts").cast("double").alias("x"),
    ).agg(F.avg("value").alias("phi"))


CURVES = """curves AS (
  SELECT CAST(user_id % 3 AS INT) AS seed, event_type AS field_name, CAST(user_id % 4 AS INT) AS dim,
    CAST(day(ts) AS DOUBLE) AS x, avg(value) AS phi
  FROM events GROUP BY user_id % 3, event_type, user_id % 4, day(ts))"""


def item_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata with a third of the items missing and a fifth of the scores null."""
    part = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 3 != 0)
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_retailprice").alias("price_usd"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") / dbl(50)).alias("popularity_score"),
        F.col("p_size").alias("days_since_listing"),
        F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") % 5).cast("double")).alias("avg_rating"),
    )


ITEM_METADATA = """item_metadata AS (
  SELECT p_partkey AS item_id, p_retailprice AS price_usd, p_type AS category,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 50e0 END AS popularity_score,
    p_size AS days_since_listing,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) END AS avg_rating
  FROM part WHERE p_partkey % 3 <> 0)"""


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment results: brands as encoders, size classes as seeds and grid sizes."""
    part = table(spark, sf_dir, "part")
    return part.groupBy(
        F.col("p_brand").alias("encoder"),
        (F.col("p_size") % 3).cast("int").alias("seed"),
        F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("dataset"),
    ).agg(
        (F.avg("p_retailprice") / dbl(2000)).alias("test_auc"),
        F.avg(F.col("p_size").cast("double")).alias("test_logloss"),
        F.count("*").alias("epochs"),
    )


EXPERIMENTS = """experiments AS (
  SELECT p_brand AS encoder, CAST(p_size % 3 AS INT) AS seed,
    CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset,
    avg(p_retailprice) / 2000e0 AS test_auc, avg(CAST(p_size AS DOUBLE)) AS test_logloss, count(*) AS epochs
  FROM part GROUP BY p_brand, CAST(p_size % 3 AS INT), CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END)"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing runs: one per event, the type as encoder."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("encoder"),
        F.col("value").alias("full_ms"),
        (F.col("value") * dbl(0.25) + dbl(0.5)).alias("encoder_ms"),
    )


TIMINGS = """timings AS (
  SELECT event_type AS encoder, value AS full_ms, value * 0.25e0 + 0.5e0 AS encoder_ms FROM events)"""


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 norm per (seed, field): vector positions as fields, labels as seeds."""
    vectors = table(spark, sf_dir, "embeddings")
    return (
        vectors.select(F.col("label").alias("seed"), F.posexplode("embedding").alias("position", "w"))
        .groupBy("seed", F.concat(F.lit("I"), F.col("position").cast("string")).alias("field_name"))
        .agg(F.sum(F.abs(F.col("w").cast("double"))).alias("norm"))
    )


NORMS = """norms AS (
  SELECT seed, 'I' || CAST(position AS VARCHAR) AS field_name, sum(abs(CAST(w AS DOUBLE))) AS norm
  FROM (SELECT label AS seed, unnest(embedding) AS w, generate_subscripts(embedding, 1) - 1 AS position
        FROM embeddings) GROUP BY seed, position)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(expression: str, places: int = 6) -> str:
    """SQL twin of ``rounded``."""
    return f"round({expression}, {places}) + 0e0"
