"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: target share of the output divided by its
share of the input characters, times ``epochs``.  A document's number of copies
inverts the Poisson distribution of that mean at a uniform number hashed from the
seed and its id, so a rerun or a lost executor repeats the same draw.  Copies get a
``shuffle_key`` hashed from seed, copy number, id and text.  They are dealt to
partitions and ordered inside them by that key and the row's place in the input, so
rows that are equal altogether are spread like any others.

A mean over ``MOST_MEAN`` is drawn as a sum of independent Poisson numbers with
equal parts of the mean, so one table of 65 terms is exact to double precision for
any rate, and nothing is cut off.

Defined results: null ``source`` is a source of its own; a source without text
keeps rate ``epochs``; a source missing from explicit weights has weight zero;
rows of equal ``doc_id`` get equal counts, and equal shuffle keys only if their texts
are equal too; a null ``doc_id`` is replaced by the text's hash.  The documents' own
columns travel as one struct, so no name of theirs clashes with a working column.
The rates are joined without a hint: Spark broadcasts the written
table of rates only if its size is under the session's threshold, and otherwise
splits hot sources at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import pin

MOST_MEAN = 8.0
TERMS = 64
#: Hex digits of a hash that make a uniform number; 52 bits fit a double.
HEX_DIGITS = 13


def _uniform(*parts: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**HEX_DIGITS))


def _cdf(mean: Column) -> Column:
    """Poisson distribution function at 0..TERMS, by its recurrence."""
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + term)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda s: s["cdf"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(_source, _rate, _draws, _cdf), one row per source.

    Without ``weights`` a source's target is its size to the power ``exponent``.
    """
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double").alias("_size"))
    if weights is None:
        target = F.pow(F.col("_size"), F.lit(exponent))
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    sizes = pin(sizes.withColumn("_target", target))
    total, target_total = sizes.agg(F.sum("_size"), F.sum(F.when(F.col("_size") > 0, F.col("_target")))).first()
    share = F.lit(float(epochs) * (total or 0.0)) * F.col("_target") / F.lit(target_total or 1.0)
    rate = F.when(F.col("_size") > 0, share / F.col("_size")).otherwise(F.lit(float(epochs)))
    draws = F.greatest(F.lit(1), F.ceil(F.col("_rate") / F.lit(MOST_MEAN)).cast("int"))
    return pin(
        sizes.select("_source", rate.alias("_rate"))
        .withColumn("_draws", draws)
        .withColumn("_cdf", _cdf(F.col("_rate") / F.col("_draws")))
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.7,
        epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The documents repeated and shuffled: own columns, then ``copy_no``, ``shuffle_key`` and ``mix_rate``.

    Columns of those names in ``docs`` are replaced.  Partitions hold random subsets in
    random order.
    """
    own = [c for c in docs.columns if c not in ("copy_no", "shuffle_key", "mix_rate")]
    table = rates(docs, weights, exponent, epochs)
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    # the place is read off the scan, so a task run again deals its rows alike
    rows = docs.select(F.struct(*own).alias("row"), key.alias("key"), F.monotonically_increasing_id().alias("place"))
    drawn = rows.join(table, F.col("row.source").eqNullSafe(F.col("_source")))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("_draws")),
        F.lit(0),
        lambda n, j: n + F.aggregate(
            F.array(_uniform(F.lit(str(seed)), j.cast("string"), F.col("key"))), F.lit(0),
            lambda _, u: F.size(F.filter("_cdf", lambda c: c <= u))),
    )
    repeated = drawn.withColumn("copies", copies).where("copies > 0").withColumn(
        "copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    named = F.concat_ws(":", F.lit(f"{seed}s"), F.col("copy_no").cast("string"), F.col("key"), F.md5("row.text"))
    shuffle = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("bigint")
    out = repeated.select(
        "row", "copy_no", shuffle.alias("shuffle_key"), F.round("_rate", 9).alias("mix_rate"), "place"
    ).withColumn("order", F.xxhash64("shuffle_key", "place"))
    return out.repartition("order").sortWithinPartitions("order").select("row.*", "copy_no", "shuffle_key", "mix_rate")


def mix_sql(exponent: float = 0.7, epochs: float = 1.0, seed: int = 17, docs: str = "documents") -> str:
    """SQL twin of ``mix`` without explicit weights."""

    def hexed(parts: str, n: int, keys: str = "key") -> str:
        return f"substr(md5(concat_ws(':', {parts}, {keys})), 1, {n})"

    return f"""
    WITH keyed AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS key FROM {docs}),
    sizes AS (SELECT source AS src, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM {docs} GROUP BY source),
    totals AS (SELECT sum(size) AS total, sum(CASE WHEN size > 0 THEN pow(size, {exponent}) END) AS target FROM sizes),
    rates AS (SELECT src, CASE WHEN size > 0 THEN {epochs} * total * pow(size, {exponent}) / target / size ELSE {epochs} END AS rate
              FROM sizes, totals),
    drawn AS (SELECT *, greatest(1, CAST(ceil(rate / {MOST_MEAN}) AS INTEGER)) AS draws FROM rates),
    terms AS (SELECT src, k, CASE WHEN k = 0 THEN exp(-rate / draws)
                ELSE exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1)) END AS term
              FROM drawn, range(0, {TERMS + 1}) AS t(k)),
    cdf AS (SELECT src, k, sum(term) OVER (PARTITION BY src ORDER BY k) AS p FROM terms),
    numbers AS (SELECT keyed.*, d.rate, j, CAST('0x' || {hexed(f"'{seed}', CAST(j AS VARCHAR)", HEX_DIGITS)} AS BIGINT) / pow(16, {HEX_DIGITS}) AS u
                FROM keyed JOIN drawn d ON source IS NOT DISTINCT FROM d.src, range(1, d.draws + 1) AS r(j)),
    counts AS (SELECT key, any_value(rate) AS rate, CAST(sum((SELECT count(*) FROM cdf WHERE cdf.src IS NOT DISTINCT FROM numbers.source AND p <= u)) AS BIGINT) AS n
               FROM (SELECT DISTINCT key, source, rate, j, u FROM numbers) numbers GROUP BY key)
    SELECT keyed.* EXCLUDE (key), CAST(copy_no AS INTEGER) AS copy_no,
           CAST('0x' || {hexed(f"'{seed}s', CAST(copy_no AS VARCHAR)", 15, "key, md5(text)")} AS BIGINT) AS shuffle_key, round(rate, 9) AS mix_rate
    FROM keyed JOIN counts USING (key), range(1, n + 1) AS c(copy_no)"""
