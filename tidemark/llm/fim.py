"""Fill-in-middle: documents cut into prefix, middle and suffix by one counted regex.

``regexp_count`` gives the number n of units (code points) of a text.  Two cuts
a <= b are drawn from a hash of the document's id, and a pattern made for the row,
``\\A(.{a}+)(.{b-a}+)(.*+)\\z``, captures the three parts in one match, whose replacement
writes them in the order of the form: possessive counts never give a unit back, so a
match is one pass over the text.  All of it is native.

Forms: ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` is
``<S>``suffix``<P>``prefix``<M>``middle, ``plain`` is the text itself.  A text that is empty or
holds one of the marks stays plain, so every output can be undone exactly.

Defined results: a null text is the empty text (plain, n = 0); a null ``doc_id`` draws
like an empty id; rows repeated under one id are cut at the same draws; columns named
like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units counted as one match; what is left over is counted one by one.
BLOCK = 1024
RESULTS = ("fim_text", "fim_form", "fim_units", "fim_prefix", "fim_middle")


def count_units(text: Column) -> Column:
    """Code points of a text: whole blocks, then the units that no block took."""
    block = f"(?s).{{{BLOCK}}}"
    rest = F.regexp_count(F.regexp_replace(text, block, ""), F.lit("(?s)."))
    return F.regexp_count(text, F.lit(block)).cast("bigint") * BLOCK + rest


def _draw(hexed: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned number."""
    return F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("bigint")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    psm = f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\\z"
    spm = f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\\z"
    pattern = F.when(form == "psm", F.lit(psm)).when(form == "spm", F.lit(spm)).otherwise(F.lit("(?s)\\A(.*+)\\z"))
    order = F.when(form == "psm", F.lit("$1$3$2")).when(form == "spm", F.lit("$2$3$1")).otherwise(F.lit("$1"))
    return F.regexp_replace(output, pattern, order)


def transform(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """The documents' own columns, then ``fim_text``, ``fim_form``, ``fim_units``, ``fim_prefix`` and ``fim_middle``.

    ``plain_percent`` of the documents stay plain, ``spm_percent`` of the others take
    the spm form.  The last two columns count units and are null for plain rows.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    counted = docs.select(row).select("row", text.alias("text"), F.sha2(key, 256).alias("hash")).select(
        "row", "text", "hash", count_units(F.col("text")).alias("n"))
    units = F.col("n") + 1
    one, two = _draw(F.col("hash"), 0) % units, _draw(F.col("hash"), 1) % units
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (_draw(F.col("hash"), 2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_draw(F.col("hash"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    cut = counted.select("row", "text", "n", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))
    pattern = F.concat(
        F.lit("(?s)\\A(.{"), F.col("a").cast("string"), F.lit("}+)(.{"), (F.col("b") - F.col("a")).cast("string"), F.lit("}+)(.*+)\\z"))
    order = (
        F.when(F.col("form") == "psm", F.lit(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2"))
        .when(F.col("form") == "spm", F.lit(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
        .otherwise(F.lit("$1$2$3"))
    )
    split = F.col("form") != "plain"
    return cut.select(
        *[F.col("row").getField(c).alias(c) for c in own],
        F.regexp_replace("text", pattern, order).alias("fim_text"),
        F.col("form").alias("fim_form"),
        F.col("n").alias("fim_units"),
        F.when(split, F.col("a")).alias("fim_prefix"),
        F.when(split, F.col("b") - F.col("a")).alias("fim_middle"),
    )


def transform_sql(docs: str = "documents") -> str:
    """SQL twin of the query over ``transform`` with its usual rates and seed."""
    draw = lambda k: f"CAST('0x' || substr(hash, {8 * k + 1}, 8) AS BIGINT)"
    return f"""
    WITH counted AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM {docs}),
    cut AS (SELECT doc_id, t, n, least({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS a,
        greatest({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {draw(2)} % 100 >= 90 THEN 'plain'
             WHEN {draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM counted),
    parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
               ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM parts"""
