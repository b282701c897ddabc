"""Quality rules: a table of thresholds compiled into one projection.

Statistics are named column expressions over a text's words and lines; rules are
rows (statistic, least, most); ``compile_rules`` turns the rules into one boolean.
No user functions, no shuffle.

The words inside repeated windows are found exactly: hashes of all windows tell
whether a text has a repeated one at all, and only such texts compare the windows
themselves, sorted next to each other.

Defined results: null and blank texts have zero words, every ratio zero, and fail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
NGRAM = 8
# Fixed word list: the commonest function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as at "
    "le la les des et un une que dans est en pour "
    "der die das und ein eine ist nicht zu von den "
    "el los las y por con una del"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if the statistic is under ``least`` or over ``most``."""

    statistic: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", 20, 1_000_000),
    Rule("repeat_ratio", most=0.3),
    Rule("mean_word_length", 2, 20),
    Rule("symbol_word_ratio", most=0.3),
    Rule("dup_line_ratio", most=0.5),
    Rule("upper_ratio", most=0.7),
    Rule("stop_word_ratio", least=0.02),
)


def _with(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _windows(words: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - NGRAM + 1), make)


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``NGRAM`` words found twice or more, the first included."""
    def hashed(w: Column) -> Column:
        return _windows(w, lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(NGRAM)]))

    def exact(w: Column) -> Column:
        # texts have no word separators inside words, so a joined window is unique
        rows = F.array_sort(_windows(w, lambda i: F.struct(F.array_join(F.slice(w, i, NGRAM), " ").alias("w"), i.alias("i"))))
        return _with(rows, spans)

    def spans(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["w"].eqNullSafe(F.get(s, k)["w"])
        starts = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j + 1) | same(j, j - 1)),
            lambda j: F.get(s, j)["i"])
        return _with(F.array_sort(starts), lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(NGRAM), F.coalesce(b - a, F.lit(NGRAM)))),
            F.lit(0), lambda n, x: n + x))

    def either(h: Column, w: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w)).otherwise(F.lit(0))

    return F.when(F.size(words) > NGRAM, _with(words, lambda w: _with(hashed(w), lambda h: either(h, w)))).otherwise(F.lit(0)).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics the rules are written in."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = F.size("_words")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return (
        docs.select("doc_id", text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
        .select(
            "doc_id",
            count.cast("bigint").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
            repeated_words(F.col("_words")).alias("n_repeat_words"),
            F.size("_lines").alias("_n_lines"),
            F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).alias("_upper"),
            F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).alias("_letters"),
            F.regexp_count("_text", F.lit(r"(?i)(?<![\p{L}\p{M}'])(?:" + "|".join(STOP_WORDS) + r")(?![\p{L}\p{M}'])")).alias("_stops"),
        )
        .select(
            "*",
            ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
            ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_word_ratio"),
            ratio(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
            ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"),
            ratio(F.col("_upper"), F.col("_letters")).alias("upper_ratio"),
            ratio(F.col("_stops"), F.col("n_words")).alias("stop_word_ratio"),
        )
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule fails."""
    passed = F.lit(True)
    for r in rules:
        if r.least is not None:
            passed = passed & (F.col(r.statistic) >= r.least)
        if r.most is not None:
            passed = passed & (F.col(r.statistic) <= r.most)
    return passed


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return statistics(docs).select("*", base_failed.alias("base_failed"), (~base_failed & compile_rules(rules)).alias("kept"))


def judge_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL twin of the query over ``judge``."""
    passed = " AND ".join(
        f"{r.statistic} {op} {v}" for r in rules for op, v in ((">=", r.least), ("<=", r.most)) if v is not None)
    stops = "|".join(STOP_WORDS)
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    parts AS (SELECT row, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
    places AS (SELECT row, i, array_to_string(w[i : i + {NGRAM - 1}], ' ') AS g
               FROM parts, range(1, len(w) - {NGRAM - 2}) AS r(i) WHERE len(w) > {NGRAM}),
    twice AS (SELECT row, i FROM places QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
    covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, {NGRAM}) AS s(k) GROUP BY row),
    counted AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
        length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters,
        len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}'']+'), lambda x: regexp_full_match(x, '{stops}'))) AS stops
        FROM parts LEFT JOIN covered USING (row)),
    ratios AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_word_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
        CASE WHEN letters > 0 THEN upper / letters ELSE 0 END AS upper_ratio,
        CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_word_ratio FROM counted),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM ratios)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {passed} AS kept FROM judged"""
