"""Language-model scoring with a probabilistic suffix tree.

Tokens are words and one end a text.  Words seen in few training texts share one symbol;
every other token is a symbol of its own.  Contexts are variable-length: up to ``DEPTH``
symbols back.  A context is a candidate from ``MIN_COUNT`` occurrences on, at any size of
the corpus, so the tree grows with it; it is retained if its next-symbol distribution
differs from that of its longest retained suffix by a likelihood-ratio test.  A retained
context's distribution is smoothed towards that suffix's; a token is scored in the state
of the longest retained suffix of what came before it.  The root is the word
distribution, in which tokens never trained on are one more kind, whose share is that of
tokens seen once.  Inside the shared symbol words keep the root's proportions.

The tree learns from every distinct training text once: copies say nothing new about
what follows what, and would make contexts surer than they are.  The base score counts
all copies.

Words, contexts and grams are known by 64-bit keys; states, probabilities and word
counts are tables that are joined to blocks of documents; a side is broadcast only after
its rows were counted.  Broadcast at any input size are bit sets of 8 MB: they keep keys out of joins that would
find nothing, and which words share the common symbol is read from one alone, so it is
the same in training and in scoring.  Counting sends one row per distinct (context,
symbol) of a task.

Defined results: a null or empty text is its end alone; a null ``doc_id`` is scored,
never trained on, and not held out.  Without training texts every token has
probability one half.  ``doc_id`` may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.batches import fold, slices, sums_between, texts, word_codes
from tidemark.session import exchanges_removed, pin, scratch_path, scratch_scope

#: Symbols a context reaches back.
DEPTH = 3
#: Occurrences in distinct texts from which a word is a symbol and a context a candidate.
MIN_COUNT = 16
#: Likelihood-ratio gain a context must bring for each next symbol it has seen.
GAIN = 0.5
#: Characters of text in a block of documents, on average.
BLOCK_CHARS = 32_000_000
#: Keys of the end token and of the symbol that infrequent words share.
END_KEY = np.int64(-1)
SHARED_KEY = np.int64(-2)
#: Bit sets: 2 ** 20 cells of 64 bits, found by a key's highest bits.
CELL_SHIFT, BIT_SHIFT = 44, 38
#: Cells in a row on their way to the driver.
PACKED = 1024
#: Rows of at most four numbers up to which a side of a join is broadcast, its rows being counted first.
BROADCAST_ROWS = 100_000
#: Distinct grams a task holds before it sends what it has counted.
HELD_ROWS = 2_000_000


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit keys of words."""
    return pd.util.hash_array(np.asarray(words.to_pylist(), object), categorize=False).view(np.int64) if len(words) else np.zeros(0, np.int64)


def with_ends(at: np.ndarray, values: np.ndarray, end: object) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of tokens, every text's words being followed by its end."""
    return at + np.arange(len(at)), np.insert(values, at[1:], end)


def before(at: np.ndarray, values: np.ndarray, back: int, start: np.generic) -> np.ndarray:
    """The value ``back`` places before each, ``start`` where that is before the text."""
    out = np.full(len(values), start, values.dtype)
    out[back:] = values[: max(0, len(values) - back)]
    place = np.arange(len(values)) - np.repeat(at[:-1], np.diff(at))
    out[place < back] = start
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of an ordered pair of keys."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def keys_of(at: np.ndarray, symbol: np.ndarray, depth: int = DEPTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length up to ``depth`` the keys of every symbol's context, and of context and symbol."""
    context, gram = [np.zeros(len(symbol), np.int64)], [symbol]
    for d in range(1, depth + 1):
        context.append(mixed(context[-1], before(at, symbol, d, END_KEY)))
        turned = gram[-1].view(np.uint64)
        turned = (turned << np.uint64(23)) | (turned >> np.uint64(41))
        gram.append(context[-1] ^ turned.view(np.int64))
    return context, gram


#: ``keys_of``'s key of a context ``c`` and a symbol whose next shorter gram is ``par``.
GRAM = "c ^ (shiftleft(par, 23) | shiftrightunsigned(par, 41)) AS g"


#: The bit of a key ``k`` within its cell.
BIT = f"shiftleft(1L, int(shiftrightunsigned(k, {BIT_SHIFT}) & 63))"


def _cells(keys: DataFrame, *sets: str) -> DataFrame:
    """(cell, one column of bits for each condition) of the column ``k``: at most 2 ** 20 rows."""
    return keys.groupBy(F.shiftrightunsigned("k", CELL_SHIFT).alias("cell")).agg(
        *[F.expr(f"bit_or(if({which}, {BIT}, 0L)) AS bits{i}") for i, which in enumerate(sets)])


def bit_sets(keys: DataFrame, *sets: str) -> list[np.ndarray]:
    """The 2 ** 20 cells of the keys in column ``k`` that fulfil each condition, found in one pass.

    Tasks pack 1,024 cells into a row, so the driver takes at most 1,024 rows of 8 KB a set.
    """
    names = [f"bits{i}" for i in range(len(sets))]

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        packed = []
        for name in names:
            cells = np.zeros(PACKED, np.uint64)
            cells[rows.column("cell").to_numpy() % PACKED] = rows.column(name).to_numpy().view(np.uint64)
            packed.append(pa.array([cells.tobytes()], pa.binary()))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *packed], names=["part", *names])

    parts = _cells(keys, *sets).withColumn("part", F.shiftright("cell", PACKED.bit_length() - 1)).groupBy("part").applyInArrow(
        pack, ", ".join(["part bigint", *[f"{name} binary" for name in names]]))
    out = [np.zeros(1 << (64 - CELL_SHIFT), np.uint64) for _ in sets]
    for row in parts.collect():
        for cells, bits in zip(out, row[1:]):
            cells[row[0] * PACKED : (row[0] + 1) * PACKED] = np.frombuffer(bits, np.uint64)
    return out


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set: always for keys of the set, seldom for others."""
    k = keys.view(np.uint64)
    return (bits[k >> np.uint64(CELL_SHIFT)] >> ((k >> np.uint64(BIT_SHIFT)) & np.uint64(63))) & np.uint64(1) == 1


def as_symbols(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The symbols of tokens: their own keys, or the shared one."""
    return np.where(maybe_in(own, keys) | (keys == END_KEY), keys, SHARED_KEY)


def _trained() -> Column:
    return (fold("doc_id", 5) != 1) & (fold("doc_id", 5) >= 0)


def word_counts(distinct: DataFrame) -> DataFrame:
    """(word, c, u): every token's count over all copies of ``distinct`` (text, copies), and over one of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=16 << 20):
            at, codes, words = word_codes(texts(batch))
            copies = batch.column("copies").to_numpy().astype(np.int64)
            c = np.zeros(len(words), np.int64)
            np.add.at(c, codes, np.repeat(copies, np.diff(at)))
            columns = [np.append(hashed(words), END_KEY), np.append(c, copies.sum()), np.append(np.bincount(codes, minlength=len(words)), len(copies))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["word", "c", "u"])

    return distinct.mapInArrow(run, "word bigint, c bigint, u bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("u").alias("u"))


def gram_counts(distinct: DataFrame, depth: int, own: object, shorter: object | None) -> DataFrame:
    """(c, par, n): counts of (context of ``depth`` symbols, symbol), ``par`` being the gram without the oldest symbol.

    ``shorter`` is a broadcast set of grams one symbol shorter that are frequent enough.  A context that is no such gram
    is none either, and is left out with all that follows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []

        def merged() -> list[np.ndarray]:
            gram, c, par, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(gram)
            gram, c, par, n = gram[order], c[order], par[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            return [gram[first], c[first], par[first], np.add.reduceat(n, first)]

        def rows(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            order = np.argsort(columns[1])  # equal contexts side by side take less room in an exchange
            for i in range(0, len(order), 100_000):
                part = order[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in columns[1:]], ["c", "par", "n"])

        for batch in slices(batches):
            at, codes, words = word_codes(texts(batch))
            at, symbol = with_ends(at, as_symbols(own.value, hashed(words))[codes], END_KEY)
            context, gram = keys_of(at, symbol, depth)
            keep = np.ones(len(symbol), bool)
            if shorter is not None:
                keep = maybe_in(shorter.value, before(at, gram[depth - 1], 1, np.int64(0)))
                keep[at[:-1]] = True
            g, first, n = np.unique(gram[depth][keep], return_index=True, return_counts=True)
            parts.append([g, context[depth][keep][first], gram[depth - 1][keep][first], n.astype(np.int64)])
            if sum(len(p[0]) for p in parts) > HELD_ROWS:
                parts[:] = [merged()]
                if len(parts[0][0]) > HELD_ROWS // 2:
                    yield from rows(parts.pop())
        if parts:
            yield from rows(merged())

    counted = distinct.mapInArrow(run, "c bigint, par bigint, n bigint")
    return counted.groupBy("c", "par").agg(F.sum("n").alias("n"))


def small(df: DataFrame, path: str | None = None) -> tuple[DataFrame, bool]:
    """A written table of narrow rows, marked for broadcast if it holds at most ``BROADCAST_ROWS``.

    A larger one is marked for a sorted join: Spark would judge both sides by the bytes of
    compressed files or of rows before an explode, and send the driver many times as much.
    """
    table = pin(df, path=path)
    fits = table.count() <= BROADCAST_ROWS
    return (F.broadcast(table) if fits else table.hint("merge")), fits


def grown(rows: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, n, p, retained) of the grams of candidate contexts, and (c, rest): what retained states leave to their suffixes.

    ``below``: (g, p) of the next shorter grams, in the states of their own longest retained suffixes.
    """
    spark = rows.sparkSession
    kept, sent = scratch_path(spark, "level"), scratch_path(spark, "tested")
    with scratch_scope(spark):
        judged = pin(rows.join(below.select(F.col("g").alias("par"), F.col("p").alias("q")), "par").select("c", "par", "n", "q"))
        tested, _ = small(judged.groupBy("c").agg(
            F.sum("n").alias("t"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("fit")
        ).where(F.col("t") >= MIN_COUNT).select(
            F.col("c").alias("k"), "t", "kinds", (F.col("fit") - F.col("t") * F.log("t") >= GAIN * F.col("kinds")).alias("retained")), sent)
        whole = F.col("t") + F.col("kinds")
        level = pin(judged.join(tested, F.col("c") == F.col("k")).select(
            F.expr(GRAM), "n", F.when(F.col("retained"), (F.col("n") + F.col("kinds") * F.col("q")) / whole).otherwise(F.col("q")).alias("p"), "retained"),
            path=kept)
    return level, tested.where("retained").select(F.col("k").alias("c"), (F.col("kinds") / whole).alias("rest"))


def token_scores(at: np.ndarray, symbol: np.ndarray, root: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol in its longest retained suffix's state.

    ``root``: by the root; ``found``: sorted keys of states and of their grams, and the
    logarithms of what a state leaves to its suffix, or of a gram's probability.
    """
    keys, values = found
    out = root.copy()
    if not len(keys):
        return out

    def look(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return keys[i] == k, values[i]

    for context, gram in list(zip(*keys_of(at, symbol)))[1:]:
        state, rest = look(context)
        seen, p = look(gram)
        out = np.where(state & seen, p, np.where(state, out + rest, out))
    return out


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")


def block_keys(marked: DataFrame, own: object, tree: object) -> DataFrame:
    """(key, block): the distinct words of each block of documents, its end, and its keys that may be in the tree.

    ``marked``: (doc_id, text, block) dealt and sorted by block; the keys of a block's slices
    are held until the next block begins, so that each is asked for once.
    """

    def asked_by(block: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.concatenate(parts))
        for i in range(0, len(keys), 500_000):
            part = keys[i : i + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block, np.int32))], ["key", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in slices(batches):
            at, codes, words = word_codes(texts(batch))
            word = hashed(words)
            at, token = with_ends(at, word[codes], END_KEY)
            context, gram = keys_of(at, as_symbols(own.value, token))
            block = batch.column("block").to_numpy().astype(np.int64)
            places = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for a, b in zip(places, [*places[1:], len(block)]):
                mine = slice(at[a], at[b])
                asked = [token[mine]]
                for c, g in zip(context[1:], gram[1:]):
                    hit = maybe_in(tree.value, c[mine])
                    k = g[mine][hit]
                    asked += [c[mine][hit], k[maybe_in(tree.value, k)]]
                if parts and block[a] != now:
                    yield from asked_by(now, parts)
                    parts = []
                now = block[a]
                parts.append(np.unique(np.concatenate(asked)))
        if parts:
            yield from asked_by(now, parts)

    return marked.mapInArrow(run, "key bigint, block int")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, train_tokens) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))

    path = scratch_path(spark, "answered")
    with scratch_scope(spark), exchanges_removed(spark):
        distinct = pin(docs.where(_trained()).groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies")))
        counts = pin(word_counts(distinct))
        sums = counts.agg(F.sum("c").alias("all"), F.count("*").alias("kinds"), F.sum("u").alias("tokens"),
                          F.sum((F.col("u") == 1).cast("bigint")).alias("singles")).first()
        n_train, n_kinds, tokens = sums["all"] or 0, sums["kinds"], sums["tokens"] or 0
        # tokens seen once tell the share of tokens never seen
        unseen = min((sums["singles"] or 0) / max(1, tokens) or 0.5 / (tokens + 1), 0.5)
        scale = float(np.log10(n_train + 0.5 * (n_kinds + 1)))
        roots = counts.select(F.col("word").alias("g"), ((1 - unseen) * F.col("u") / max(1, tokens)).alias("p"), (F.col("u") >= MIN_COUNT).alias("often"))

        # symbols of their own are all words whose bit is set, be it by another word
        often = roots.where("often").select(F.col("g").alias("k"))
        own = spark.sparkContext.broadcast(bit_sets(often, "true")[0])
        cells = _cells(often, "true")
        named = roots.join(cells, F.shiftrightunsigned("g", CELL_SHIFT) == F.col("cell"), "left").select(
            "g", "p", F.expr(f"g = {END_KEY} OR coalesce(shiftrightunsigned(bits0, int(shiftrightunsigned(g, {BIT_SHIFT}) & 63)) & 1 = 1, false)").alias("own"))
        shared = unseen + (named.where("NOT own").agg(F.sum("p")).first()[0] or 0.0)
        below, _ = small(named.where("own").select("g", "p").unionByName(
            spark.range(1).select(F.lit(int(SHARED_KEY)).cast("bigint").alias("g"), F.lit(shared).alias("p"))))

        no_count = F.lit(None).cast("bigint").alias("c")
        in_tree, found, shorter = np.zeros(1 << (64 - CELL_SHIFT), np.uint64), [], None
        for depth in range(1, DEPTH + 1):
            level, states = grown(gram_counts(distinct, depth, own, shorter), below)
            often, grams = bit_sets(level.withColumnRenamed("g", "k"), f"n >= {MIN_COUNT}", "retained")
            in_tree |= grams | bit_sets(states.withColumnRenamed("c", "k"), "true")[0]
            shorter, below = spark.sparkContext.broadcast(often), level.select("g", "p")
            found.append(level.where("retained").select(F.col("g").alias("k"), no_count, F.log10("p").alias("v")))
            found.append(states.select(F.col("c").alias("k"), no_count, F.log10("rest").alias("v")))
        words = counts.select(F.col("word").alias("k"), "c", F.log10((1 - unseen) * F.col("u") / max(1, tokens)).alias("v"))
        tree = spark.sparkContext.broadcast(in_tree)

        marked = docs.select("doc_id", "text", _block(blocks).alias("block")).repartition("block")
        asked = block_keys(marked.sortWithinPartitions("block"), own, tree)
        # written, so that the tree and what was asked leave the disk before texts meet their answers
        answered = pin(asked.join(reduce(DataFrame.unionByName, found, words), F.col("key") == F.col("k")).select("block", "key", "c", "v"), path=path)

    doc_id = pa.field("doc_id", to_arrow_type(docs.schema["doc_id"].dataType))
    fields = pa.schema([doc_id, ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    log_unseen, log_shared = float(np.log10(unseen)), float(np.log10(shared))

    def run(key: tuple, own_rows: pa.Table, words: pa.Table) -> pa.Table:
        words = words.take(pc.sort_indices(words.column("key")))
        is_word = words.column("c").is_valid().to_numpy()
        keys, values = words.column("key").to_numpy(), words.column("v").to_numpy()
        found = keys[~is_word], values[~is_word]
        keys, values, count = keys[is_word], values[is_word], words.column("c").drop_null().to_numpy()
        parts = []
        for batch in slices(own_rows.combine_chunks().to_batches()):
            at, codes, distinct_words = word_codes(texts(batch))
            word = np.append(hashed(distinct_words), END_KEY)  # the end is the last code
            c, root = np.zeros(len(word), np.int64), np.full(len(word), log_unseen)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                hit = keys[i] == word
                c[hit], root[hit] = count[i[hit]], values[i[hit]]
            at, codes = with_ends(at, codes, len(distinct_words))
            symbol = as_symbols(own.value, word)
            # an infrequent word is scored as the shared symbol, then within it
            inside = np.where(symbol == SHARED_KEY, root - log_shared, 0.0)
            by_token = token_scores(at, symbol[codes], (root - inside)[codes], found) + inside[codes]
            parts.append(pa.table([
                batch.column("doc_id").cast(doc_id.type), np.diff(at), sums_between(at, (c > 0).astype(np.int64)[codes]),
                sums_between(at, np.log10(c + 0.5)[codes]) - np.diff(at) * scale, sums_between(at, by_token)], schema=fields))
        return pa.concat_tables(parts) if parts else fields.empty_table()

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = marked.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_train).cast("bigint"))
