"""Near copies by SimHash fingerprints and by shared word shingles; exact check, components.

Fingerprints (``simhash``) link texts that differ in two bits or fewer, as they stand.
64 bits do not reach further copies: texts whose sets of ``WORDS``-word shingles have a
Jaccard similarity of ``LEAST`` differ by 10 bits on average, by 16 and more in the tail,
where unrelated ones begin.  So every pair of that similarity or more is linked too.

Such a pair shares one of the first shingles of both texts, in any order that is the
same for all texts: with n and m shingles they share LEAST / (1 + LEAST) * (n + m), so no
more than the rest may come before the first shared one.  A text is posted under its
first fifth of shingles with their places, and pairs whose places allow no such overlap
are never formed, nor those whose sets differ in too many shingles by the parities of a
few hundred places.  A text leaves a cell where no other's size and place allow it, so
what meets by chance goes no further than the exchange by cell.  No pair is missed,
whatever the order.  The order counted here puts frequent shingles last, so that a
passage common to many texts makes no cell unless it is nearly all of them.  Counts are kept in ``BUCKETS`` buckets; two shingles in
one bucket cost work, not results.  Every candidate pair is checked on the whole sets.

Crowded cells: texts of equal sets are one node.  Every member of a cell is first
checked against one leader of the cell, which links a group of copies without its
pairs; then pairs of members that are still in different components are checked.
No pair is left out: one that is not checked is in one component already.

Defined results: as for fingerprints, no words (null or empty text) is one node and
fewer than ``WORDS`` words make one shingle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.batches import released, slices
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import LOWER, fingerprint, row_key
from tidemark.llm.suffixtree import BROADCAST_ROWS, bit_sets, maybe_in, small
from tidemark.session import pin

WORDS, LEAST = 5, 0.8
#: Members from which a cell gets further leaders before its pairs are formed.
CROWDED, LEADERS = 48, 4
#: Buckets of shingle counts, found by a hash's highest bits, and buckets in a row on their way to the driver.
BUCKETS, PACKED = 1 << 22, 1 << 12
SHIFT = np.uint64(64 - 22)
#: Characters of looked-up texts from which they are not broadcast.
SENT_CHARS = 8_000_000
#: Bits of the parities that a pair is held against before it is formed.
PARITIES = 512


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(tokens) - words + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        part = [tokens[a + i : b + i] for i in range(words)] if len(tokens) >= words else [[t] for t in tokens]
        out[a:b] = np.fromiter((h64(join(g), 42) for g in zip(*part)), np.uint64, b - a)
    return np.unique(out)


def first_ones(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles one of which two similar texts share: the first fifth, rare ones first."""
    if not len(own):
        return own
    order = np.argsort(levels[own >> SHIFT], kind="stable")
    return own[order[: int((1 - LEAST) * len(own) + 1e-6) + 1]]


def parities(own: np.ndarray) -> np.ndarray:
    """Whether odd numbers of shingles fall on each of ``PARITIES`` places, as signed longs.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    odd = np.bincount((own & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def shingle_levels(docs: DataFrame) -> np.ndarray:
    """For each bucket, twice the binary logarithm of how many texts hold its shingles, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in slices(batches):
            for t in batch.column("text").to_pylist():
                np.add.at(counts, shingles(t) >> SHIFT, 1)
        part = np.flatnonzero(counts.reshape(-1, PACKED).any(1))
        # most counts of a task are 0 or 1
        rows = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(-1, PACKED)[part]]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(rows, pa.binary())], ["part", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(PACKED, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
        levels = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "levels": pa.array([levels.tobytes()], pa.binary())})

    counted = docs.select("text").mapInArrow(run, "part bigint, counts binary")
    out = np.zeros(BUCKETS, np.uint8)
    for part, levels in counted.groupBy("part").applyInArrow(add, "part bigint, levels binary").collect():
        out[part * PACKED : (part + 1) * PACKED] = np.frombuffer(levels, np.uint8)
    return out


def _node(own: np.ndarray) -> int:
    """The node of a text: a hash of its set of shingles."""
    return xxhash.xxh64_intdigest(own.tobytes(), 42) - (1 << 63)


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp, node, n, odd): fingerprint, a hash of the shingle set, its size and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in slices(batches):
            fp, node, n, odd = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t)
                fp.append(fingerprint(t))
                node.append(_node(s))
                n.append(len(s))
                odd.append(parities(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(node, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "row_key", "fp", "node", "n", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(
        run, f"doc_id {kind}, row_key bigint, fp bigint, node bigint, n bigint, odd array<bigint>")


def postings(docs: DataFrame) -> DataFrame:
    """(cell, node, n, at): the first shingles of each text with their places, copies within a task left out.

    Shingles are made anew: sent along with the marks they would take more room than all else.
    """
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        posted: set[int] = set()
        for batch in slices(batches):
            cells, node, n = [np.zeros(0, np.uint64)], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t)
                if (k := _node(s)) not in posted:
                    posted.add(k)
                    cells.append(first_ones(s, levels.value))
                    node.append(k)
                    n.append(len(s))
            many = [len(c) for c in cells[1:]]
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(m) for m in many]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.repeat(np.array(node, np.int64), many)),
                 pa.array(np.repeat(np.array(n, np.int32), many)), pa.array(at.astype(np.int32))], ["cell", "node", "n", "at"])

    return docs.select("text").mapInArrow(run, "cell bigint, node bigint, n int, at int")


def texts_of(docs: DataFrame, keys: DataFrame, repeated: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``pairs`` (u, v) by ``keys`` (node, row_key); other texts are not sent.

    ``repeated``: (row_key, times) of rows that come more than once, which alone are sent to have one of them left.
    """
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = pin(nodes.join(keys.select("node", "row_key"), "node").join(repeated, "row_key", "left"))
    size, more = wanted.agg(F.count("*"), F.count("times")).first()
    rows = docs.select(row_key().alias("row_key"), "text")
    if size <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(wanted), "row_key")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(bit_sets(wanted.select(F.col("row_key").alias("k")), "true")[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(maybe_in(bits.value, batch.column("row_key").to_numpy())))

        found = rows.mapInArrow(run, "row_key bigint, text string").join(wanted, "row_key")
    if more:
        found = found.where("times IS NULL").unionByName(found.where("times IS NOT NULL").dropDuplicates(["row_key"]))
    return found.select("node", "text")


def alike(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar by ``LEAST`` or more; ``texts`` looks up the texts of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "a"):
                both = zip(part.column("a").to_pylist(), part.column("b").to_pylist())
                keep = pa.array([similarity(shingles(x), shingles(y)) >= LEAST for x, y in both], pa.bool_())
                yield part.select(["u", "v"]).filter(keep)

    found = pin(texts(pairs))
    # near copies take many times less room in a file than in a broadcast
    if (found.agg(F.sum(F.length("text"))).first()[0] or 0) > SENT_CHARS:
        found = found.hint("merge")
    a, b = (found.select(F.col("node").alias(k), F.col("text").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _may_reach(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of n and m shingles can be similar if the first shared one is at these places."""
    return F.least(n - at, m - to) >= (n + m) * (LEAST / (1 + LEAST)) - 1e-6


def _parities_allow(n: Column, odd: Column, m: Column, other: Column) -> Column:
    """Whether similar sets of n and m shingles can have these parities."""
    differ = sum((F.bit_count(odd[i].bitwiseXOR(other[i])) for i in range(PARITIES // 64)), F.lit(0))
    return differ <= (n + m) * ((1 - LEAST) / (1 + LEAST)) + 1e-6


def meeting(posted: DataFrame) -> DataFrame:
    """(cell, node, n, at, size) of the postings that some other of their cell may be similar to.

    By size and place, a set of n shingles reaches sets of up to a certain size; two sets
    can be similar only if each reaches the other.  Found in one exchange by cell.
    """
    cell = Window.partitionBy("cell")
    once = posted.withColumn("before", F.lag("node").over(cell.orderBy("node"))).where("NOT node <=> before").drop("before")
    several = once.withColumn("size", F.count("*").over(cell)).where("size > 1")
    reach = several.withColumn("reach", (F.col("n") - F.col("at") + 1e-3) * ((1 + LEAST) / LEAST) - F.col("n"))
    mutual = F.lit(False)
    for k, order in (("less", [F.col("n"), F.col("node")]), ("more", [F.col("n").desc(), F.col("node").desc()])):
        others = cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        reach = reach.withColumns({f"{k}_far": F.max("reach").over(others), f"{k}_n": F.min("n").over(others)})
        mutual = mutual | F.coalesce((F.col(f"{k}_far") >= F.col("n")) & (F.col(f"{k}_n") <= F.col("reach")), F.lit(False))
    return reach.where(mutual).select("cell", "node", "n", "at").withColumn("size", F.count("*").over(cell)).where("size > 1")


def alike_prints(marked: DataFrame) -> DataFrame:
    """Edges (u, v) of nodes whose fingerprints are equal or differ in two bits or fewer."""
    held = pin(marked.select("fp", "node").distinct())
    named = pin(held.groupBy("fp").agg(F.min("node").alias("first")))
    same = held.join(named, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    a, b = (named.select(F.col("fp").alias(k), F.col("first").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    near = simhash.links(named.select("fp")).join(a, "u").join(b, "v").where("a <> b")
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, root) of the components of near copies; nodes without an edge are left out."""
    edges = pin(alike_prints(marked))
    graph = pin(connected_components(edges))

    cells = pin(_open(pin(meeting(postings(docs))), graph).drop("comp"))
    keys = pin(marked.groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("odd").alias("odd")))
    repeated = pin(marked.groupBy("row_key").agg(F.count("*").alias("times")).where("times > 1"))

    def texts(pairs: DataFrame) -> DataFrame:
        return texts_of(docs, keys, repeated, pairs)

    tried = None
    for turns in ([0], [*range(1, LEADERS)]):  # further leaders at once: each round takes dozens of jobs
        now = _open(cells.where(F.col("size") > CROWDED) if 0 not in turns else cells, graph, turns).withColumn("lead", F.explode("leads"))
        pairs = now.where(
            (F.col("comp") != F.col("lead.comp")) & _may_reach(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
        pairs = pairs.select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs, _ = small(pairs)
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = pin(alike(pin(_allowed(pairs, keys)), texts))
        if not found.isEmpty():
            edges = edges.unionByName(found)
            graph = pin(connected_components(edges))

    rest = _open(cells, graph).join(keys.select("node", "odd"), "node")
    a, b = (rest.select("cell", *[F.col(c).alias(c + k) for c in ("node", "n", "at", "comp", "odd")]) for k in "uv")
    pairs = a.join(b, "cell").where(
        (F.col("nodeu") < F.col("nodev")) & (F.col("compu") != F.col("compv"))
        & _may_reach(F.col("nu"), F.col("atu"), F.col("nv"), F.col("atv"))
        & _parities_allow(F.col("nu"), F.col("oddu"), F.col("nv"), F.col("oddv"))).withColumnsRenamed({"nodeu": "u", "nodev": "v"})
    pairs = pairs.select("u", "v").distinct()
    pairs = pin(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
    if pairs.isEmpty():
        return graph
    return connected_components(edges.unionByName(pin(alike(pairs, texts))))


def _allowed(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The pairs (u, v) that their parities allow; ``keys``: (node, n, odd)."""
    a, b = (keys.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("odd").alias("odd" + k)).join(pairs, k) for k in "uv")
    return a.join(b, ["u", "v"]).where(_parities_allow(F.col("nu"), F.col("oddu"), F.col("nv"), F.col("oddv"))).select("u", "v")


def _open(cells: DataFrame, graph: DataFrame, turns: Sequence[int] = ()) -> DataFrame:
    """``cells`` with each node's component and the cell's leaders of some turns, without cells of one component."""
    named = cells.join(graph, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    cell = Window.partitionBy("cell")
    several = named.withColumns({"low": F.min("comp").over(cell), "high": F.max("comp").over(cell)})
    if turns:
        leads = [F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "at", "comp")).over(cell) for turn in turns]
        several = several.withColumn("leads", F.array(*leads))
    return several.where("low <> high").drop("low", "high")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns of ``docs``: the one of the smallest id.

    Of rows repeated with that same id one stays; a component without any id keeps
    one of its rows.
    """
    marked = pin(marks(docs))
    graph = pin(links(docs, marked))
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least")).join(graph, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = pin(nodes.join(roots, "root").select("node", "root", "component_id"))
    found = marked.select("doc_id", "row_key", "node").join(named, "node").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min("row_key").alias("row_key")).select("row_key")
    # rows left out, and those of which one stays, are told apart; all others go through unsent
    told = marked.groupBy("row_key").agg(F.count("*").alias("times")).join(first.withColumn("stays", F.lit(True)), "row_key", "left")
    told = pin(told.where("stays IS NULL OR times > 1").select(F.col("row_key").alias("_key"), F.coalesce("stays", F.lit(False)).alias("stays")))
    size, more = told.agg(F.count("*"), F.count_if("stays")).first()
    maybe = docs.withColumn("_key", row_key())
    kept = None
    if size <= BROADCAST_ROWS:
        told = F.broadcast(told)
    else:
        bits = docs.sparkSession.sparkContext.broadcast(bit_sets(told.select(F.col("_key").alias("k")), "true")[0])
        hit = F.pandas_udf(lambda k: pd.Series(maybe_in(bits.value, k.to_numpy())), "boolean")(F.col("_key"))
        kept, maybe = maybe.where(~hit), maybe.where(hit)
    others = maybe.join(told, "_key", "left_anti")
    kept = others if kept is None else kept.unionByName(others)
    if more:
        kept = kept.unionByName(maybe.join(told.where("stays"), "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*docs.columns)
