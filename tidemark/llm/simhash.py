"""SimHash near-duplicates: popcount embedding, grid join, exact check, components.

The 64-bit fingerprint is cut into segments; the vector of their bit counts embeds
fingerprints so that Manhattan distance never exceeds the Hamming distance.  Two
lattice points at distance two or less share a point at distance one or less from
both, so each fingerprint is posted to its own cell and to the cells one step away,
and only fingerprints that meet in a cell are compared exactly.

Crowded cells: pairs are formed only where at most ``MOST_IN_CELL`` fingerprints
meet.  Fingerprints of fuller cells take an exact way without pairs: each is posted
under itself and its 64 one-bit changes; those at distance two or less share such a
key, and no key can hold more than 65 distinct fingerprints.

Defined results: no words (null or empty text) gives fingerprint zero; fewer than
``words`` words make one shingle; equal fingerprints always link.  Rows with a null
``doc_id`` get a fingerprint and take the smallest non-null id of their component
(null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import slices
from tidemark.llm.components import connected_components
from tidemark.llm.suffixtree import small
from tidemark.session import pin

SEGMENTS = 16
SEGMENT_BITS = 64 // SEGMENTS
MOST_IN_CELL = 48
MOST_BITS = 2
#: Base of the cell number: bit counts shifted by one step run from -1 to 5.
CELL_BASE = SEGMENT_BITS + 3
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the XXH64 bits of all word shingles, as an unsigned integer."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        part = [tokens[a + i : b + i] for i in range(words)] if len(tokens) >= words else [[t] for t in tokens]
        h = np.fromiter((h64(join(g), 42) for g in zip(*part)), np.uint64, b - a)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, row_key, fp): the fingerprint as a signed long, the key a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key bigint, fp bigint")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _cell(counts: list[Column]) -> Column:
    """One number for a lattice point; 7**16 fits a long."""
    out = F.lit(0).cast("bigint")
    for c in counts:
        out = out * F.lit(CELL_BASE) + c + F.lit(1)
    return out


def postings(fps: DataFrame) -> DataFrame:
    """(cell, fp, step): the fingerprint's own cell (step 0) and those one step away."""
    mask = (1 << SEGMENT_BITS) - 1
    counts = [
        F.bit_count(F.shiftrightunsigned(F.col("fp"), i * SEGMENT_BITS).bitwiseAND(F.lit(mask).cast("bigint"))).cast("bigint")
        for i in range(SEGMENTS)
    ]
    place = [CELL_BASE ** (SEGMENTS - 1 - i) for i in range(SEGMENTS)]
    moves = [(0, 0)] + [(s * (i + 1), s * place[i]) for i in range(SEGMENTS) for s in (1, -1)]
    steps = F.array(*[F.struct(F.lit(c).cast("tinyint").alias("step"), F.lit(d).cast("bigint").alias("d")) for c, d in moves])
    return fps.select("fp", _cell(counts).alias("home")).select(
        "fp", "home", F.explode(steps).alias("m")).select(
        (F.col("home") + F.col("m.d")).alias("cell"), "fp", F.col("m.step").alias("step"))


def links(fps: DataFrame, most_in_cell: int = MOST_IN_CELL) -> DataFrame:
    """Edges (u, v) whose components are those of "Hamming distance two or less".

    ``fps``: distinct fingerprints (fp).  Pairs of sparse cells come out themselves;
    those of crowded cells through shared one-bit changes.
    """
    # Spark judges postings by the fingerprints before the explode, 33 times too low: what is sent is counted
    posted = postings(fps)
    sizes, _ = small(posted.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    meeting, _ = small(posted.join(sizes, "cell"))
    sparse = meeting.where(F.col("n") <= most_in_cell)
    a = sparse.select(F.col("cell"), F.col("fp").alias("u"), F.col("step").alias("su"))
    b = sparse.select(F.col("cell").alias("cell_b"), F.col("fp").alias("v"), F.col("step").alias("sv"))
    # points moved alike meet in their own cells too
    met = a.join(b, (a.cell == b.cell_b) & (a.u < b.v) & ((a.su != b.sv) | (a.su == 0)) & (hamming("u", "v") <= MOST_BITS))
    crowded = meeting.where(F.col("n") > most_in_cell).select("fp").distinct()
    bits = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    shared = (
        crowded.select("fp", F.explode(bits).alias("bit"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("bit")).alias("key"))
        .agg(F.array_sort(F.collect_list("fp")).alias("all"))  # 65 at most
        .where(F.size("all") > 1)
        .select(F.col("all")[0].alias("u"), F.explode(F.slice("all", 2, 64)).alias("v"))
    )
    return met.select("u", "v").unionByName(shared).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) for every row of ``docs``."""
    marked = pin(fingerprints(docs, words))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    graph = connected_components(links(fps.select("fp")))
    joined = fps.join(graph, fps.fp == graph.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = pin(joined.join(roots, "root").select(F.col("fp").alias("_fp"), "root", "component_id"))
    return marked.join(named, marked.fp == named._fp).drop("_fp")


def keep_first(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each component, all columns of ``docs``: the one of the smallest id.

    Of rows repeated with that same id one stays; a component without any id keeps
    one of its rows.
    """
    found = near_duplicates(docs, words).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min("row_key").alias("_first")).select("_first")
    kept = docs.withColumn("_key", row_key()).join(first, F.col("_key") == F.col("_first"), "left_semi")
    return kept.dropDuplicates(["_key"]).select(*docs.columns)


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
