"""Token ids in binary files: frequency ranks in a byte-aligned code with control bytes.

Ids are replaced by their rank of frequency over all documents, so common ids take
one byte.  Four ranks share a control byte of four two-bit lengths (one to four
bytes each); control bytes and data bytes stand apart, so a block is decoded by
looking up lengths and offsets of all control bytes at once in numpy.

File format (all numbers little-endian).  A file is a run of blocks; every block is

    4 bytes   magic "TMI1"
    4 bytes   bytes of the block after this field and before the end mark
    8 bytes   shard number
    8 bytes   block number in the shard
    4 bytes   documents d
    4 bytes   ids n
    8 d       document ids (the least number for null)
    4 d       ids of each document
    c         control bytes: a quarter of each document's ids, rounded up
    rest      data bytes
    1 byte    end mark 0x0A

Shards are ranges of ascending (doc_id, checksum of the ids, salt of the row), so rows
repeated under one id are cut like any others, and hold ``SHARD_IDS`` ids or so each.
Their borders come from a sort of these narrow keys alone.  Blocks are written by
Spark's line writer, whose line end is the end mark: files appear only when a task
commits, on any file system Spark knows, so a lost executor leaves nothing half done.
The ranks are written beside them as a Parquet table of at most one row per id of the
vocabulary.

Defined results: a null or empty text is the end id alone; a null ``doc_id`` sorts
first; rows repeated under one id follow each other, ordered by their ids' checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import crc_of_ids, slices, texts
from tidemark.llm.tokens import encoder, with_end
from tidemark.session import pin, scratch_path

MAGIC = b"TMI1"
HEADER = np.dtype([("magic", "S4"), ("size", "<u4"), ("shard", "<i8"), ("block", "<i8"), ("docs", "<u4"), ("ids", "<u4")])
NO_ID = -(1 << 63)
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 20
#: Ids of a shard, about: a file is read back whole by one task.
SHARD_IDS = 1 << 24
#: lengths[c] are the four byte counts of control byte c.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def _slots(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control slots of runs of n numbers: where each run's start, whole bytes a run, and the slot of every number."""
    at = np.concatenate([[0], np.cumsum(-(-n // 4) * 4)])
    first = np.cumsum(n) - n
    return at, np.arange(n.sum()) + np.repeat(at[:-1] - first, n)


def encode_runs(ranks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each run's control bytes, all control bytes, offsets of its data bytes, all data bytes."""
    r = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    at, place = _slots(n)
    slots = np.zeros(at[-1], np.uint8)
    slots[place] = size - 1
    four = slots.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    data_at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n)])]
    return at // 4, control, data_at, r.view(np.uint8).reshape(-1, 4)[used]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    _, control, _, data = encode_runs(ranks, np.array([len(ranks)]))
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int | np.ndarray) -> np.ndarray:
    """The numbers of one or several runs again, by table lookup of all control bytes at once."""
    _, place = _slots(np.atleast_1d(n).astype(np.int64))
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[place]
    out = np.zeros((len(place), 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def encode_block(shard: int, block: int, doc_ids: list[int], sizes: list[int], control: list[bytes], data: list[bytes]) -> bytes:
    """A block of documents whose runs are encoded already."""
    body = b"".join([np.array(doc_ids, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), *control, *data])
    head = np.zeros(1, HEADER)
    head["magic"], head["size"], head["shard"], head["block"] = MAGIC, HEADER.itemsize - 8 + len(body), shard, block
    head["docs"], head["ids"] = len(doc_ids), sum(sizes)
    return head.tobytes() + body


def decode_file(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, block, document ids, sizes, ranks) of every block."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, HEADER, 1, at)[0]
        if head["magic"] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        end = at + 8 + int(head["size"])
        d = int(head["docs"])
        p = at + HEADER.itemsize
        doc_ids = np.frombuffer(content, "<i8", d, p)
        sizes = np.frombuffer(content, "<u4", d, p + 8 * d)
        p += 12 * d
        control = content[p : p + int((-(-sizes.astype(np.int64) // 4)).sum())]
        yield int(head["shard"]), int(head["block"]), doc_ids, sizes, decode_ranks(control, content[p + len(control) : end], sizes)
        if content[end : end + 1] != b"\n":
            raise ValueError(f"block at byte {at} has no end mark")
        at = end + 1


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, tie, n, ids): whole texts as 32-bit little-endian ids with the end id, written once.

    ``tie`` orders rows of one id: the ids' checksum, then a number of the row itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() * 0x9E3779B1
        for batch in slices(batches):
            at, ids = with_end(*encoder(tokenizer, False).encode(texts(batch)), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            cut = [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]
            salt = (row + np.arange(len(cut), dtype=np.int64) * 0x85EBCA6B) & 0xFFFFFFFF
            row += 0x27D4EB2F * len(cut)
            check = np.fromiter((zlib.crc32(x) for x in cut), np.int64, len(cut))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(((check - (1 << 31)) << 32) | salt), pa.array(np.diff(at)),
                pa.array(map(bytes, cut), pa.binary())], ["doc_id", "tie", "n", "ids"])

    return pin(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, tie bigint, n bigint, ids binary"))


def ranked(tokens: DataFrame) -> DataFrame:
    """(id, rank): ids by falling count over all documents, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4"))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # the vocabulary bounds this window
    return pin(counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank")))


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary array without nulls."""
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def borders(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, tie) at which each shard but the first begins; one row a shard is collected.

    Only the keys are sorted: the rows' ids are neither read nor encoded for it.
    """
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(-(-total // SHARD_IDS), 2 * spark.sparkContext.defaultParallelism)
    keys = tokens.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "tie")
    dealt = keys.repartitionByRange(shards, "doc_id", "tie").groupBy(F.spark_partition_id().alias("part"))
    first = sorted((r.low.doc_id, r.low.tie) for r in dealt.agg(F.min(F.struct("doc_id", "tie")).alias("low")).collect())[1:]
    return np.array([d for d, _ in first], np.int64), np.array([t for _, t in first], np.int64)


def shard_of(doc: np.ndarray, tie: np.ndarray, border_ids: np.ndarray, border_ties: np.ndarray) -> np.ndarray:
    """Number of borders at or before each (doc, tie)."""
    low, high = np.searchsorted(border_ids, doc, "left"), np.searchsorted(border_ids, doc, "right")
    out = low.astype(np.int32)
    tied = np.flatnonzero(high > low)
    for a in np.unique(low[tied]):  # documents at whose id a border stands
        rows = tied[low[tied] == a]
        out[rows] += np.searchsorted(border_ties[a : high[rows[0]]], tie[rows], "right").astype(np.int32)
    return out


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Write ``path``/blocks and ``path``/ranks."""
    spark = docs.sparkSession
    tokens = tokenised(docs, tokenizer, end_id)
    ranks = ranked(tokens)
    ranks.write.parquet(f"{path}/ranks")
    table = ranks.toPandas()  # at most the vocabulary
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table["id"].to_numpy(np.int64)] = table["rank"].to_numpy(np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    border_ids, border_ties = borders(tokens)

    def as_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's shard, and its ids as ranks in their code: what is shuffled is already small."""
        for batch in slices(batches, "ids"):
            n = batch.column("n").to_numpy()
            _, raw = binary_bytes(batch.column("ids"))
            parts = encode_runs(shared.value[raw.view("<u4")], n)
            control, data = (
                pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
                for at, x in (parts[:2], parts[2:]))
            doc = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            shard = shard_of(doc, batch.column("tie").to_numpy(), border_ids, border_ties)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), batch.column("doc_id"), batch.column("tie"), batch.column("n"), control, data],
                ["shard", "doc_id", "tie", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        rows: tuple[list, ...] = ([], [], [], [])

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_block(shard, block, *rows)], pa.binary())], ["block"])

        total = 0
        for batch in slices(batches, "data"):
            ids = pc.fill_null(batch.column("doc_id"), NO_ID)
            for row in zip(ids.to_pylist(), *(batch.column(c).to_pylist() for c in ("n", "control", "data"))):
                for column, v in zip(rows, row):
                    column.append(v)
                total += row[1]
                if total >= BLOCK_IDS:
                    yield close()
                    rows, total, block = ([], [], [], []), 0, block + 1
        if rows[0]:
            yield close()

    coded = tokens.mapInArrow(as_ranks, "shard int, doc_id bigint, tie bigint, n bigint, control binary, data binary")
    # the shard's number is the partition's: no sampling, so nothing is encoded twice
    shards = coded.repartitionById(len(border_ids) + 1, "shard").sortWithinPartitions("doc_id", "tie")
    shards.mapInArrow(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.option(
        "compression", "none").text(f"{path}/blocks")


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, and with ``keep_ids`` its ids.

    ``start``, the ids of all documents before, comes from the shards' totals.
    """
    table = spark.read.parquet(f"{path}/ranks").toPandas()  # at most the vocabulary
    id_of = np.zeros(len(table), np.uint32)
    id_of[table["rank"].to_numpy(np.int64)] = table["id"].to_numpy(np.uint32)
    shared = spark.sparkContext.broadcast(id_of)
    names = ["shard", "block", "at", "doc_id", "n_tokens", "ids_crc32"] + (["ids"] if keep_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard, block, doc_ids, sizes, ranks in decode_file(content.as_py()):
                    ids = shared.value[ranks]
                    ends = np.cumsum(sizes.astype(np.int64))
                    starts = ends - sizes
                    parts = [ids[a:b] for a, b in zip(starts, ends)]
                    columns = [
                        pa.array([shard] * len(parts), pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(starts),
                        pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(sizes.astype(np.int64)),
                        pa.array([crc_of_ids(p) for p in parts], pa.int64())]
                    if keep_ids:
                        columns.append(pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)
    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    rows = pin(files.mapInArrow(run, schema))
    size = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    # one row a shard: what the window over all of them sorts is the number of shards
    whole = size.groupBy(F.col("shard").alias("s")).agg(F.sum("n").alias("all"))
    whole = whole.select("s", (F.sum("all").over(Window.orderBy("s")) - F.col("all")).alias("first"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    before = size.withColumn("inside", inside).join(whole, F.col("shard") == F.col("s")).select(
        "s", F.col("block").alias("b"), (F.col("first") + F.col("inside")).alias("before"))
    out = rows.join(before, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")))
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write(docs, tokenizer, end_id, path)
    return read(spark, path)
