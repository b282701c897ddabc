"""Sum-of-squares packing of token ids into windows of fixed capacity.

A document longer than the capacity first fills whole windows; what is left is placed
online.  A level array counts the partially filled windows at each fill; the next
piece goes to the fill level (or a new window) after which the sum of the squared
counts is least.  Every task packs the documents it reads with a level array of its
own, so nothing is shuffled.

When a task's documents end, the windows still open are poured together: contents of
the least filled ones are cut to fill the fullest, until one window is left at most.
Its content is cut into pieces of powers of two, which need no padding.

Defined results: a null or empty text is its end id alone; repeated rows are packed
once each; the same input partition packs the same way on a rerun.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.batches import crc_of_ids, slices, texts
from tidemark.llm.tokens import encoder, with_end

CAPACITY = 1024
#: Sequences a task can number; task t counts from t times this.
TASK_STRIDE = 1 << 36


class Levels:
    """Open windows by fill, with the sum-of-squares rule."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # window numbers by fill
        self.fill: dict[int, int] = {}
        self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of a piece of at most the capacity."""
        top = self.capacity - size
        n = self.count
        # change of the sum of squares: leave level h, enter level h + size
        change = np.concatenate([2 * n[size : size + top] + 1, [0]])
        change[1:] -= 2 * n[1 : top + 1] - 1
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        low = change.min()
        level = int(np.flatnonzero(change == low)[-1])  # of equals the fullest
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window, self.next = self.next, self.next + 1
        filled = level + size
        if filled < self.capacity:
            self.open[filled].append(window)
            self.count[filled] += 1
            self.fill[window] = filled
        else:
            self.fill.pop(window, None)
        return window, level

    def whole(self) -> int:
        window, self.next = self.next, self.next + 1
        return window

    def left_over(self) -> list[tuple[int, int]]:
        """(fill, window) of open windows, fullest first."""
        return sorted(((f, w) for w, f in self.fill.items()), key=lambda x: (-x[0], x[1]))


def pour(left: list[tuple[int, int]], capacity: int, first: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Cuts of open windows: window -> [(from, to, new window, new offset)], and the next free number.

    The fullest window is filled from the least filled one's end, again and again;
    the last one's content is laid out in powers of two.
    """
    moves: dict[int, list[tuple[int, int, int, int]]] = {w: [] for _, w in left}
    rest = {w: f for f, w in left}
    target = first
    order = [w for _, w in left]
    i, j = 0, len(order) - 1
    while i < j:
        need = capacity - (rest[order[i]] + sum(b - a for w in moves.values() for a, b, t, _ in w if t == order[i]))
        give = min(need, rest[order[j]])
        donor = order[j]
        moves[donor].append((rest[donor] - give, rest[donor], order[i], capacity - need))
        rest[donor] -= give
        if give == need:
            i += 1
        if not rest[donor]:
            j -= 1
    if order and i == j:
        # the last window's own ids, then what was poured in, laid out in powers of two
        last = order[i]
        content = [(last, 0, rest[last])]
        for w, cuts in moves.items():
            content += [(w, a, b) for a, b, t, _ in cuts if t == last]
            moves[w] = [c for c in cuts if c[2] != last]
        size = sum(b - a for _, a, b in content)
        rest[last] = 0
        room, offset = 0, 0
        for w, a, b in content:
            while a < b:
                if not room:
                    room = 1 << (size.bit_length() - 1)
                    size -= room
                    target, first, offset = first, first + 1, 0
                n = min(room, b - a)
                moves[w].append((a, a + n, target, offset))
                a, room, offset = a + n, room - n, offset + n
    for w, size in rest.items():
        if size:
            moves[w].append((0, size, w, 0))
    return moves, first


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece; with ``keep_ids`` the piece's ids as little-endian 32-bit binary.

    ``tokenizer``: path of a byte-level tokenizer file every executor has.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7
    if keep_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * TASK_STRIDE
        levels = Levels(capacity)
        held: dict[int, list] = {}  # pieces of open windows, which may still be cut
        out: list[list] = [[] for _ in names]

        def emit(doc, start, ids, total, window, offset) -> None:
            row = (doc, start, len(ids), crc_of_ids(ids), total, base + window, offset)
            for column, value in zip(out, (*row, ids.astype("<u4").tobytes()) if keep_ids else row):
                column.append(value)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
            for c in out:
                c.clear()
            return batch

        for batch in slices(batches):
            at, ids = with_end(*encoder(tokenizer, True).encode(texts(batch)), end_id)
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[at[i] : at[i + 1]]
                total = len(own)
                full = total - total % capacity
                for a in range(0, full, capacity):
                    emit(doc, a, own[a : a + capacity], total, levels.whole(), 0)
                if full < total:
                    window, offset = levels.place(total - full)
                    held.setdefault(window, []).append((doc, full, own[full:].copy(), total, offset))
                    if window not in levels.fill:
                        for d, s, piece, t, o in held.pop(window):
                            emit(d, s, piece, t, window, o)
            yield flush()
        moves, levels.next = pour(levels.left_over(), capacity, levels.next)
        for window, cuts in moves.items():
            for doc, start, piece, total, offset in held.pop(window):
                for a, b, to, new in cuts:
                    low, high = max(a, offset), min(b, offset + len(piece))
                    if low < high:
                        emit(doc, start + low - offset, piece[low - offset : high - offset], total, to, new + low - a)
        yield flush()

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
