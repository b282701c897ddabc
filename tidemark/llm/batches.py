"""Arrow helpers for tasks: bounded slices, ASCII lower case, words as codes, folds."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes a task works on at a time; one longer text makes a slice of its own.
SLICE_BYTES = 6 << 20


_HELD: list[Callable[[], None]] = []


def held(release: Callable[[], None]) -> None:
    """Name a function that gives back what this worker keeps from one task to the next."""
    _HELD.append(release)


_LIBC = ctypes.CDLL(None)


def released() -> None:
    """Give back what earlier stages left in a reused worker, and memory that is unused."""
    for release in _HELD:
        release()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # where the C library keeps freed pages
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches where the texts reach ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size.astype(np.int64)) - 1).clip(0) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with null read as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[9:14] = 32
_FOLDED = _SPACED.copy()
_FOLDED[65:91] += 32


def _translated(text: pa.Array, table: np.ndarray) -> pa.Array:
    """A text array without nulls, its bytes looked up in a table that changes ASCII only."""
    at, raw = string_bytes(text)
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(table[raw]))


def spaced(text: pa.Array) -> pa.Array:
    """ASCII white space as spaces."""
    return _translated(text, _SPACED)


def folded(text: pa.Array) -> pa.Array:
    """ASCII white space as spaces, A-Z lowered."""
    return _translated(text, _FOLDED)


def word_lists(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and all words, A-Z lowered.

    Words are runs of anything but space and \\x09-\\x0D.
    """
    split = pc.split_pattern(folded(text), " ")
    flat = split.flatten()
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(full).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        flat = flat.filter(full)
    return at, flat


def word_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``word_lists``, the words as codes into a dictionary of distinct words."""
    at, flat = word_lists(text)
    coded = flat.dictionary_encode()
    return at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sums_between(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i, empty ranges being zero."""
    out = np.zeros(len(at) - 1, values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[full])
    return out


def string_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large-string array."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    n = len(words)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return at - at[0], raw


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; null keys count as -1, so no part."""
    key = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(-1).cast("bigint"))


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
