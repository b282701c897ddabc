"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lowered, everything else is one space; runs of one to three characters
are hashed into a fixed table.  Counts of all training documents are summed per task
and language before they are shuffled; the matrix of log probabilities, whose size is
languages times buckets, is broadcast, and a batch is scored by gathering its columns.

Defined results: a null text or one without a letter is ``und`` with score 0; without
any training row every text is ``und``; equal scores go to the first language in
alphabetical order.  More than ``MOST_LANGUAGES`` languages raise an error, because
the matrix is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import fold, slices, sums_between, texts

BUCKET_BITS = 16
GRAMS = 3
#: Text bytes a task turns into n-grams at a time.
SLICE = 1 << 20
MOST_LANGUAGES = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _lowered() -> np.ndarray:
    """Lowered letter of each code point, 32 for anything that is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def hashed_grams(text: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n-gram length the offsets and buckets of every text, and whether a text has a letter.

    Repeated spaces count once, and no n-gram crosses two texts.
    """
    rows = text.to_pylist()
    raw = np.frombuffer("\n".join(rows).encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(size + 1) - 1
    chars = _lowered()[raw]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size + 1)[: len(chars)]
    letter = chars != 32
    has = np.bincount(doc[letter], minlength=len(rows)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a letter
    keep[ends[:-1]] = False
    chars, doc = chars[keep], doc[keep]
    grams = []
    code = np.zeros(len(chars), np.uint64)
    for k in range(1, GRAMS + 1):
        m = max(0, len(chars) - k + 1)
        code = (code[:m] ^ chars[k - 1 : k - 1 + m]) * MIX
        code ^= code >> np.uint64(31)
        own = doc[:m] == doc[k - 1 : k - 1 + m]
        bucket = ((code[own] * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        grams.append((np.concatenate([[0], np.cumsum(np.bincount(doc[:m][own], minlength=len(rows)))]), bucket))
    return grams, has


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, most=SLICE):
            grams, _ = hashed_grams(texts(batch))
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in set(names):
                total.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                for at, buckets in grams:
                    total[name] += np.bincount(buckets[np.repeat(names == name, np.diff(at))], minlength=1 << BUCKET_BITS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            # a language without n-grams still counts as learnt
            at = at if len(at) else np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, bucket bigint, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    def __init__(self, langs: list[str], log_p: np.ndarray, log_prior: np.ndarray):
        self.langs, self.log_p, self.log_prior = langs, log_p, log_prior


def fit(docs: DataFrame) -> LanguageModel:
    """Counts of all documents with a language outside the held-out quarter."""
    rows = docs.where((fold("doc_id", 4) != 2) & (fold("doc_id", 4) >= 0) & F.col("lang").isNotNull())
    n_docs = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(n_docs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their matrix would not be bounded")
    langs = sorted(n_docs)
    counts = np.zeros((len(langs), 1 << BUCKET_BITS))
    if langs:
        got = gram_counts(rows).toPandas()
        number = {name: i for i, name in enumerate(langs)}
        counts[got["lang"].map(number).to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    prior = np.array([n_docs[x] for x in langs], float)
    smooth = counts + 0.1
    return LanguageModel(langs, np.log(smooth / smooth.sum(1, keepdims=True)), np.log(prior / max(prior.sum(), 1)))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score): score is the posterior of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p.astype(np.float32), model.log_prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, log_p, log_prior = shared.value
        for batch in slices(batches, most=SLICE):
            grams, has = hashed_grams(texts(batch))
            if not langs:
                has[:] = False
            total = np.zeros((max(1, len(langs)), len(has)))
            for i, row in enumerate(log_p):
                for at, buckets in grams:
                    total[i] += sums_between(at, row[buckets].astype(np.float64))
            total = total + log_prior[:, None] if langs else total
            best = total.argmax(0)
            score = 1 / np.exp(np.maximum(total - total.max(0), -700)).sum(0)
            names = [langs[b] if ok else "und" for b, ok in zip(best, has)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
