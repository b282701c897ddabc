"""Toxicity: averaged subword embeddings under a linear softmax, trained in numpy.

Every word is the mean of its vectors for the whole word and its character n-grams
(over UTF-8 bytes, with word-end marks), hashed into a fixed table.  A window of
words is the mean of its word vectors; one softmax layer on top is trained jointly
with the table.  A document's score is that of its most toxic window, so a few
insults in a long text are not averaged away.  Labels belong to documents, not to
windows; training therefore alternates: all windows of a toxic document count as
toxic first, later only the one the model finds most toxic.

Defined results: null and empty texts score as an empty window (the bias alone);
without labels of both classes every score is the share of toxic labels (0.5 if
there is none).  Null ``doc_id`` is scored and never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import fold, released, slices, string_bytes, sums_between, texts, word_codes

BUCKETS = 1 << 17
GRAMS = (3, 4, 5, 6)
DIM = 4
WINDOW = 16
#: Text bytes scored at a time: a distinct word has dozens of subwords.
SCORE_BYTES = 1 << 20
#: Training words whose subwords are at hand at a time.
TRAIN_WORDS = 20_000
#: A shorter text counts as filled up with words of no weight.
LEAST_WORDS = 4
#: Labelled rows of each class the classifier is fitted on, at most.
MAX_TRAIN_PER_CLASS = 1500
EMPTY_LOGIT = -6.0
RATE, FIRST_STEPS, ROUNDS, ROUND_STEPS = 0.2, 200, 6, 80


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray  # subword vectors
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray
    prior: float | None = None  # the only answer if training had one class or none

    def margins(self) -> np.ndarray:
        """Toxic minus clean logit of each subword; averaging is linear, so the layer
        can be folded into the table before scoring."""
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword, the whole word included."""
    at, raw = string_bytes(words)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # mark word ends: < word >
    marked = np.full(len(raw) + 2 * n, ord("<"), np.uint64)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    marked[np.arange(len(raw)) + 2 * owner + 1] = raw
    ends = at[1:] + 2 * np.arange(n) + 1
    marked[ends] = ord(">")
    whose = np.repeat(np.arange(n), size + 2)
    left = np.repeat(ends + 1, size + 2) - np.arange(len(marked))  # symbols to the word's end
    mix = np.uint64(0x9E3779B97F4A7C15)
    out_w, out_b = [], []
    code = np.zeros(len(marked), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        m = len(marked) - k + 1
        if m <= 0:
            break
        code = (code[:m] ^ marked[k - 1 :]) * mix
        code ^= code >> np.uint64(29)
        if k in GRAMS:
            at_k = np.flatnonzero(left[:m] >= k)
            out_w.append(whose[at_k])
            out_b.append(((code[at_k] * mix) >> np.uint64(47)).astype(np.int64))
    # the whole word: a polynomial over its bytes
    power = mix ** (np.arange(len(marked), dtype=np.uint64) - (ends - size - 1)[whose].astype(np.uint64) + np.uint64(1))
    whole = np.add.reduceat(marked * power, ends - size - 1)
    whole = (whole ^ (whole >> np.uint64(31))) * mix
    out_w.append(np.arange(n))
    out_b.append((whole >> np.uint64(47)).astype(np.int64))
    return np.concatenate(out_w), np.concatenate(out_b) % BUCKETS


def once(at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop words equal to the one before them, so a stuttered word weighs once."""
    keep = np.ones(len(codes), bool)
    keep[1:] = codes[1:] != codes[:-1]
    keep[at[:-1][at[:-1] < len(codes)]] = True
    return np.concatenate([[0], np.cumsum(keep)])[at], codes[keep]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class _Fit:
    """Joint training of table and softmax by Adagrad on minibatches of windows."""

    def __init__(self, words: pa.Array, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        # a word of n bytes has n + 3 - k grams of k bytes, and itself
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.count = 1 + sum(np.maximum(size + 3 - k, 0) for k in GRAMS)
        self.at = np.concatenate([[0], np.cumsum(self.count)])
        self.sub = np.empty(self.at[-1], np.int32)
        for a in range(0, len(words), TRAIN_WORDS):
            w, b = subwords(words.slice(a, TRAIN_WORDS))
            self.sub[self.at[a] : self.at[a] + len(b)] = b[np.argsort(w, kind="stable")]
        self.table = rng.normal(0, 0.1, (BUCKETS, DIM))
        self.weights = rng.normal(0, 0.5, (DIM, 2))
        self.bias = np.zeros(2)
        self.g_table = np.full((BUCKETS, DIM), 1e-8)
        self.g_weights = np.full((DIM, 2), 1e-8)
        self.g_bias = np.full(2, 1e-8)

    def word_vectors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.count[words]
        ends = np.cumsum(size)
        place = np.repeat(self.at[words] - (ends - size), size) + np.arange(size.sum())
        subs = self.sub[place]
        return np.add.reduceat(self.table[subs], ends - size, axis=0) / size[:, None], subs, size

    def step(self, windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        size = np.array([len(x) for x in windows])
        which = np.repeat(np.arange(len(windows)), size)
        uniq, inv = np.unique(np.concatenate(windows), return_inverse=True)
        vec, subs, n_sub = self.word_vectors(uniq)
        hidden = np.add.reduceat(vec[inv], np.cumsum(size) - size, axis=0) / size[:, None]
        p = _softmax(hidden @ self.weights + self.bias)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d *= weight[:, None]
        gw, gb = hidden.T @ d, d.sum(0)
        dh = (d @ self.weights.T) / size[:, None]
        gt = np.empty_like(self.table)
        for j in range(DIM):
            per_word = np.bincount(inv, dh[which, j], len(uniq)) / n_sub
            gt[:, j] = np.bincount(subs, np.repeat(per_word, n_sub), BUCKETS)
        for value, total, g in ((self.table, self.g_table, gt), (self.weights, self.g_weights, gw), (self.bias, self.g_bias, gb)):
            total += g * g
            value -= rate * g / np.sqrt(total)

    def steps(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, chosen: np.ndarray, y: np.ndarray,
              rate: float, steps: int, batch: int = 512) -> None:
        """Minibatches with as many windows of either class."""
        sides = [np.flatnonzero(y == v) for v in (0, 1)]
        for _ in range(steps):
            i = np.concatenate([self.rng.choice(s, batch // 2) for s in sides])
            self.step([codes[start[k] : stop[k]] for k in chosen[i]], y[i], np.full(len(i), 1 / len(i)), rate)

    def margins(self, words: int) -> np.ndarray:
        """Toxic minus clean logit of every training word."""
        s = self.table @ (self.weights[:, 1] - self.weights[:, 0])
        out = np.zeros(words)
        for a in range(0, words, TRAIN_WORDS):
            at = self.at[a : a + TRAIN_WORDS + 1]
            out[a : a + TRAIN_WORDS] = np.add.reduceat(s[self.sub[at[0] : at[-1]]], at[:-1] - at[0]) / np.diff(at)
        return out


def _constant(share: float) -> ToxicityModel:
    return ToxicityModel(np.zeros((BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2), share)


def train(text: list[str] | pa.Array, label: list[int]) -> ToxicityModel:
    """Fit on whole labelled texts."""
    y = np.asarray(label, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return _constant(0.5 if len(y) == 0 else float(y[0]))
    at, codes, words = word_codes(text.cast(pa.large_string()) if isinstance(text, pa.Array) else pa.array(text, pa.large_string()))
    at, codes = once(at, codes)
    released()  # what splitting the texts took
    pieces = -(-np.diff(at) // WINDOW)
    doc = np.repeat(np.arange(len(y)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    # a text's last window is whole as well
    start = np.maximum(at[:-1][doc], np.minimum(at[:-1][doc] + k * WINDOW, at[1:][doc] - WINDOW))
    stop = np.minimum(start + WINDOW, at[1:][doc])
    if len(np.unique(y[doc])) < 2:
        return _constant(float(y.mean()))
    fit = _Fit(words)
    every = np.arange(len(doc))
    fit.steps(codes, start, stop, every, y[doc], RATE, FIRST_STEPS)
    offset = lambda: fit.bias[1] - fit.bias[0]
    for _ in range(ROUNDS):
        total = np.concatenate([[0.0], np.cumsum(fit.margins(len(words))[codes])])
        score = (total[stop] - total[start]) / (stop - start)
        order = np.lexsort((-score, doc))
        top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        # of clean documents the worst windows count as often as all others
        clean = np.flatnonzero(y[doc] == 0)
        worst = top[y[doc[top]] == 0]
        # toxic documents without a window the model holds for toxic look mislabelled
        found = top[(y[doc[top]] == 1) & (score[top] + offset() > 0)]
        if not len(found):
            found = top[y[doc[top]] == 1]
        chosen = np.concatenate([found, clean, np.repeat(worst, -(-len(clean) // len(worst)))])
        fit.steps(codes, start, stop, chosen, y[doc[chosen]], RATE, ROUND_STEPS)
    return ToxicityModel(fit.table.astype(np.float32), fit.weights, fit.bias)


def window_scores(at: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Highest mean margin over any window of each text; windows overlap by half."""
    out = np.full(len(at) - 1, -np.inf)
    total = np.concatenate([[0.0], np.cumsum(margin)])
    half = WINDOW // 2
    n = np.diff(at)
    pieces = np.maximum(1, -(-(n - half) // half))
    doc = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = np.maximum(at[:-1][doc], np.minimum(at[:-1][doc] + k * half, at[1:][doc] - WINDOW))
    b = np.minimum(a + WINDOW, at[1:][doc])
    full = b > a
    np.maximum.at(out, doc[full], (total[b[full]] - total[a[full]]) / np.maximum(b - a, LEAST_WORDS)[full])
    return out


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int = MAX_TRAIN_PER_CLASS) -> DataFrame:
    """The bounded training sample: per class, rows outside the held-out fifth by hash order.

    Ids alone are joined with their labels; texts are read by the ids chosen, at most
    ``per_class`` of each class, which is what may be broadcast.
    """
    ids = docs.where(fold("doc_id", 5) > 0).select("doc_id").distinct()
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where(
        F.col("_toxic").isin(0, 1)).distinct().join(ids, F.col("_id") == F.col("doc_id"), "left_semi")
    sample = None
    for value in (0, 1):
        chosen = marked.where(F.col("_toxic") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        part = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    return sample.select(F.coalesce("text", F.lit("")).alias("text"), "_toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_TRAIN_PER_CLASS) -> ToxicityModel:
    rows = sample_labelled(docs, labels, per_class).toArrow()
    model = train(rows.column("text").combine_chunks(), rows.column("_toxic").to_pylist())
    del rows
    released()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``toxicity_score`` (0 to 1) to the documents' own columns, replacing one of that name."""
    name = "toxicity_score"
    docs = docs.drop(name) if name in docs.columns else docs
    margins = docs.sparkSession.sparkContext.broadcast(model.margins())
    offset, prior = float(model.bias[1] - model.bias[0]), model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        table = margins.value
        for batch in slices(batches, most=SCORE_BYTES):
            at, codes, words = word_codes(texts(batch))
            at, codes = once(at, codes)
            w, b = subwords(words)
            n = np.bincount(w, minlength=len(words))
            margin = np.bincount(w, table[b], len(words)) / np.maximum(n, 1)
            z = window_scores(at, margin[codes]) + offset
            z = np.where(np.isfinite(z), z, EMPTY_LOGIT)
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            if prior is not None:
                p = np.full(len(p), prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{name} double"])
    return docs.mapInArrow(run, schema)
