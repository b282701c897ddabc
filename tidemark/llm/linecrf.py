"""Document quality: a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad.  A line's potential is linear in its
own statistics and in those of the lines before and after it; neighbouring labels are
tied by a transition matrix.  Forward and backward messages of all lines of a slice
are computed together as products of 2 x 2 matrices in doubling steps, so a text of a
million lines takes twenty passes, not a million.  A document's score is the mean of
its lines' marginals of being good, weighted by their lengths.

Labels belong to documents.  Training starts with every line labelled like its
document and then labels the lines of bad documents anew, round by round: those that
the model holds for good become good, as long as one line of the document stays bad.

Defined results: a null text, an empty one or one without a word has no good line and
scores 0; without labels of both classes every text with a word scores the share of good
labels (0.5 if there is none).  Null ``doc_id`` is scored and never trained on; a column
named ``quality_score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import fold, slices, string_bytes, sums_between, texts, word_codes

GOOD, BAD = 1, 0
#: Labelled rows of each class the field is fitted on, and lines of those rows, at most.
MAX_TRAIN_PER_CLASS = 1500
MAX_TRAIN_LINES = 100_000
#: Text bytes scored at a time.
SLICE = 2 << 20
STEPS, ROUNDS, ROUND_STEPS, RATE, RIDGE = 150, 3, 60, 0.1, 1e-4
NAME = "quality_score"


def _classes() -> np.ndarray:
    """Byte classes as bits: letter, upper, digit, symbol, exclamation, stop, bar, space, other bytes of a code point."""
    table = np.zeros((256, 9), np.uint8)
    for k, members in enumerate((
        [*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)], range(65, 91), range(48, 58), b"#*$%&<>@^~_=+\\{}[]",
        b"!?", b".,;:", b"|", [32, *range(9, 14)], range(0x80, 0xC0),
    )):
        table[list(members), k] = 1
    return table


CLASSES = _classes()


@dataclass(frozen=True)
class Lines:
    at: np.ndarray  # offsets of each text's lines
    own: np.ndarray  # statistics, one row a line
    size: np.ndarray  # code points


def lines_of(text: pa.Array) -> Lines:
    """Statistics of all lines that hold a word, of whole texts."""
    split = pc.split_pattern(text, "\n")
    lines = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    word_at, codes, words = word_codes(lines)
    full = np.diff(word_at) > 0
    at = np.concatenate([[0], np.cumsum(full)])[offsets]
    lines = lines.filter(pa.array(full))
    word_at = np.concatenate([word_at[:-1][full], word_at[-1:]])
    n = len(lines)
    if not n:
        return Lines(at, np.zeros((0, WIDTH), np.float32), np.zeros(0))
    byte_at, raw = string_bytes(lines)
    n_bytes = np.diff(byte_at)
    share = np.stack([np.add.reduceat(CLASSES[raw, k], byte_at[:-1], dtype=np.int64) for k in range(CLASSES.shape[1])], 1).astype(float)
    letters, upper, digits, symbols, shouts, stops, bars, spaces, tails = share.T
    size = n_bytes - tails
    black = np.maximum(size - spaces, 1)
    n_words = np.diff(word_at).astype(float)
    line = np.repeat(np.arange(n), np.diff(word_at))
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    pairs = np.unique(line * (len(words) + 1) + codes)
    distinct = np.bincount(pairs // (len(words) + 1), minlength=n)
    # lines that stand in the text more than once
    coded = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, back, often = np.unique(doc * (coded.max() + 1) + coded, return_inverse=True, return_counts=True)
    first, last = raw[byte_at[:-1]], raw[byte_at[1:] - 1]
    mean = sums_between(word_at, length.astype(float)) / n_words
    own = np.stack([
        np.log1p(n_words), n_words <= 3, mean / 10, np.maximum.reduceat(length, word_at[:-1]).clip(0, 60) / 20,
        letters / black, upper / np.maximum(letters, 1), upper > 0.5 * letters, digits / black,
        symbols / black, np.minimum(symbols / black, 0.05) * 20, shouts / black, np.minimum(shouts / black, 0.05) * 20,
        stops / black, bars / black, np.minimum(bars / n_words, 0.2) * 5,
        sums_between(word_at, same) / n_words, np.minimum(sums_between(word_at, same) / n_words, 0.1) * 10,
        distinct / n_words, distinct < 0.5 * n_words,
        sums_between(word_at, (length <= 3).astype(float)) / n_words, sums_between(word_at, (length > 12).astype(float)) / n_words,
        np.isin(last, np.frombuffer(b".?!:;\"'", np.uint8)), ((first >= 65) & (first <= 90)) | (first >= 0x80),
        often[back.reshape(-1)] > 1,
    ], 1)
    return Lines(at, own.astype(np.float32), size)


WIDTH = 24


def with_neighbours(at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own statistics, those of the lines before and after in the same text, and whether there are such lines."""
    n = len(own)
    has = np.zeros((n, 2), np.float32)
    has[1:, 0] = has[:-1, 1] = 1
    starts = at[:-1][np.diff(at) > 0]
    has[starts, 0] = 0
    has[at[1:][np.diff(at) > 0] - 1, 1] = 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.concatenate([own, before * has[:, :1], after * has[:, 1:], has], 1)


def _products(step: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First rows of the products of a chain's 2 x 2 matrices up to each place, scaled, in doubling steps.

    ``step`` holds the four entries of each element's matrix, ``place`` its place in the chain.
    """
    out = step.copy()
    reach, longest = 1, int(place.max()) + 1 if len(place) else 0
    i = np.flatnonzero(place >= reach)
    while reach < longest:
        a, b, c, d = out[:, i - reach]
        e, f, g, h = out[:, i]
        made = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
        out[:, i] = made / made.max(0)
        reach *= 2
        i = i[place[i] >= reach]
    return out[:2]


def marginals(at: np.ndarray, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and the joint table of every line with the one before.

    ``node`` holds log potentials of (bad, good), ``edge`` those of (label before, label).
    A chain's first line has no line before; its table is zero.
    """
    n = len(node)
    size = np.diff(at)
    place = np.arange(n) - np.repeat(at[:-1], size)
    rest = np.repeat(at[1:], size) - 1 - np.arange(n)
    e = np.exp(node - node.max(1, keepdims=True)).T
    t = np.exp(edge - edge.max()).ravel()[:, None]
    step = t * e[[0, 1, 0, 1]]
    step[:, place == 0] = e[[0, 1, 0, 1]][:, place == 0]  # no label before: both rows alike
    forward = _products(step, place)
    # backward: from the chain's end; a line's matrix is that of the line after it, transposed
    after = e[:, np.minimum(np.arange(n) + 1, max(n - 1, 0))]
    step = t[[0, 2, 1, 3]] * after[[0, 0, 1, 1]]
    step[:, rest == 0] = 1.0
    flip = np.arange(n) - place + rest
    backward = _products(step[:, flip], place)[:, flip]
    both = forward * backward
    prev = forward[:, np.maximum(np.arange(n) - 1, 0)]
    joint = prev[[0, 0, 1, 1]] * t * (e * backward)[[0, 1, 0, 1]]
    joint /= joint.sum(0)
    joint[:, place == 0] = 0
    return both[GOOD] / both.sum(0), joint.T.reshape(n, 2, 2)


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of being good
    bias: float
    edge: np.ndarray  # 2 x 2
    prior: float | None = None  # the only answer if training had one class or none

    def line_scores(self, lines: Lines) -> np.ndarray:
        x = (with_neighbours(lines.at, lines.own) - self.mean) / self.scale
        z = np.clip(x @ self.weight + self.bias, -30, 30)
        return marginals(lines.at, np.stack([np.zeros(len(z)), z], 1), self.edge)[0]

    def scores(self, lines: Lines) -> np.ndarray:
        """Share of each text, by length, that is good."""
        p = self.line_scores(lines) if self.prior is None else np.full(len(lines.size), self.prior)
        total = sums_between(lines.at, lines.size.astype(float))
        return np.clip(sums_between(lines.at, p * lines.size) / np.maximum(total, 1), 0, 1)


def train(at: np.ndarray, own: np.ndarray, label: np.ndarray) -> LineField:
    """Fit on the lines of labelled texts (1 good, 0 bad) by gradient steps on the likelihood."""
    doc = np.repeat(np.arange(len(label)), np.diff(at))
    wide = with_neighbours(at, own).astype(np.float64)
    width = 3 * WIDTH + 2
    if len(label) == 0 or len(np.unique(label[doc])) < 2:
        share = 0.5 if len(label) == 0 else float(np.mean(label))
        return LineField(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), share)
    mean, scale = wide.mean(0), wide.std(0) + 1e-3
    x = (wide - mean) / scale
    n_docs = len(label)
    # every document weighs alike, and both classes do
    per_doc = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    size = np.maximum(np.diff(at), 1)
    weight_of_line = (per_doc / size)[doc]
    y = label[doc].astype(int)
    w, b, edge = np.zeros(width), 0.0, np.zeros((2, 2))
    place = np.arange(len(doc)) - np.repeat(at[:-1], np.diff(at))
    inner = np.flatnonzero(place > 0)
    moment = [np.zeros(width + 5), np.zeros(width + 5)]
    done = 0

    def steps(count: int) -> None:
        nonlocal w, b, edge, done
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1], y[inner]), weight_of_line[inner])
        for _ in range(count):
            z = np.clip(x @ w + b, -30, 30)
            p, joint = marginals(at, np.stack([np.zeros(len(z)), z], 1), edge)
            d = weight_of_line * (p - y)
            expected = (joint[inner] * weight_of_line[inner, None, None]).sum(0)
            g = np.concatenate([x.T @ d + RIDGE * w, [d.sum()], (expected - seen + RIDGE * edge).ravel()])
            done += 1
            moment[0] = 0.9 * moment[0] + 0.1 * g
            moment[1] = 0.99 * moment[1] + 0.01 * g * g
            move = RATE * (moment[0] / (1 - 0.9**done)) / (np.sqrt(moment[1] / (1 - 0.99**done)) + 1e-8)
            w, b, edge = w - move[:width], b - move[width], edge - move[width + 1 :].reshape(2, 2)

    steps(STEPS)
    for _ in range(ROUNDS):
        z = np.clip(x @ w + b, -30, 30)
        p, _ = marginals(at, np.stack([np.zeros(len(z)), z], 1), edge)
        worst = np.full(n_docs, np.inf)
        np.minimum.at(worst, doc, p)
        y = np.where(label[doc] == 1, 1, ((p > 0.5) & (p > worst[doc])).astype(int))
        steps(ROUND_STEPS)
    return LineField(mean, scale, w, b, edge)


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int = MAX_TRAIN_PER_CLASS, most_lines: int = MAX_TRAIN_LINES) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled rows and ``most_lines`` lines of each class, by hash order.

    Ids are joined with their labels first and texts read by the ids chosen, which are
    bounded and may be broadcast.  Rows of the held-out fifth and null ids stay out.
    """
    ids = docs.where(fold("doc_id", 5) > 0).select("doc_id").distinct()
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1)).distinct().join(ids, F.col("_id") == F.col("doc_id"), "left_semi")
    sample = None
    for value in (BAD, GOOD):
        chosen = marked.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        part = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    order = Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    return sample.withColumn("_lines", F.sum(lines).over(order)).where(F.col("_lines") <= most_lines).select("text", "_label")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_TRAIN_PER_CLASS, most_lines: int = MAX_TRAIN_LINES) -> LineField:
    """Field fitted on the sample; tasks turn its texts into line statistics, which alone are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            lines = lines_of(texts(batch))
            own = [lines.own[a:b].tobytes() for a, b in zip(lines.at, lines.at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(own, pa.binary())], ["label", "own"])

    rows = sample_labelled(docs, labels, per_class, most_lines).mapInArrow(run, "label int, own binary").collect()
    parts = [np.frombuffer(r.own, np.float32).reshape(-1, WIDTH) for r in rows]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    own = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)
    return train(at, own, np.array([r.label for r in rows], np.int64))


def score(docs: DataFrame, model: LineField) -> DataFrame:
    """Add ``quality_score`` (0 to 1) to the documents' own columns."""
    docs = docs.drop(NAME) if NAME in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            found = shared.value.scores(lines_of(texts(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, NAME])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{NAME} double"])
    return docs.mapInArrow(run, schema)
