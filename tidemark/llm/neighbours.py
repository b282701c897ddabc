"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors.  A vector is represented by its nearest
pivots in order; every pivot has an inverted file of the vectors that have it among
their first ``PREFIX`` pivots, with the place it takes there.  A query reads the files
of its own first ``PROBES`` pivots and adds up places that agree, which ranks the
candidates of one length by (prefix) footrule distance.  Pivots see directions only, so
the agreement is turned into an expected cosine by a line fitted in the shard.  Less the
cosine that a candidate of its length needs to be a neighbour, that orders candidates of
all lengths; the best of them are ranked again by the exact inner product.

How many are ranked again is measured, not set: for ``TRIED`` queries of a block all
candidates of the shard are ranked exactly, and as many are taken for every query as
hold the share ``TARGET`` of those queries' true neighbours, ``RERANK_LEAST`` at least.
Where pivots tell little, as among vectors of many independent components, that number
rises towards all of them and the search towards an exact one.

The index is cut into shards of rows, each with its own inverted files, and the query
set into blocks; a task joins one block with one shard, so neither a hot pivot nor a
hot vector lands in one task.  Equal vectors of a shard are one candidate, which is
expanded to its smallest ids afterwards.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; rows repeated under one ``vec_id`` count
as one if equal (the smallest vector by order otherwise); null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import pin

#: Pivots: a documented bound of the sample the index is fitted on.
PIVOTS = 128
PREFIX = 64
PROBES = 64
#: Least number of a shard's candidates that are ranked exactly.
RERANK_LEAST = 400
#: Queries of a block that are tried against all of a shard, and the share of their
#: neighbours that the candidates ranked exactly have to hold.
TRIED, TARGET = 48, 0.97
SHARD_ROWS, BLOCK_QUERIES = 16_384, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): finite non-zero vectors of the commonest length, one per id."""
    v = F.col("embedding").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return rows
    return rows.where(F.size("v") == common.n).groupBy("vec_id").agg(F.min("v").alias("v"))


class Shard:
    """Inverted files over the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX):
        order = np.argsort(ids)
        self.vectors, self.copy_of = np.unique(vectors[order], axis=0, return_inverse=True)
        self.copy_of = self.copy_of.reshape(-1)
        # ids of each distinct vector, ascending
        by = np.argsort(self.copy_of, kind="stable")
        self.ids = ids[order][by]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(self.copy_of))])
        self.pivots, self.prefix = pivots, min(prefix, len(pivots))
        self.length = np.linalg.norm(self.vectors, axis=1)
        self.needs, self.slope, self.ranked = np.zeros(len(self.vectors)), 1.0, len(self.vectors)
        places = nearest(self.vectors, pivots, self.prefix)
        by_pivot = np.argsort(places.reshape(-1), kind="stable")
        self.members = by_pivot // self.prefix
        self.ranks = (by_pivot % self.prefix).astype(np.int32)
        self.files = np.concatenate([[0], np.cumsum(np.bincount(places.reshape(-1), minlength=len(pivots)))])

    def agreement(self, own_pivots: np.ndarray) -> np.ndarray:
        """The greatest footrule of prefixes less that to a query, for each vector."""
        agree = np.zeros(len(self.vectors), np.int32)
        for place, p in enumerate(own_pivots):
            a, b = self.files[p], self.files[p + 1]
            agree[self.members[a:b]] += self.prefix - np.maximum(self.ranks[a:b], place)
        return agree

    def calibrate(self, queries: np.ndarray, probes: np.ndarray, k: int) -> None:
        """Fit the expected cosine and the number ranked exactly on some queries."""
        agree = [self.agreement(p) for p in probes]
        exact = [(self.vectors * q).sum(1) for q in queries]
        x = np.concatenate(agree).astype(float)
        y = np.concatenate([e / self.length / np.linalg.norm(q) for e, q in zip(exact, queries)])
        spread = x.var()
        self.slope = float(max(((x - x.mean()) * (y - y.mean())).mean(), 0.0) / spread) if spread > 0 else 0.0
        # a query's k-th best inner product over its length: what a candidate has to reach
        last = min(k, len(self.vectors)) - 1
        reach = np.median([np.sort(e)[::-1][last] / np.linalg.norm(q) for e, q in zip(exact, queries)])
        self.needs = reach / self.length
        needed = []
        for a, e in zip(agree, exact):
            place = np.empty(len(e), np.int64)
            place[np.argsort(-self.likely(a), kind="stable")] = np.arange(len(e))
            # one more than k, as a query may be among the candidates itself
            needed.append(place[np.argsort(-e, kind="stable")[: k + 1]])
        needed = np.sort(np.concatenate(needed))
        self.ranked = max(RERANK_LEAST, int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1)

    def likely(self, agree: np.ndarray) -> np.ndarray:
        """The expected cosine, but for a constant, less the one needed."""
        return self.slope * agree - self.needs

    def search(self, query: np.ndarray, own_pivots: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best found, the id ``skip`` left out."""
        likely = self.likely(self.agreement(own_pivots))
        n = min(len(likely), self.ranked)
        chosen = np.arange(len(likely))
        if n < len(likely):  # candidates level with the last one are taken as well
            chosen = np.flatnonzero(likely >= np.partition(likely, len(likely) - n)[len(likely) - n])
        score = (self.vectors[chosen] * query).sum(1)
        if len(chosen) > k + 1:
            top = np.argpartition(-score, k)
            least = score[top[k]]
            keep = score >= least  # ties are settled by id
            chosen, score = chosen[keep], score[keep]
        ids, scores = [], []
        for c, s in zip(chosen, score):
            own = self.ids[self.at[c] : min(self.at[c + 1], self.at[c] + k + 1)]
            ids.append(own)
            scores.append(np.full(len(own), s))
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        keep = ids != skip
        ids, scores = ids[keep], scores[keep]
        first = np.lexsort((ids, -scores))[:k]
        return ids[first], scores[first]


def nearest(vectors: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Numbers of each vector's ``n`` nearest pivots in order, by inner product of directions."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def fit_pivots(rows: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """``n`` distinct directions, by hash order of the vectors."""
    got = rows.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(n).collect()
    found = np.array([r.v for r in got], float)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest found of every vector whose id is divisible by ``every``."""
    rows = pin(usable(vectors))
    total = rows.count()
    pivots = rows.sparkSession.sparkContext.broadcast(fit_pivots(rows))
    shards = max(1, -(-total // SHARD_ROWS))
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    indexed = rows.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), "vec_id", "v")

    def run(key: tuple, own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(own) or not len(wanted):
            return empty
        index = Shard(own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy()), pivots.value)
        vectors_ = np.stack(wanted["v"].to_numpy())
        probes = nearest(vectors_, pivots.value, min(PROBES, len(pivots.value)))
        tried = np.argsort(wanted["vec_id"].to_numpy(np.int64), kind="stable")[:TRIED]
        index.calibrate(vectors_[tried], probes[tried], k)
        out = []
        for q, v, p in zip(wanted["vec_id"].to_numpy(np.int64), vectors_, probes):
            ids, scores = index.search(v, p, k, q)
            out.append((np.full(len(ids), q), ids, scores))
        parts = [np.concatenate(c) for c in zip(*out)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))

    found = indexed.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
        run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
