"""Merkle manifest of a dataset with octopus multiproofs.

Every document is a leaf; the leaves of a part (its language) stand in the order of
their ids under a tree of eight children a node, and the parts' roots stand under one
more tree.  Leaves are hashed natively; only digests move from there on.

A leaf partition is a run of ``8 ** BLOCK_LEVELS`` leaves, so no task holds more, however
large a part is.  Each builds its interior nodes and hands its top node on; rounds of the
same step build the trees above.  To prove its leaves, a partition computes the
coordinates of the nodes that the proofs of all its leaves need together and that it
cannot derive itself (``missing``), fetches them in one join, derives the shared
interiors again from its leaves, and expands every leaf's proof locally.

Defined results: null fields are hashed as ``-``; the part null comes first; null ids come
before others; equal ids stand in the order of their digests, so repeated rows get equal
leaves side by side; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import global_row_number
from tidemark.session import pin

ARITY = 8
#: A leaf partition is a subtree of so many levels: 512 leaves.
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the parts' roots.
TOP = -1
NODE = "tree bigint, level int, idx bigint, digest binary"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256 of the fields, each as byte count, colon and value, or ``-`` if null."""
    coded = []
    for v in values:
        s = v.cast("string")
        coded.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*coded), 256))


def depth_of(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def level_up(digests: list[str]) -> list[str]:
    return [digest_of("".join(digests[i : i + ARITY])) for i in range(0, len(digests), ARITY)]


def missing(known: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(level, node numbers) of all nodes that proofs of the leaves ``known`` need and
    that cannot be derived from those leaves, in a tree of ``n`` leaves."""
    out = []
    known = np.unique(known)
    for level in range(depth_of(n)):
        size = -(-n // ARITY**level)
        runs = np.unique(known // ARITY)
        children = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(children[children < size], known, assume_unique=True)))
        known = runs
    return out


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # tree, idx, n (leaves of the tree), digest, and the caller's columns
    nodes: DataFrame  # tree, level, idx, digest: tops of leaf partitions and all nodes above
    trees: int  # number of parts


def _rows(tree: int, level: int, first: int, digests: list[str]) -> pa.Table:
    k = len(digests)
    return pa.table({
        "tree": pa.array([tree] * k, pa.int64()),
        "level": pa.array([level] * k, pa.int32()),
        "idx": pa.array(range(first, first + k), pa.int64()),
        "digest": pa.array([bytes.fromhex(d) for d in digests], pa.binary()),
    })


def _raise(nodes: DataFrame, base: int) -> DataFrame:
    """Nodes of the next levels over all nodes (tree, n, idx, digest) of level ``base``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        depth = depth_of(table.column("n")[0].as_py())
        order = np.argsort(table.column("idx").to_numpy())
        raw = table.column("digest").to_pylist()
        digests = [raw[i].hex() for i in order]
        parts, first = [], block * BLOCK
        for level in range(base + 1, min(base + BLOCK_LEVELS, depth) + 1):
            digests, first = level_up(digests), first // ARITY
            parts.append(_rows(tree, level, first, digests))
        return pa.concat_tables(parts) if parts else _rows(tree, 0, 0, [])

    keyed = nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))
    return keyed.groupBy("tree", "block").applyInArrow(run, NODE)


def _build(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of all levels over leaves (tree, n, idx, digest) of trees (tree, n); an action."""
    deepest = depth_of(sizes.agg(F.max("n")).first()[0] or 0)
    out = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest")
    level, base = leaves, 0
    while base < deepest:
        made = pin(_raise(level.select("tree", "n", "idx", "digest"), base))
        out = out.unionByName(made)
        base += BLOCK_LEVELS
        level = made.where(F.col("level") == base).join(sizes, "tree").where(F.col("n") > ARITY**base)
    return out


def build(leaves: DataFrame, order: Sequence[str]) -> Manifest:
    """Manifest over leaves: columns ``part``, ``digest``, those of ``order`` and others; an action."""
    own = [c for c in leaves.columns if c != "part"]
    named = leaves.withColumn("part", F.coalesce(F.concat(F.lit("="), F.col("part").cast("string")), F.lit("")))
    by = [*[F.col(c).asc_nulls_first() for c in order], F.col("digest")]
    ranked = global_row_number(pin(named), "part", by, "idx")
    counted = ranked.groupBy("part").agg(F.count("*").alias("n")).withColumn("all", F.lit(TOP))
    parts = pin(global_row_number(counted, "all", [F.col("part").asc()], "tree"))
    placed = pin(ranked.join(parts, "part").select("tree", "n", "idx", *own))
    sizes = parts.select("tree", "n")
    at_root = F.col("level") == sum((F.col("n") > ARITY**k).cast("int") for k in range(21))
    # below a partition's top every node can be derived from the partition's leaves
    lower = _build(placed, sizes).join(sizes, "tree").where((F.col("level") >= BLOCK_LEVELS) | at_root)
    trees = parts.count()
    roots = lower.where(at_root).select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("n"), F.col("tree").alias("idx"), "digest")
    top = _build(roots, roots.select("tree", "n").distinct())
    return Manifest(placed, lower.select("tree", "level", "idx", "digest").unionByName(top), trees)


def _requests(blocks: DataFrame, trees: int) -> DataFrame:
    """Coordinates of all nodes that each leaf partition (tree, block, n) has to fetch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for tree, block, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n"))):
                own = np.arange(block * BLOCK, min(n, (block + 1) * BLOCK))
                for node_tree, known, size in ((tree, own, n), (TOP, np.array([tree]), trees)):
                    # what the proofs need, and the root they are held against
                    for level, idx in [*missing(known, size), (depth_of(size), np.array([0]))]:
                        for column, v in zip(out, (tree, block, node_tree, level)):
                            column.extend([v] * len(idx))
                        out[4].extend(idx.tolist())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds)], ["tree", "block", "node_tree", "level", "idx"])

    return blocks.mapInArrow(run, "tree bigint, block bigint, node_tree bigint, level int, idx bigint")


def _path(node: int, n: int, first: int, got: dict[tuple[int, int], str]) -> list[tuple[str, str]]:
    """Siblings left and right of a node of level ``first`` and of its ancestors."""
    out = []
    for level in range(first, depth_of(n)):
        size, run = -(-n // ARITY**level), node // ARITY * ARITY
        left = "".join(got[level, i] for i in range(run, node))
        right = "".join(got[level, i] for i in range(node + 1, min(run + ARITY, size)))
        out.append((left, right))
        node //= ARITY
    return out


def prove(manifest: Manifest, key: str, claimed: str) -> DataFrame:
    """One row a leaf: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``claimed`` names the column with the digest that is folded with the leaf's proof.
    """
    trees = manifest.trees
    leaves = manifest.leaves.withColumn("block", F.expr(f"idx div {BLOCK}"))
    requests = _requests(leaves.groupBy("tree", "block").agg(F.first("n").alias("n")), trees)
    nodes = manifest.nodes.select(F.col("tree").alias("node_tree"), "level", "idx", "digest")
    fetched = requests.join(nodes, ["node_tree", "level", "idx"])
    kind = leaves.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(at: tuple[pa.Scalar, ...], table: pa.Table, above: pa.Table) -> pa.Table:
        tree, block = at[0].as_py(), at[1].as_py()
        got: dict[int, dict[tuple[int, int], str]] = {tree: {}, TOP: {}}
        for t, level, i, d in zip(*(above.column(c).to_pylist() for c in ("node_tree", "level", "idx", "digest"))):
            got[t][level, i] = d.hex()
        order = np.argsort(table.column("idx").to_numpy())
        table = table.take(pa.array(order))
        n = table.column("n")[0].as_py()
        levels = [[d.hex() for d in table.column("digest").to_pylist()]]
        for _ in range(min(BLOCK_LEVELS, depth_of(n))):
            levels.append(level_up(levels[-1]))
        inner = len(levels) - 1
        upper = _path(block, n, inner, got[tree]) + _path(tree, trees, 0, got[TOP])
        paths = {0: upper}
        for level in range(inner - 1, -1, -1):  # from the partition's top to its leaves
            below = {}
            for i in range(len(levels[level])):
                run_ = i // ARITY * ARITY
                here = ("".join(levels[level][run_:i]), "".join(levels[level][i + 1 : run_ + ARITY]))
                below[i] = [here, *paths[i // ARITY]]
            paths = below
        subroot, root = got[tree][depth_of(n), 0], got[TOP][depth_of(trees), 0]
        proofs, folded = [], []
        for i, d in enumerate(table.column(claimed).to_pylist()):
            proofs.append(digest_of("".join([side for pair in paths[i] for side in pair])))
            node = d.hex()
            for left, right in paths[i]:
                node = digest_of(left + node + right)
            folded.append(node)
        k = len(folded)
        return pa.table({
            key: table.column(key), "leaf": pa.array(levels[0]), "subroot": pa.array([subroot] * k), "root": pa.array([root] * k),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded])})

    return leaves.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(run, schema)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered_text(key: Column, text: Column) -> Column:
    """A-Z lowered where 3 divides the crc32 of the key's text."""
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` and the proofs of all rows, a third of them held against a tampered text; an action."""
    fields = [F.col(c) for c in FIELDS]
    changed = [*fields[:-1], tampered_text(F.col("doc_id"), F.col("text"))]
    leaves = docs.select("doc_id", F.col("lang").alias("part"), leaf_digest(fields).alias("digest"), leaf_digest(changed).alias("claimed"))
    return prove(build(leaves, ["doc_id"]), "doc_id", "claimed")


def audit_sql(docs: str = "documents", levels: int = 7, top_levels: int = 4) -> str:
    """SQL twin of ``audit`` for at most 8 ** levels rows a language and 8 ** top_levels languages."""
    def coded(c: str) -> str:
        s = f"CAST({c} AS VARCHAR)"
        return f"coalesce(CAST(octet_length(encode({s})) AS VARCHAR) || ':' || {s}, '-')"

    leaf = "sha256(" + " || ".join(map(coded, FIELDS)) + ")"
    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    claimed = "sha256(" + " || ".join(map(coded, [*FIELDS[:-1], f"CASE WHEN hit THEN {lowered} ELSE text END"])) + ")"
    bits = """flatten(list_transform(range(0, length(s)), lambda i: list_transform(range(0, 8), lambda j: (ord(substr(s, i + 1, 1)) >> j) & 1)))"""
    crc = f"""xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

    def tree(name: str, base: str, key: str, size: str, depth: int) -> str:
        """CTEs name0..nameD: (key, i, digest, sibs, left, right) by level."""
        out = [f"{name}0 AS (SELECT {key}, i, digest FROM {base})"]
        for k in range(depth):
            out.append(f"""{name}s{k} AS (SELECT {key}, i, digest, count(*) OVER (PARTITION BY {key}) AS n,
              coalesce(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY {key}, i // {ARITY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY {key}, i // {ARITY} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (SELECT {key}, i // {ARITY} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE any_value(digest) END AS digest
              FROM {name}s{k} GROUP BY {key}, i // {ARITY})""")
        return ", ".join(out)

    def climb(name: str, source: str, on: str, depth: int, at: str) -> str:
        """CTEs that take (.., i, proof, folded) through all levels of a tree."""
        out, last = [], source
        for k in range(depth):
            out.append(f"""{name}{k} AS (SELECT x.* REPLACE (x.proof || t.l || t.r AS proof,
              CASE WHEN t.n > 1 THEN sha256(t.l || x.folded || t.r) ELSE x.folded END AS folded, x.{at} // {ARITY} AS {at})
              FROM {last} x JOIN {on}s{k} t ON t.i = x.{at} AND t.g = x.{'g' if on == 'a' else 'one'})""")
            last = f"{name}{k}"
        return ", ".join(out)

    return f"""
    WITH marked AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM {docs}),
    hits AS (SELECT *, coalesce({crc} % 3 = 0, false) AS hit FROM marked),
    leaves AS (SELECT doc_id, lang, {leaf} AS digest, {claimed} AS claimed FROM hits),
    placed AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM leaves),
    {tree("a", "placed", "g", "n", levels)},
    subroots AS (SELECT 0 AS g, g AS i, digest FROM a{levels}),
    {tree("b", "subroots", "g", "n", top_levels)},
    start AS (SELECT doc_id, g, g AS gi, 0 AS one, i, digest AS leaf, '' AS proof, claimed AS folded FROM placed),
    {climb("c", "start", "a", levels, "i")},
    {climb("d", f"c{levels - 1}", "b", top_levels, "gi")}
    SELECT doc_id, leaf, a{levels}.digest AS subroot, b{top_levels}.digest AS root, sha256(proof) AS proof_sha256,
      folded AS folded_root, folded = b{top_levels}.digest AS verified
    FROM d{top_levels - 1} x JOIN a{levels} ON a{levels}.g = x.g JOIN b{top_levels} ON true"""
