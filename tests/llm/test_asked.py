"""Suffix tree: a block asks for each key once, and only its answers stay on disk."""

import os

import numpy as np

from tidemark.llm import suffixtree
from tidemark.session import shared_dir


def test_a_block_asks_for_a_key_once(spark):
    text = " ".join(f"w{i}" for i in range(1000)) + " "
    docs = spark.createDataFrame([(k, text * 1800, 0) for k in range(3)] + [(3, text, 1)], "doc_id int, text string, block int").coalesce(1)
    none = spark.sparkContext.broadcast(np.zeros(1 << (64 - suffixtree.CELL_SHIFT), np.uint64))
    assert docs.selectExpr("max(length(text))").first()[0] > 6 << 20  # a slice each
    asked = suffixtree.block_keys(docs, none, none).groupBy("block").count().collect()
    assert {r.block: r["count"] for r in asked} == {0: 1001, 1: 1001}


def test_scoring_leaves_its_answers(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(k, f"one two three four {k % 7} " * 20) for k in range(60)], "doc_id long, text string")
    found = suffixtree.score(docs)
    assert [f.split("-")[0] for f in set(os.listdir(folder)) - before] == ["answered"]
    rows = found.collect()
    assert len(rows) == 60 and all(r.score < 0 and r.n_tokens == 101 for r in rows)
