"""The line field: messages and likelihood by enumeration, held-out accuracy, odd inputs."""

import itertools
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import linecrf
from tidemark.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality_score string, _label string, _id string, _lines string"
LONG = "a line of words, Like any other.\n" * 40_000


def odd(spark, texts):
    rows = [(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [(None,) * 9, (0, "", None, None, 0, *"abcd"), (0, "", None, None, 0, *"abcd")]
    return spark.createDataFrame(rows, DOCS)


def enumerated(node, edge):
    """Marginals of being good and pair tables of one chain, over all labellings."""
    n = len(node)
    total, p, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(node[i, y] for i, y in enumerate(labels)) + sum(edge[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        for i, y in enumerate(labels):
            p[i] += w * y
            if i:
                joint[i, labels[i - 1], y] += w
    return p / total, joint / total


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    at = np.array([0, 1, 1, 6, 9, 9, 18])
    for scale in (0.5, 3, 15):
        node, edge = rng.normal(0, scale, (18, 2)), rng.normal(0, 2, (2, 2))
        p, joint = linecrf.marginals(at, node, edge)
        for a, b in zip(at, at[1:]):
            if b > a:
                want_p, want_joint = enumerated(node[a:b], edge)
                assert np.allclose(p[a:b], want_p, atol=1e-12) and np.allclose(joint[a:b], want_joint, atol=1e-12)
    none, tables = linecrf.marginals(np.array([0, 0]), np.zeros((0, 2)), np.zeros((2, 2)))
    assert len(none) == len(tables) == 0


def test_line_statistics_and_neighbours():
    got = linecrf.lines_of(pa.array(["", "One two\n\n  \nTHREE!! four\nOne two", "é | é | x1"], pa.large_string()))
    assert got.at.tolist() == [0, 0, 3, 4] and got.size.tolist() == [7, 12, 7, 10]
    assert got.own.shape == (4, linecrf.WIDTH) and np.isfinite(got.own).all()
    assert np.allclose(got.own[:, 0], np.log1p([2, 2, 2, 5]))
    assert got.own[:, -1].tolist() == [1, 0, 1, 0]  # lines that stand there twice
    wide = linecrf.with_neighbours(got.at, got.own)
    w = linecrf.WIDTH
    assert (wide[1, w : 2 * w] == got.own[0]).all() and (wide[1, 2 * w : 3 * w] == got.own[2]).all()
    assert wide[:, -2:].tolist() == [[0, 1], [1, 1], [1, 0], [0, 0]]


def test_score_is_the_length_weighted_share_of_good_lines():
    """A text's score, by enumeration from the model's own potentials."""
    rng = np.random.default_rng(2)
    width = 3 * linecrf.WIDTH + 2
    model = linecrf.LineField(np.zeros(width), np.ones(width), rng.normal(0, 0.3, width), -0.2, rng.normal(0, 1, (2, 2)))
    text = ["Good words here.\nAND! BAD! | | x\nmore words follow\n\nthe last one", "single", ""]
    lines = linecrf.lines_of(pa.array(text, pa.large_string()))
    z = linecrf.with_neighbours(lines.at, lines.own) @ model.weight + model.bias
    got = model.scores(lines)
    for k, (a, b) in enumerate(zip(lines.at, lines.at[1:])):
        if a == b:
            assert got[k] == 0
        else:
            p, _ = enumerated(np.stack([np.zeros(b - a), z[a:b]], 1), model.edge)
            assert abs(got[k] - (p * lines.size[a:b]).sum() / lines.size[a:b].sum()) < 1e-9


def test_held_out_accuracy_and_odd_inputs(spark):
    rows = duckdb.sql("SELECT doc_id, text, quality FROM '/root/testdata/sf0.01/documents.parquet' JOIN '/root/testdata/sf0.01/labels.parquet' USING (doc_id)").fetchall()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "w") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = linecrf.fit(docs, labels)
    scored = linecrf.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "quality_score"] + ["quality_score"]
    got = {r.doc_id: r.quality_score for r in scored.collect()}
    test = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 50 and np.mean([(s >= 0.3) == bool(q) for s, q in test]) > 0.95
    assert all(s >= 0.3 for s, q in test if q)
    new = odd(spark, ["word", " \n\t\n", "a\n" * 50_000, LONG, "x" * 100_000, "é\x0b\r\n"])
    out = linecrf.score(new, model).collect()
    assert len(out) == 9 and all(0 <= r.quality_score <= 1 for r in out)
    assert all(r.quality_score == 0 for r in out if not (r.text or "").strip())
    assert linecrf.score(new.limit(0), model).count() == 0


def test_sample_bounds_and_classes(spark):
    docs = spark.createDataFrame([(i, f"a {i}\nb", "en", "s", 1, "", "", "", "") for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    assert linecrf.sample_labelled(docs, labels, per_class=9).groupBy("_label").count().where("count = 9").count() == 2
    assert linecrf.sample_labelled(docs, labels, most_lines=11).groupBy("_label").count().where("count = 5").count() == 2
    assert linecrf.sample_labelled(docs, labels).where("false").count() == 0
    none = labels.limit(0)
    assert {r.quality_score for r in linecrf.score(docs, linecrf.fit(docs, none)).collect()} == {0.5}
    ones = labels.withColumn("quality", F.lit(1))
    assert {r.quality_score for r in linecrf.score(docs, linecrf.fit(docs, ones)).collect()} == {1.0}


def test_query_covers_every_document(spark, sf_dir):
    got = QUERIES["op12_line_field_quality"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
