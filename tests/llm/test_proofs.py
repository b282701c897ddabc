"""Merkle manifest and fill-in-middle against brute force on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, merkle
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, duck

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, part string, idx string, fim_text string, n string, row string"
LONG = "word after Word. And\nmore é𝄞 " * 30_000


def odd(spark, texts):
    rows = [(i, t, [None, "en", "", "é"][i % 4], f"s{i % 3}", i, *"abcdef") for i, t in enumerate(texts)]
    rows += [(None,) * 11, (0, "", None, None, 0, *"abcdef"), (0, "", None, None, 0, *"abcdef"), (1, "Other", "en", None, 0, *"abcdef")]
    return spark.createDataFrame(rows, DOCS)


TEXTS = ["One two three", "", "  Lead ", "a <P> b", "x<S>", "<M>", "ÄÖ ß é 𝄞𝄞 𝄞", "$1 \\ $0 {2}", "line\nline\r\n\n", LONG, "A", "<P", *("Text %d" % i for i in range(60))]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def siblings(levels, i):
    """(left, right) of node i of the lowest level and of its ancestors."""
    for nodes in levels[:-1]:
        a = i - i % 8
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])
        i //= 8


def levels_over(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r) for r in rows if r.lang == lang), key=lambda x: x[:3])
        trees[lang] = (own, levels_over([x[2] for x in own]))
    top = levels_over([trees[lang][1][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for i, (_, _, digest, r) in enumerate(own):
            path = [*siblings(levels, i), *siblings(top, k)]
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) if hit else digest
            for a, b in path:
                node = sha(a + node + b)
            out.append((r.doc_id, digest, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_levels", [1, 3])
def test_manifest_by_brute_force(spark, monkeypatch, block_levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**block_levels)
    for docs in (odd(spark, TEXTS), odd(spark, [f"Text {i}" for i in range(700)]).withColumn("lang", F.expr("if(doc_id % 9 = 0, lang, 'en')")), odd(spark, [])):
        got = sorted(map(tuple, merkle.audit(docs).collect()), key=repr)
        assert got == brute(docs.collect())
    many = odd(spark, [f"t{i}" for i in range(30)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id")))
    assert sorted(map(tuple, merkle.audit(many).collect()), key=repr) == brute(many.collect())
    assert merkle.audit(odd(spark, ["x"]).limit(0)).count() == 0


def test_missing_nodes_are_the_least_that_do():
    rng = random.Random(5)
    for n in (1, 2, 8, 9, 64, 65, 513, 600):
        for k in (1, 2, 7, n):
            known = sorted(rng.sample(range(n), min(n, k)))
            asked = [(lv, i) for lv, idx in merkle.missing(np.array(known), n) for i in idx.tolist()]
            have = {(0, i) for i in known}
            need = set()
            for lv in range(merkle.depth_of(n)):
                size = -(-n // 8**lv)
                for i in [i for lw, i in have if lw == lv]:
                    have.add((lv + 1, i // 8))
                    need |= {(lv, j) for j in range(i // 8 * 8, min(size, i // 8 * 8 + 8))}
            assert sorted(asked) == sorted(need - have) and len(set(asked)) == len(asked)


def test_fill_in_middle_by_brute_force(spark):
    docs = odd(spark, TEXTS)
    out = fim.transform(docs)
    assert out.columns == [c for c in docs.columns if c != "fim_text"] + list(fim.RESULTS)
    forms = set()
    for r in out.select("*", fim.restore(F.col("fim_text"), F.col("fim_form")).alias("back")).collect():
        text = r.text or ""
        h = [int(sha(f"1:{'' if r.doc_id is None else r.doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(text) + 1) for x in h[:2])
        p, m, s = text[:a], text[a:b], text[b:]
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        forms.add(form)
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.fim_form, r.fim_text, r.back, r.fim_units) == (form, want, text, len(text))
        assert (r.fim_prefix, r.fim_middle) == ((None, None) if plain else (a, b - a))
    assert forms == {"plain", "psm", "spm"} and out.count() == len(TEXTS) + 4
    assert fim.transform(docs.limit(0)).count() == 0
    assert {r.fim_form for r in fim.transform(docs, plain_percent=100).collect()} == {"plain"}
    assert "psm" not in {r.fim_form for r in fim.transform(docs, plain_percent=0, spm_percent=100).collect()}


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_fill_in_middle"])
def test_proof_queries(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), QUERIES[name], ORACLE_SQL[name], sf_dir) is None
