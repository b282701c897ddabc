"""Near copies: fingerprints take part, and crowded cells form few pairs."""

import random
from itertools import takewhile

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import nearcopies, simhash, suffixtree
from tidemark.session import pin

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    rng = random.Random(4)
    line = " ".join(f"r{i}" for i in range(11)) + "\n"
    texts = [line * 60 + " ".join(f"t{k}x{i}" for i in range(12)) for k in range(3)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(5)]
    sets, prints = [nearcopies.shingles(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    assert nearcopies.similarity(sets[0], sets[1]) < 0.8 and (prints[0] ^ prints[1]).bit_count() <= 2
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table(spark, texts), "").collect()}
    assert kept == {0, 3, 4, 5, 6, 7}


@pytest.mark.parametrize("own", [60, 24])
def test_texts_around_one_passage_form_few_pairs(spark, monkeypatch, own):
    """Passages shared by all, too little for a copy: 300 texts, 44,850 pairs, no link."""
    rng = random.Random(own)
    passage = [f"p{i}" for i in range(100)]
    texts = []
    for k in range(300):
        words = passage[:]
        for i in rng.sample(range(100), own // 6):  # changed words, so that copies share most cells
            words[i] = f"c{rng.randrange(10**9)}"
        texts.append(" ".join(words + [f"o{k}x{i}" for i in range(own // 3)]))
    formed = []
    alike = nearcopies.alike
    monkeypatch.setattr(nearcopies, "alike", lambda pairs, sets: formed.append(pairs.count()) or alike(pairs, sets))
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, texts), "")
    sets = [nearcopies.shingles(t) for t in texts]
    group = list(range(300))
    for i in range(300):
        for j in range(i):
            if group[i] != group[j] and (nearcopies.similarity(sets[i], sets[j]) >= 0.8 or (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() <= 2):
                group = [group[j] if g == group[i] else g for g in group]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(j for j in range(300) if group[j] == g) for g in group})
    assert sum(formed) < 6 * 300


def test_bounds_only_pass_too_many():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 9, nearcopies.BUCKETS).astype(np.uint8)
    for _ in range(2000):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        changed = rng.random(len(a)) < rng.choice([0.02, 0.1, 0.2])
        b = np.unique(np.concatenate([a[~changed], rng.integers(0, 1 << 63, int(changed.sum() * rng.random())).astype(np.uint64)]))
        if nearcopies.similarity(a, b) < nearcopies.LEAST:
            continue
        differ = int(np.bitwise_count(nearcopies.parities(a).view(np.uint64) ^ nearcopies.parities(b).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-6
        first, second = nearcopies.first_ones(a, levels), nearcopies.first_ones(b, levels)
        at, to = next((i, list(second).index(x)) for i, x in enumerate(first) if x in second)
        assert min(len(a) - at, len(b) - to) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6


def sent_bytes(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("most", [100_000, 0])
def test_only_texts_of_pairs_are_sent(spark, monkeypatch, most):
    rng = random.Random(8)
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", most, raising=False)
    texts = [" ".join("%030x" % rng.getrandbits(120) for _ in range(1000)) for _ in range(300)]
    for k in (3, 40):  # near copies, changed in as many words
        words = texts[k].split()
        words[::150] = ["changed"] * len(words[::150])
        texts.append(" ".join(words))
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 7")).localCheckpoint()  # a row twice
    before = sent_bytes(spark)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == list(range(300))
    assert sent_bytes(spark) - before < 0.5 * sum(map(len, texts))


def test_what_meets_by_chance_leaves_its_cell(spark):
    """Sizes and places: only members that some other may be similar to go on, each pair that may be among them."""
    rng = random.Random(12)
    rows = [(rng.randrange(400), k, rng.choice([5, 20, 25, 100, 120, 600]), rng.randrange(0, 40)) for k in range(1500)]
    rows = [(c, k, n, min(at, n // 5)) for c, k, n, at in rows]
    posted = spark.createDataFrame(rows + rows[:200], "cell bigint, node bigint, n int, at int")
    may = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]
           and min(a[2] - a[3], b[2] - b[3]) >= (a[2] + b[2]) * 0.8 / 1.8 - 1e-6]
    left = {tuple(r)[:4]: r.size for r in nearcopies.meeting(posted).collect()}
    assert {x for pair in may for x in pair} <= set(left)
    assert len(left) < 0.8 * len(rows)
    for cell in {c for c, *_ in left}:
        here = [x for x in left if x[0] == cell]
        assert {left[x] for x in here} == {len(here)} and len(here) > 1


def test_pairs_beyond_parities_are_not_looked_up(spark, monkeypatch):
    """Texts sharing a rare passage, of equal size, too little for a copy: none of their texts is sent."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [passage + " " + " ".join("%x" % rng.getrandbits(60) for _ in range(120)) for _ in range(12)]
    formed = []
    alike = nearcopies.alike
    monkeypatch.setattr(nearcopies, "alike", lambda pairs, sets: formed.append(pairs.count()) or alike(pairs, sets))
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12))
    assert not sum(formed)


@pytest.mark.parametrize("most", [100_000, 0])
def test_rows_that_stay_are_not_sent(spark, monkeypatch, most):
    """Also where the kept keys are too many for Spark to broadcast by itself."""
    rng = random.Random(9)
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", most)
    monkeypatch.setattr(nearcopies, "CROWDED", 4)
    texts = [" ".join("%030x" % rng.getrandbits(120) for _ in range(1000)) for _ in range(200)]
    docs = table(spark, texts + [texts[5], texts[5], texts[9]])
    docs = docs.unionByName(docs.where("doc_id IN (5, 7, 201)")).localCheckpoint()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = sent_bytes(spark)
        kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert kept == list(range(200))
    assert sent_bytes(spark) - before < 0.5 * sum(map(len, texts))


@pytest.mark.parametrize("most", [100_000, 0])
def test_postings_are_never_broadcast(spark, monkeypatch, most):
    """Spark takes 33 postings a fingerprint for less than one; what is sent is counted, whatever Spark believes."""
    rng, plans = random.Random(14), []
    monkeypatch.setattr(suffixtree, "BROADCAST_ROWS", most)
    for module in (suffixtree, simhash):
        monkeypatch.setattr(module, "pin", lambda df, *by: plans.append(df._jdf.queryExecution().executedPlan().toString()) or pin(df, *by))
    seeds = [rng.getrandbits(63) for _ in range(200)]
    fps = pin(spark.createDataFrame([(x ^ (1 << k),) for x in seeds for k in (0, 5)], "fp bigint"))
    found = {frozenset(e) for e in simhash.links(fps, most_in_cell=48).collect()}
    assert {frozenset((x ^ 1, x ^ 32)) for x in seeds} <= found
    joined = [p for p in plans if "Join" in p]
    assert joined
    for plan in joined:
        lines = plan.splitlines()
        for i in [k for k, line in enumerate(lines) if "BroadcastExchange" in line]:
            deep = lines[i].index("BroadcastExchange")
            below = [x for x in takewhile(lambda x: not x[deep : deep + 1].isalpha() and len(x) > deep, lines[i + 1 :])]
            assert most and not any("Generate" in x for x in below)


def test_many_texts_are_not_broadcast(spark, monkeypatch):
    """Texts of near copies that take little room in a file go through a sorted join."""
    monkeypatch.setattr(nearcopies, "SENT_CHARS", 1000, raising=False)
    texts = pin(spark.range(40).select(F.col("id").alias("node"), F.repeat(F.lit("the same words "), 400).alias("text")))
    pairs = spark.createDataFrame([(k, k + 1) for k in range(39)], "u bigint, v bigint")
    found = nearcopies.alike(pairs, lambda _: texts)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 39
