"""Mixing, packing, id files, suffix tree, SimHash, neighbours and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, idfile, mixing, nearcopies, neighbours, packing, simhash, suffixtree
from tidemark.llm.queries import ORACLE_SQL, QUERIES
from tidemark.llm.tokens import PieceEncoder, tokenizer_path
from tests.compare import compare, duck

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy_no string, fp string, ids string"
LONG = "word after word. And\nmore, of it " * 40_000


def odd(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", 1, "a", "b", "c") for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None, None, None, None), (0, "", None, None, 0, None, None, None), (0, "", None, None, 0, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


TEXTS = ["one two three", "", "  lead and trail ", "tab\tand\nline\n\nend", "a  b", "don't, stop. <|endoftext|> x", "ÄÖ ß é 12,5.", "one two three", LONG]


def test_mixing_rates_and_determinism(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 4 else ("small" if i % 8 else None), 10, "", "", "") for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    first = mixing.mix(docs, weights={"big": 1.0, "small": 1.0, None: 2.0}, epochs=2.0)
    assert first.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "ids", "copy_no", "shuffle_key", "mix_rate"]
    got = first.collect()
    n = Counter(r.source for r in got)
    for name, share in (("big", 0.25), ("small", 0.25), (None, 0.5)):
        assert abs(n[name] - 8000 * share) < 6 * math.sqrt(8000 * share)
    again = mixing.mix(docs.repartition(3), weights={"big": 1.0, "small": 1.0, None: 2.0}, epochs=2.0).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    # a mean over the table's range: counts are Poisson
    high = mixing.mix(docs.where("doc_id < 500"), epochs=40.0).groupBy("doc_id").count().toPandas()["count"]
    assert abs(high.mean() - 40) < 15 and len(high) == 500
    assert mixing.mix(docs.limit(0)).count() == 0
    # a null id draws like any other: once the mean is high, its text comes out
    nulls = mixing.mix(odd(spark, TEXTS), epochs=30.0).where("doc_id is null")
    assert nulls.count() > 0 and nulls.where("copy_no < 1").count() == 0


def test_mixing_spreads_repeated_rows_and_keeps_clashing_names(spark):
    rows = [(1, "same" if i % 2 else f"text {i}", "s", i, f"n{i}", "r") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int, place string, _rate string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.mix(docs.repartition(4), epochs=3.0).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got.columns) == {*docs.columns, "copy_no", "shuffle_key", "mix_rate", "task"}
    assert set(got["place"]) == {f"n{i}" for i in range(3000)} and set(got["_rate"]) == {"r"}
    assert got.loc[got.text != "same", "shuffle_key"].is_unique
    same = got[got.text == "same"].groupby("task").size()
    tasks = got["task"].nunique()
    assert tasks > 1 and same.max() < 1.5 * same.sum() / tasks


def test_encoder_is_exact():
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = PieceEncoder(tokenizer_path(name), spaced)
        rng = random.Random(3)
        parts = ["a", "the", "Word.", "x,", " ", "  ", "\n", "\t", "é", " ", "12.5", "'s", "I'LL", "\x01", " ", "<|endoftext|>", "<|", "ß.,", "́"]
        text = TEXTS[:-1] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(30)) for _ in range(400)]
        at, ids = e.encode(pa.array(text, pa.large_string()))
        for i, t in enumerate(text):
            assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check_packing(rows, want):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    got = Counter()
    for doc, own in by_doc.items():
        got[doc] = sum(r.length for r in own)
    assert got == want


def test_packing_is_a_partition_of_all_ids(spark):
    docs = odd(spark, TEXTS + [f"w{i} " * (i * 7 % 900) for i in range(150)])
    t = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), True)
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(t.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    for parts in (1, 4):
        rows = packing.pack(docs.repartition(parts), tokenizer_path("byte_bpe_50k.json"), keep_ids=True).collect()
        check_packing(rows, want)
        whole = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == 8), key=lambda r: r.start))
        assert np.frombuffer(whole, "<u4").tolist() == t.tokenizer.encode(LONG, add_special_tokens=False).ids + [0]
    assert packing.pack(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_sum_of_squares_rule_by_brute_force():
    rng = random.Random(5)
    levels = packing.Levels(32)
    count = Counter()
    for _ in range(600):
        size = rng.randint(1, 32)
        def after(h):
            n = Counter(count)
            if h:
                n[h] -= 1
            if h + size < 32:
                n[h + size] += 1
            return sum(v * v for v in n.values())
        options = [h for h in range(0, 33 - size) if h == 0 or count[h] > 0]
        best = min(after(h) for h in options)
        _, level = levels.place(size)
        assert level in options and after(level) == best
        if level:
            count[level] -= 1
        if level + size < 32:
            count[level + size] += 1


def test_ranks_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n).astype(np.int64)).astype(np.uint32)
        assert (idfile.decode_ranks(*idfile.encode_ranks(r), n) == r).all()


def test_id_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK_IDS", 500)
    docs = odd(spark, TEXTS).repartition(3)
    t = PieceEncoder(tokenizer_path("word_bpe_49k.json"), False).tokenizer
    got = idfile.round_trip(docs, tokenizer_path("word_bpe_49k.json"), 2).orderBy("start").collect()
    want = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    assert len(got) == len(want)
    assert [r.doc_id for r in got] == sorted((d for d, _ in want), key=lambda d: -1 if d is None else d)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, i in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert idfile.round_trip(docs.limit(0), tokenizer_path("word_bpe_49k.json"), 2).count() == 0


def test_id_shards_and_runs():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 9, 200)
    r = rng.integers(0, 1 << 32, n.sum(), dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, n.sum()).astype(np.uint32)
    control_at, control, data_at, data = idfile.encode_runs(r, n)
    assert (idfile.decode_ranks(control.tobytes(), data.tobytes(), n) == r).all()
    at = np.concatenate([[0], np.cumsum(n)])
    for i in range(len(n)):
        one = idfile.encode_ranks(r[at[i] : at[i + 1]])
        assert one == (control[control_at[i] : control_at[i + 1]].tobytes(), data[data_at[i] : data_at[i + 1]].tobytes())
    keys = sorted((int(d), int(t)) for d, t in zip(rng.integers(0, 6, 300), rng.integers(-9, 9, 300)))
    low = keys[20::40]
    got = idfile.shard_of(np.array([d for d, _ in keys]), np.array([t for _, t in keys]), np.array([d for d, _ in low]), np.array([t for _, t in low]))
    assert got.tolist() == [sum(b <= k for b in low) for k in keys]


def test_equal_rows_are_cut_into_shards(spark, monkeypatch):
    docs = spark.range(4000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"))
    tokens = idfile.tokenised(docs.repartition(4), tokenizer_path("word_bpe_49k.json"), 2)
    monkeypatch.setattr(idfile, "SHARD_IDS", 1000)
    ids, ties = idfile.borders(tokens)
    rows = tokens.select("doc_id", "tie").toPandas()
    sizes = np.bincount(idfile.shard_of(rows["doc_id"].to_numpy(), rows["tie"].to_numpy(), ids, ties))
    assert len(sizes) >= 12 and sizes.max() < 4000 / 4


def test_suffix_tree(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(120)] + ["", "  ", "Alpha\tBETA unseenword", LONG]
    docs = odd(spark, texts)
    rows = {}
    for r in suffixtree.score(docs.select("doc_id", "text")).collect():
        rows.setdefault(r.doc_id, []).append(r)
    data = docs.collect()
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    train = Counter(w for d in data if d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 5 != 1 for w in toks(d.text))
    n, v = sum(train.values()), len(train)
    assert sum(map(len, rows.values())) == len(data)
    for d in data:
        own = toks(d.text)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        match = [r for r in rows[d.doc_id] if r.n_tokens == len(own) and abs(r.base_score - base) < 1e-6 * max(1, -base)]
        assert match and match[0].n_known == sum(train[w] > 0 for w in own) and match[0].train_tokens == n
        assert all(r.score < 0 for r in match)
    assert suffixtree.score(docs.select("doc_id", "text").limit(0)).count() == 0


def planted(rng, n_docs, length):
    """Texts in which every word but rare ones foretells the next."""
    names = [f"w{i}" for i in range(12)]
    after = {w: rng.sample(names, 2) for w in names}
    for _ in range(n_docs):
        word, out = rng.choice(names), []
        for _ in range(rng.randint(0, length)):
            out.append(word if rng.random() < 0.9 else f"rare{rng.randint(0, 300)}")
            word = rng.choice(after[word])
        yield " ".join(out)


def brute_tree_score(train, probe):
    """log10 probability of each probe's tokens; texts are tuples that end with None."""
    texts = set(train)
    u = Counter(w for t in texts for w in t)
    total = sum(u.values())
    unseen = min(sum(v == 1 for v in u.values()) / total or 0.5 / (total + 1), 0.5)
    root = {w: (1 - unseen) * v / total for w, v in u.items()}
    own = {w for w, v in u.items() if v >= suffixtree.MIN_COUNT} | {None}
    symbol = lambda w: w if w in own else "*"
    start = {w: p for w, p in root.items() if w in own}
    start["*"] = unseen + sum(p for w, p in root.items() if w not in own)
    states = {}

    def p(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return start[w]
        n, t = states[context]
        return (n.get(w, 0) + len(n) * p(context[1:], w)) / (t + len(n))

    for d in range(1, suffixtree.DEPTH + 1):
        level = {}
        for t in texts:
            padded = (None,) * d + tuple(map(symbol, t))
            for i in range(d, len(padded)):
                level.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
        for c, n in level.items():
            t = sum(n.values())
            if t >= suffixtree.MIN_COUNT and sum(v * math.log(v / t / p(c[1:], w)) for w, v in n.items()) >= suffixtree.GAIN * len(n):
                states[c] = n, t
    for c in states:
        assert sum(p(c, w) for w in start) == pytest.approx(1)
    out = []
    for t in probe:
        padded = (None,) * suffixtree.DEPTH + tuple(map(symbol, t))
        inside = sum(math.log10(root.get(w, unseen) / start["*"]) for w in t if w not in own)
        out.append(inside + sum(math.log10(p(padded[i - suffixtree.DEPTH : i], padded[i])) for i in range(suffixtree.DEPTH, len(padded))))
    return out, {len(c) for c in states}


def test_suffix_tree_score_by_brute_force_and_repetition(spark, monkeypatch):
    monkeypatch.setattr(suffixtree, "BLOCK_CHARS", 5_000)
    rng = random.Random(4)
    texts = list(planted(rng, 400, 60))
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    rows = [(f"d{i}", t) for i, t in enumerate(texts)]
    rows += [(f"s{i}", t) for i, t in enumerate(mixed) if zlib.crc32(f"s{i}".encode()) % 5 == 1]
    held = lambda k: zlib.crc32(k.encode()) % 5 == 1
    toks = lambda t: (*t.split(), None)
    brute, lengths = brute_tree_score([toks(t) for k, t in rows if not held(k)], [toks(t) for _, t in rows])
    assert len(lengths) >= 2
    got = {r.doc_id: r for r in suffixtree.score(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for (k, _), want in zip(rows, brute):
        assert got[k].score == pytest.approx(want, rel=1e-9)
    # words in their order, and in any other
    ordered = sum(got[f"d{k[1:]}"].score for k in got if k[0] == "s")
    assert ordered > sum(r.score for k, r in got.items() if k[0] == "s") * 0.9
    # training texts ten times over: the tree stays, the base does not gain on it
    again = [(f"{k}x{j}", t) for j in range(60) for k, t in rows if not held(k) and not held(f"{k}x{j}")][: 9 * len(rows)]
    more = {r.doc_id: r for r in suffixtree.score(spark.createDataFrame(rows + again, "doc_id string, text string")).collect()}
    gain = lambda found: sum(found[k].score - found[k].base_score for k, _ in rows if held(k) and k[0] == "d")
    assert gain(more) >= gain(got) > 0 and more["d0"].score == pytest.approx(got["d0"].score)


def test_gram_keys_agree_with_sql(spark):
    at, symbol = np.array([0, 3, 4, 9]), np.arange(9, dtype=np.int64) * 7919 - 30_000
    context, gram = suffixtree.keys_of(at, symbol)
    for d in range(1, suffixtree.DEPTH + 1):
        rows = spark.createDataFrame([(int(c), int(p)) for c, p in zip(context[d], gram[d - 1])], "c bigint, par bigint")
        assert [r.g for r in rows.selectExpr(suffixtree.GRAM).collect()] == gram[d].tolist()
        assert len(set(gram[d].tolist())) == 9


def brute_fingerprint(text):
    toks = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    toks = re.findall(r"[^\x20\x09-\x0D]+", toks)
    if not toks:
        return 0
    grams = [" ".join(toks[i : i + 3]) for i in range(len(toks) - 2)] or [" ".join(toks)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=2):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_documents(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(200)) for _ in range(8)]
    near = [b.replace("aaa", "zzz", 1) for b in base]
    texts = base + near + base + ["", "one", "One two", "one TWO", " ", LONG]
    docs = odd(spark, texts)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in data]
    groups = brute_components(fps)
    least = {}
    for (d, _), g in zip(data, groups):
        least[g] = min([x for x in (least.get(g), d) if x is not None], default=None)
    want = Counter((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(data, fps, groups))
    found = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_digits("fp"))
    assert Counter((r.doc_id, r.hex, r.component_id) for r in found.collect()) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(v for v in least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [2, 48])
def test_simhash_links_crowded_and_sparse(spark, most):
    rng = random.Random(most)
    fps = set()
    for _ in range(6):
        seed = rng.getrandbits(64)
        ball = [seed]
        for _ in range(60):
            x = rng.choice(ball)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            ball.append(x)
        fps |= set(ball)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    table = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    edges = simhash.links(table, most_in_cell=most)
    assert edges.count() < 64 * len(fps)
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    groups = brute_components([x & (1 << 64) - 1 for x in fps])
    want = {}
    for x, g in zip(fps, groups):
        want.setdefault(g, []).append(x)
    assert {x: got.get(x, x) for x in fps} == {x: min(own) for own in want.values() for x in own}


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    edges = chain + hub + [(5000, 5001)]
    names = list({x for e in edges for x in e})
    alias = dict(zip(names, rng.sample(range(10**6), len(names))))
    df = spark.createDataFrame([(alias[a], alias[b]) for a, b in edges], "u bigint, v bigint")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    for own in (range(301), range(1000, 1200), (5000, 5001)):
        ids = [alias[x] for x in own]
        assert {got[x] for x in ids} == {min(ids)}
    assert components.connected_components(df.limit(0)).count() == 0


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).round(3)
    x[300:700] = x[40]  # a very common vector
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 24, 1), (2040, [float("nan")] * 24, 1), (2060, [1.0], 1), (None, rows[0][1], 1), (100, rows[100][1], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = {}
    for r in neighbours.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    queries = range(0, 1500, 20)
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        s = (x * x[q]).sum(1)
        want = [int(i) for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        own = [i for i, _ in got[q]]
        assert len(own) == 20 and q not in own
        assert all(abs(v - s[i]) < 1e-9 for i, v in got[q])
        assert own == sorted(own, key=lambda i: (-s[i], i))
        hits += len(set(own) & set(want))
    assert hits / (20 * len(queries)) >= 0.9
    assert [i for i, _ in got[40]] == list(range(300, 320))
    assert neighbours.search(table.limit(0)).count() == 0
    few = neighbours.search(table.where("vec_id in (0, 1, 2)")).collect()
    assert [r.vec_id for r in few] and len(few) == 2


def test_recall_on_the_table(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = {}
    for r in QUERIES["op6_permutation_index"](spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        want = {int(ids[i]) for i in np.lexsort((ids, -s)) if i != q and i >= 0}
        want = set([int(ids[i]) for i in np.lexsort((ids, -s)) if i != q][:20])
        hits += len(got[int(ids[q])] & want)
        total += len(want)
    assert hits / total >= 0.9


@pytest.mark.parametrize("width, spread", [(64, 1.0), (384, 0.0), (384, 0.5)])
def test_recall_of_a_full_shard_at_any_lengths(width, spread):
    """One shard of independent components, lengths equal or log-normal."""
    rng = np.random.default_rng(3)
    n = neighbours.SHARD_ROWS
    x = rng.normal(size=(n, width)) * rng.lognormal(0, spread, size=(n, 1))
    pivots = x[rng.choice(n, neighbours.PIVOTS, False)]
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    shard = neighbours.Shard(np.arange(n), x, pivots)
    queries = np.arange(0, n, 20)[:108]
    probes = neighbours.nearest(x[queries], pivots, neighbours.PROBES)
    shard.calibrate(x[queries[:48]], probes[:48], 20)
    hits = 0
    for q, p in zip(queries[48:], probes[48:]):  # none of those it was fitted on
        ids, _ = shard.search(x[q], p, 20, q)
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(ids) & set(np.argsort(-score)[:20]))
    assert hits / (20 * 60) >= 0.9
    assert spread == 0 or shard.ranked < n // 5


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), QUERIES[name], ORACLE_SQL[name], sf_dir) is None


def test_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op10_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert row.a >= 0.9
    rows = QUERIES["op2_suffix_tree_scoring"](spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_stage_drops_copies_from_similarity_08(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    base, near = [], []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(200)]
        base.append(" ".join(words))
        for i in rng.sample(range(5, 195), 1 + k % 4):
            words[i] = rng.choice(vocabulary)
        near.append(" ".join(words))
    # a crowded chain: every text is a near copy of the one before, not of the first
    chain = [[rng.choice(vocabulary) for _ in range(200)]]
    for k in range(150):
        chain.append(chain[-1][:])
        chain[-1][rng.randrange(200)] = f"c{k}"
    texts = base + near + [" ".join(c) for c in chain] + ["a b", "A b", "a c", "", " "]
    docs = odd(spark, texts)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [five_words(t or "") for _, t in data]
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if group[i] != group[j] and (sets[i] == sets[j] or same >= 0.8 * (len(sets[i]) + len(sets[j]) - same)):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(data, group):
        least[g] = min([x for x in (least.get(g), d) if x is not None], default=None)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values())
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    clean = "the river runs past old stone houses and green fields where people walk every quiet morning".split()
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(clean) + rng.choice("abcdefgh") for _ in range(60)]
        if i % 5 == 0:
            words[rng.randrange(60)] = "dreadfulfool"
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[7][1], "en", "s1", 1) for i in range(40)]
    rows += [(2000, "card 4539148803436467 here", None, None, None), (2001, None, None, None, None), (2002, "", None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {n: Counter(r.doc_id for r in rows_) for n, rows_ in seen.items()}
    toxic = {i for i in range(0, 300, 5)}
    assert not toxic & set(ids["toxicity"]) and len(set(range(300)) - toxic - set(ids["toxicity"])) <= 3
    assert 7 in ids["simhash near-dedup"] and not any(1000 <= d < 1040 for d in ids["simhash near-dedup"])
    assert len(ids["pii"]) == len(ids["simhash near-dedup"])
    assert "4539148803436467" not in next(r.text for r in seen["pii"] if r.doc_id == 2000)
    assert set(ids["mixing"]) <= set(ids["pii"]) and max(ids["mixing"].values()) > 1
    assert set(ids["packing"]) == set(ids["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
