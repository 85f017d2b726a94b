import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import common, omh

WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=40)


@settings(max_examples=100, deadline=None)
@given(WORDS, WORDS)
def test_alignment_of_hashes_equals_that_of_words(a, b):
    want = omh.similarity(a, b, 0.8)
    got = omh.aligned_share((omh.hashes(a) >> np.uint64(32)).astype(np.uint32), (omh.hashes(b) >> np.uint64(32)).astype(np.uint32), 0.8)
    assert (got >= 0.8) == (want >= 0.8)
    if want >= 0.8:
        assert abs(got - want) < 1e-9
        inter = len(set(omh.labelled(a)) & set(omh.labelled(b)))
        assert want <= inter / (len(omh.labelled(a)) + len(omh.labelled(b)) - inter) + 1e-9


def test_hashes_label_occurrences():
    h = omh.hashes([b"x"] * 30)
    assert len(h) == 26 and len(set(h.tolist())) == 26
    assert omh.hashes([b"one"]).shape == (1,)


def test_order_matters():
    a = [str(i).encode() for i in range(200)]
    moved = a[100:] + a[:100]
    assert omh.similarity(a, moved, 0.4) < 0.6
    same = (omh.sketches(omh.hashes(a)) == omh.sketches(omh.hashes(moved))).mean()
    assert same < 0.5


def classes(rows):
    """Exhaustive classes of (doc_id, text) rows: the least id of all linked rows."""
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    texts = [t for t in by if t is not None]
    have = [omh.labelled(omh.tokens(t)) for t in texts]
    index = defaultdict(list)
    for i, x in enumerate(have):
        for g in x:
            index[g].append(i)
    shared = Counter((a, b) for v in index.values() for k, b in enumerate(v) for a in v[:k])
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(have[a]) + len(have[b]) - n) - 1e-9 and omh.similarity(omh.tokens(texts[a]), omh.tokens(texts[b]), 0.8) >= 0.8:
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[root(i)] += by[t]
    return {i: min(v) for v in groups.values() for i in v}


def family(n, words=150, edits=6, seed=1):
    """Texts that each change a few words of one text, so that links form chains."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = [" ".join(base)]
    for i in range(n - 1):
        own = list(base)
        for _ in range(rng.randrange(1, edits)):
            own[rng.randrange(words)] = f"new{i}x{rng.randrange(99)}"
        out.append(" ".join(own))
    return out


def test_classes_equal_exhaustive_ones(spark, monkeypatch):
    rng = random.Random(7)
    texts = family(120) + family(60, 40, 3, 2) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 16):  # the second cuts buckets into blocks
        monkeypatch.setattr(omh, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in omh.near_classes(spark, docs).collect()}
        assert got == classes(rows)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = omh.op9_order_minhash(spark, small).collect()
    want = classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert sum(r["keep"] for r in got) == len(set(want.values()))


def test_edges(spark, odd_docs, no_docs):
    assert omh.near_classes(spark, no_docs).count() == 0
    rows = omh.near_classes(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    ids = defaultdict(set)
    for r in rows:
        ids[r["doc_id"]].add(r["class_id"])
    assert ids[1] == {1} and ids[2] == {1} and ids[3] == {3} and ids[4] == {4}
    kept = omh.deduplicate(spark, odd_docs)
    assert kept.columns == odd_docs.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left[1] == 1 and left[2] == 0 and left[3] == 1 and left[4] == 1 and left[6] == 1
    assert left[None] >= 1


def test_components(spark):
    path = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(b"x", b"y")]
    links = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in path], "a binary, b binary")
    got = {bytes(r["th"]): bytes(r["comp"]) for r in omh.components(spark, links).collect()}
    assert all(got[bytes([i])] == bytes([0]) for i in range(21)) and got[b"y"] == b"x"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=5, max_size=54), st.data())
def test_short_texts_at_the_threshold_share_a_kmer_of_their_prefixes(own, data):
    a = [str(x).encode() for x in own]
    b = list(a)
    for _ in range(data.draw(st.integers(0, 3))):
        i = data.draw(st.integers(0, len(b)))
        b[i : i + data.draw(st.integers(0, 1))] = [b"new"] * data.draw(st.integers(0, 1))
    x, y = omh.hashes(a), omh.hashes(b)
    if omh.similarity(a, b, 0.8) >= 0.8 and max(len(x), len(y)) <= omh.SHORT:
        assert set(omh.prefix(x, 0.8).tolist()) & set(omh.prefix(y, 0.8).tolist())


def test_no_link_of_short_texts_is_lost(spark):
    rng = random.Random(3)
    texts = []
    for g in range(120):
        own = [f"g{g}w{i}" for i in range(rng.randrange(8, 30))]
        texts += [" ".join(own), " ".join([*own, "more"])]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in omh.near_classes(spark, docs).collect()}
    assert got == classes(rows) and len(set(got.values())) < len(rows) / 2 + 1


def test_lookup_in_cells(spark):
    rows = [("hot" if i % 3 else f"k{i}" if i % 2 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, i long")
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 200)]], "key string, v long")
    got = {r["i"]: r["v"] for r in common.looked_up(df, "key", "i", table, 7).collect()}
    assert got == {i: 1 if k == "hot" else i if k and i < 200 else None for k, i in rows}
