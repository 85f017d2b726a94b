import hashlib
import re

import pytest

from tallyframe.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        own, hit, found = lower(text), set(), set()
        for item, t in items:
            words = lower(t)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                w = words[i : i + size]
                for s in range(len(own) - len(w) + 1):
                    if own[s : s + len(w)] == w:
                        hit.update(range(s, s + len(w)))
                        found.add(str(item))
        items_ = sorted(found)
        out.append((doc_id, len(own), len(hit), len(items_), hashlib.sha256(",".join(items_).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_passages_equal_brute_force(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 4000")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    get = lambda: sorted((tuple(r) for r in decontam.find_contamination(spark, docs, items).select(*decontam.DIGEST).collect()), key=repr)
    assert get() == want
    assert any(r[5] for r in want)
    monkeypatch.setattr(decontam, "BLOCK_PHRASES", 300)  # the benchmark in blocks, long items in pieces
    monkeypatch.setattr(decontam, "PIECE_PHRASES", 7)
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 3000)
    assert get() == want


def test_edges(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps"), (2, None), (3, ""), (4, "x y z"), (None, "lazy dog"), (5, "word " * 12), (5, "word " * 12), (6, "数字 ١٢٣")], "item_id long, text string")
    rows = decontam.find_contamination(spark, odd_docs, items).collect()
    assert len(rows) == odd_docs.count()
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.where("n_chars IS NULL OR n_chars < 100000").collect()], [(1, "quick brown fox jumps"), (6, "数字 ١٢٣")])
    hits = {(r["doc_id"], r["n_items"]) for r in rows}
    assert (1, 1) in hits and (8, 1) in hits and (3, 0) in hits
    assert next(r for r in rows if r["doc_id"] == 10)["n_hit"] == 2  # the nameless item's words
    big = next(r for r in rows if r["doc_id"] == 6)
    assert (big["n_words"], big["n_hit"], big["items"]) == (60_000, 60_000, ["5"])
    assert len(want) == odd_docs.where("n_chars IS NULL OR n_chars < 100000").count()
    assert decontam.find_contamination(spark, no_docs, items).count() == 0
    clean = decontam.find_contamination(spark, odd_docs, items.where("item_id > 100")).collect()
    assert len(clean) == odd_docs.count() and not any(r["contaminated"] for r in clean)


@pytest.mark.parametrize(("slop", "found"), [(0, False), (1, True)])
def test_proximity(spark, slop, found):
    docs = spark.createDataFrame([(1, "alpha extra beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert decontam.find_contamination(spark, docs, items, slop=slop).first()["contaminated"] is found


def test_a_segment_visits_the_phrases_of_its_terms_only():
    plan = {t: [((t, t + 1000), [0, 1], [t])] for t in range(500)}
    assert list(decontam.wanted({}, plan)) == []
    assert [x[2] for x in decontam.wanted({7: None, 1007: None, 8: None, 2000: None}, plan)] == [[7]]


def test_keys_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two three"), (None, "three"), ("a", None)], "doc_id string, text string")
    items = spark.createDataFrame([(1, "Two three"), (2, None), (3, "")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"]) for r in decontam.find_contamination(spark, docs, items).collect())
    assert got == [("None", 1, 0), ("a", 0, 0), ("a", 3, 2)]
