import numpy as np
import pytest

from tallyframe.llm import annforest, licenses


def exact(ids, x, q, k):
    s = (x * x[q]).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(ids[i], s[i]) for i in order]


def test_recall_and_scores(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in annforest.op5_projection_forest(spark, small).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        mine = [got[ids[q]][r] for r in range(1, 21)]
        want = exact(ids, x, q, 20)
        recall.append(len({i for i, _ in mine} & {i for i, _ in want}) / 20)
        score = dict(zip(ids.tolist(), (x * x[q]).sum(1).tolist(), strict=True))
        assert all(abs(s - score[i]) < 1e-12 for i, s in mine)
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
    assert np.mean(recall) >= 0.9


def test_recall_where_trees_are_deep(spark, monkeypatch):
    monkeypatch.setattr(annforest, "LEAF_ROWS", 16)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))  # norms differ
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in annforest.nearest(spark, df, k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    ids = np.arange(1500)
    assert np.mean([len(got[q] & {i for i, _ in exact(ids, x, q, 10)}) / 10 for q in range(0, 1500, 20)]) >= 0.9


def test_vector_edges(spark):
    kind = "vec_id long, embedding array<float>, id string, vid string"
    same = [(i, [1.0, 0.0], "x", "x") for i in range(1, 60)]
    odd = [(0, [1.0, 1.0], "", ""), (100, None, "", ""), (200, [0.0, 0.0], "", ""), (300, [float("nan"), 1.0], "", ""), (400, [None, 1.0], "", ""), (500, [1.0, 2.0, 3.0], "", ""), (None, [1.0, 1.0], "", ""), (600, [], "", ""), (700, [float("inf"), 0.0], "", ""), (20, [1.0, 0.0], "x", "x")]
    rows = annforest.nearest(spark, spark.createDataFrame(same + odd, kind)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {0, 20, 40}
    assert [v for _, v, _ in sorted(by[20])] == [0, *range(1, 20)]
    assert [v for _, v, _ in sorted(by[40])] == [0, *range(1, 20)]
    few = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (1, [2.0, 1.0], "", "")], kind)
    assert [tuple(r) for r in annforest.nearest(spark, few).collect()] == [(0, 1, 1, 4.0)]
    assert annforest.nearest(spark, few.where("vec_id > 5")).count() == 0


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("prose\nReleased under the MIT License.\nmore", "MIT"),
        ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "Apache-2.0"),
        ("x\nThis work is licensed under the GNU\nGeneral Public License, version 3.", "GPL-3.0-only"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("we license nothing here at all", None),
        ("", None),
        (None, None),
    ],
)
def test_license_lines(text, license):
    found = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)
    assert (found[0][0] if found else None) == license


def brute(text, least):
    """Best Dice of any stretch of lines with every template, without any pruning."""
    best = {}
    lines = [licenses.words(x) for x in (text or "").split("\n")]
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            want = licenses.bigrams(licenses.words(t))
            for a in range(len(lines)):
                for b in range(a, min(len(lines), a + 12)):
                    own = [w for x in lines[a : b + 1] for w in x]
                    if own and len(own) < 400:
                        best[name] = max(best.get(name, 0), licenses.dice(licenses.bigrams(own), want))
    return {k: round(v, 9) for k, v in best.items() if v >= least}


def test_scan_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 3000")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert {m["license"]: round(m["dice"], 9) for m in r["matches"]} == brute(text[r["doc_id"]], 0.8)
    assert any(r["license"] for r in rows)


def test_license_edges(spark, odd_docs, no_docs):
    assert licenses.scan_licenses(no_docs).count() == 0
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["license"] for r in rows)


def brute_words(text, least):
    """Best Dice of any stretch of words with every template, in stretches that hold a bigram of the license's own if there are such."""
    named = {}
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for g in licenses.bigrams(licenses.words(t)):
                named.setdefault(g, set()).add(name)
    best, own = {}, licenses.words(text)
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            want = licenses.bigrams(licenses.words(t))
            only = {g for g in want if named[g] == {name}}
            for a in range(len(own)):
                for b in range(a + 1, min(len(own), a + 1 + 2 * sum(want.values())) + 1):
                    grams = licenses.bigrams(own[a:b])
                    if not only or not only.isdisjoint(grams):
                        best[name] = max(best.get(name, 0), licenses.dice(grams, want))
    return {k: round(v, 9) for k, v in best.items() if v >= least}


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_brute_force_over_words(seed):
    rng = np.random.default_rng(seed)
    notices = [t.split() for texts in licenses.TEMPLATES.values() for t in texts if len(t) < 400]
    own = []
    for _ in range(5):
        notice = [w for w in notices[rng.integers(len(notices))] if rng.random() > 0.08]
        own += [f"word{rng.integers(9)}" for _ in range(rng.integers(6))] + notice
    text = "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in own)
    found = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)
    assert {name: round(d, 9) for name, _, _, _, d in found} == brute_words(text, 0.8)


def test_notices_inside_long_lines():
    scan = licenses.Scanner(licenses.TEMPLATES, 0.8).scan
    assert scan("Copyright 2024 Foo Ltd. Released under the MIT License. All rights reserved worldwide.") == [("MIT", 0, 0, 1, 1.0)]
    prose = "these words of prose stand on one line beside the notice " * 200
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert (name, 1.0) in [(x[0], x[4]) for x in scan(prose + t + " " + prose)]
    # Lines count from the one in which the stretch begins.
    assert scan("one\n\n" + prose + "Released under\n\nthe MIT License. " + prose) == [("MIT", 0, 2, 3, 1.0)]
    assert scan("SPDX-License-Identifier: Zlib") == []


def test_templates_of_one_word():
    scan = licenses.Scanner({"X": ("WTFPL",), "Y": ("Licensed under the WTFPL",)}, 0.8).scan
    assert scan("some words\nunder WTFPL only") == [("X", 0, 1, 1, 1.0)]


VERSIONS = [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-only"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-or-later"),
    ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"),
    ("Released\nunder\nthe\nMIT\nLicense.", "MIT"),
]


def test_versions_are_told_apart_and_notices_may_wrap():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for text, name in VERSIONS:
        for t in (text, "Some words before. " + text + " And words after it, on the same line.", text.replace(" ", "\n")):
            assert scanner.scan(t)[0][0] == name, t
