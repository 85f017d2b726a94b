import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


TEXTS = [
    "a@b.c_x@d.e and a@b.c.d@e.f, .@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.000255 1..2.3.4 1.2.3",
    "4111 1111 1111 1111  4111-1111-1111-1111 4111  111111111111 79927398713 4111111111111111 0 4111 1111 1111 1112",
    "+1 (603) 555-8791 +44 20 7946 0958. ++1234567890 +1-- +12",
    "\U0001f600é card 5500005555555559 x",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 " * 3,
    "",
    None,
]


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.find_personal_data(spark, rows).collect()}


def same(row, text):
    want = brute(text or "")
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
    assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (text or "")[:80]
    assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(k == x for x, *_ in want) for k in pii.KINDS]
    assert set(said.split(",")) - {""} <= set(row["spans"].split(","))


def test_base_equals_brute_force(spark):
    got = found(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        same(got[i], t)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find_personal_data(spark, docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        same(r, text[r["doc_id"]])


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 150_000 + "@", "1" * 150_000, "1 2-" * 40_000, "+" + "1 " * 60_000, "1." * 60_000]
    got = found(spark, texts)
    assert [got[0]["n_email"], got[1]["n_card"], got[3]["n_phone"]] == [0, 0, 0]
    assert got[4]["n_ip"] == len([x for x in brute(texts[4]) if x[0] == "ip"])


def test_edges(spark, odd_docs, no_docs):
    assert pii.find_personal_data(spark, no_docs).count() == 0
    rows = pii.find_personal_data(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    eight = next(r for r in rows if r["doc_id"] == 8)
    assert [eight[f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]


def test_no_python_in_the_plan(spark, small):
    plan = pii.find_personal_data(spark, spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_boosting_learns_and_calibrates():
    rows = [(n, n % 7, 0, 0, 0, 0, 0, 0, 0, 0) for n in range(200)]
    labels = [int(n > 90) for n in range(200)]
    base, trees = pii.boost(rows, labels)
    scores = [base + pii.RATE * sum(pii.value(t, x) for t in trees) for x in rows]
    assert min(s for s, y in zip(scores, labels, strict=True) if y) > max(s for s, y in zip(scores, labels, strict=True) if not y)
    cut = pii.calibrated(scores, labels)
    assert all(y for s, y in zip(scores, labels, strict=True) if s >= cut)
    assert pii.calibrated([1.0, 0.5], [0, 0]) == float("inf")
    assert pii.boost([], [])[1] == []


@pytest.mark.parametrize("digits", ["4111111111111111", "79927398713", "79927398710"])
def test_luhn(spark, digits):
    got = spark.createDataFrame([(digits,)], "d string").select(F.expr(pii.luhn("d")).alias("ok")).first()["ok"]
    assert got is luhn(digits)


def test_looser_spans_are_added_and_base_ones_stay(spark):
    texts = [f"mail user{i}@mail{i % 7}.example.com or call +1 (603) 555-87{i:02d}" for i in range(60)]
    texts += ["write to jane.roe (at) example (dot) org", "card 4111/1111/1111/1111 now", "meet me @ home. Bye", "1. 2. 3. 4. and 5. 6. 7. 8", "in 2019 1234 5678"]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        same(got[i], t)
    assert got[60]["spans"] == "email:9:40" and got[60]["n_email"] == 0
    assert [got[i]["spans"] for i in (62, 63, 64)] == ["", "", ""]


RIGHT = [
    ("email", "write to |jane.roe (at) example (dot) org|"),
    ("email", "mail |jane.roe at example dot org| please"),
    ("email", "or |jane @ example . com| then"),
    ("card", "card |4111/1111/1111/1111| now"),
    ("card", "amex |3782/822463/10005|"),
    ("phone", "call |(020) 7946 0958| today"),
    ("phone", "ring |(0161) 496 0123|."),
    ("phone", "or |(603) 555-8791| then"),
    ("phone", "on |0044 20 7946 0958|"),
    ("ip", "host |10[.]0[.]0[.]1| is up"),
    ("ip", "server |10 . 0 . 0 . 1| is up"),
]
# Spans that pass the kind's test on their digits, and that the generators propose.
WRONG = ["look at www.example.com now", "buy two at 3.99 each", "stay at home.Then go", "see 10. 11. 12. 13 below", "id 0000/0000/0000/0000 x", "set (2019) 1234 5678"]


def test_the_model_selects_looser_spans(spark):
    texts = [t.replace("|", "") for _, t in RIGHT] + WRONG
    # Alone, and beside many base spans and looser wrong ones.
    for more in ([], [f"mail user{i}@mail{i % 7}.example.com or at page.{i % 9}x, 1. 2. 3. {i}, (19{i:02d}) 2000 2001" for i in range(60)]):
        got = found(spark, texts + more)
        for i, (kind, t) in enumerate(RIGHT):
            s = t.index("|")
            assert got[i]["spans"] == f"{kind}:{s}:{t.rindex('|') - 1}", t
        for i, t in enumerate(WRONG, len(RIGHT)):
            assert got[i]["spans"] == "", t
        for i, t in enumerate(more, len(texts)):
            assert got[i]["spans"] == f"email:5:{t.index(' or')}", t


def test_training_holds_both_classes(spark):
    given = pii.examples(spark)
    for kind, sides in pii.EXAMPLES.items():
        # All examples are proposed, whatever surrounds them, and pass the kind's test.
        assert [sum(y == label for _, y in given[kind]) for label in (1, 0)] == [3 * len(side) for side in sides]
    rows = spark.createDataFrame([(i, f"see a{i}@b.org at page.{i}x") for i in range(30)], "doc_id long, text string")
    for base, trees, least in fitted(pii.candidates(rows)).values():
        assert trees and least < float("inf") and base == base


def fitted(found):
    found = found.withColumn("id__", F.monotonically_increasing_id())
    rows = found.select("id__", "key__", F.explode("all__").alias("x")).select("id__", "key__", "x.*")
    return pii.fit(found, pii.clear_of_base(rows).where("free").drop("free"))


PLANTED = ["write to jane.roe (at) example (dot) org", "call (020) 7946 0958 today", "card 4111/1111/1111/1111 now", "host 10[.]0[.]0[.]1 is up", 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" of']


def planted(spark, small):
    """Documents of which some have a looser span put before their text."""
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    more = F.array(*[F.lit(t + ". ") for t in PLANTED])[(F.col("doc_id") % len(PLANTED)).cast("int")]
    return docs.withColumn("text", F.when(F.col("doc_id") % 20 < 5, F.concat(more, F.col("text"))).otherwise(F.col("text")))


def test_trees_decide_on_documents(spark, small):
    docs = planted(spark, small)
    models = fitted(pii.candidates(docs))
    assert all(trees and least < float("inf") for _, trees, least in models.values())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark, docs, models=models).collect()}
    for i, r in got.items():
        same(r, text[i])
        base, added = len(brute(text[i])), r["n_private"] - r["n_secret"]
        if i % 20 < 5 and i % 5 < 4:
            assert added == base + 1, text[i][:60]
        if i % 20 < 5 and i % 5 == 4:
            assert r["secrets"].startswith("secret:13:53")
    # Without the trees no threshold is reached, and what they selected isn't there.
    bare = {k: (start, [], least) for k, (start, trees, least) in models.items()}
    none = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark, docs, models=bare).collect()}
    assert sum(none[i] != r["spans"] for i, r in got.items()) >= 100


def test_dotted_texts_and_many_matches(spark):
    """Repeated groups don't recurse, and matches, overlaps and sums take no time that grows with the square."""
    texts = ["x@" + "a." * 500_000 + "a", "1." * 500_000, "@" * 500_000, "a@" * 250_000, "user@mail.example.com " * 12_000]
    texts += ["u at mail dot example dot com, " * 6_000 + "u@m.org " * 6_000, "(020) 7946 0958 " * 6_000, "a1" * 300_000, " at a dot a" * 50_000]
    got = found(spark, texts)
    assert [got[0]["n_email"], got[1]["n_ip"], got[4]["n_email"], got[5]["n_email"]] == [1, 125_000, 12_000, 6_000]
    for i in (4, 5):
        same(got[i], texts[i])


def test_added_spans_do_not_overlap(spark):
    rows = spark.createDataFrame([(1, "ip", 3, 9, 0.9), (1, "phone", 7, 20, 0.95), (1, "card", 20, 30, 0.9), (2, "ip", 0, 5, 0.9), (1, "email", 15, 18, 0.9)], "id__ long, kind string, s int, e int, score double")
    assert sorted((r["id__"], r["kind"], r["s"], r["e"]) for r in pii.joined_spans(rows).collect()) == [(1, "card", 20, 30), (1, "phone", 3, 20), (2, "ip", 0, 5)]
    rows = spark.createDataFrame([(1, 0, 5, 9), (1, 1, 8, 12), (1, 1, 9, 12), (1, 1, 0, 5), (1, 1, 0, 6), (1, 1, 6, 7), (1, 1, 5, 20), (2, 1, 5, 9)], "id__ long, loose int, s int, e int")
    assert sorted((r["id__"], r["s"], r["e"]) for r in pii.clear_of_base(rows).where("free").collect()) == [(1, 0, 5), (1, 9, 12), (2, 5, 9)]
