import numpy as np

from tallyframe.llm import quality, toxicity


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    from collections import Counter

    truth = rng.random(4000) < 0.8
    votes = []
    for y in truth:
        v = [0] * 6
        if not y:
            v = [1] * 6
            v[rng.integers(6)] = -1
        else:
            v = [1 if rng.random() < 0.97 else 0 for _ in range(6)]
        votes.append(tuple(v))
    q = quality.em(sorted(Counter(votes).items()))
    assert np.mean([(q[v] > 0.5) == y for v, y in zip(votes, truth, strict=True)]) > 0.99
    assert quality.em([]) == {}


def labelled(spark, sf_dir, column):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def test_quality_agrees_with_labels_it_never_saw(spark, small):
    sf_dir = small.replace("0.001", "0.01")
    labels = labelled(spark, sf_dir, "quality")
    rows = quality.op3_weak_label_quality(spark, sf_dir).collect()
    assert len(rows) == 1000
    bad = [r["keep"] for r in rows if labels.get(r["doc_id"]) == 0]
    good = [r["keep"] for r in rows if labels.get(r["doc_id"]) == 1]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_edges(spark, odd_docs, no_docs):
    assert quality.score_quality(spark, no_docs).count() == 0
    rows = quality.score_quality(spark, odd_docs, columns=["doc_id", "text", "size"]).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["size"] == "x" for r in rows)
    again = quality.score_quality(spark, odd_docs.repartition(3)).collect()
    assert sorted(round(r["score"], 9) for r in again) == sorted(round(r["score"], 9) for r in rows)


def test_toxic_documents_are_found(spark, small):
    sf_dir = small.replace("0.001", "0.01")
    labels = labelled(spark, sf_dir, "toxic")
    rows = toxicity.op8_toxicity_chain(spark, sf_dir).collect()
    assert len(rows) == 1000
    bad = [r["toxic"] for r in rows if labels.get(r["doc_id"]) == 1]
    good = [r["toxic"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert np.mean(bad) > 0.8 and np.mean(good) < 0.02
    assert all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in toxicity.CATEGORIES)


def test_held_out_toxicity(spark, small):
    sf_dir = small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    held = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1").collect()}
    rows = toxicity.score_toxicity(spark, docs, half).collect()
    found = [(held[r["doc_id"]], r["toxic"]) for r in rows if r["doc_id"] in held]
    assert np.mean([t for y, t in found if y == 1]) > 0.85
    assert np.mean([t for y, t in found if y == 0]) < 0.02


def test_chain_sees_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["red", "blue", "green", "idiot" if i % 3 == 0 else "kind"], 12)) for i in range(300)]
    toxic = np.array([float("idiot" in t) for t in texts])
    rows = toxicity.Rows([toxicity.hashed_words(t) for t in texts])
    targets = toxicity.category_labels(toxic, rows)
    assert (targets[:, 0] == toxic).all() and (targets[:, -1] == toxic).all()
    chain, seen = toxicity.fit_chain(rows, targets)
    assert [len(v) for _, v, _ in chain] == [0, 1, 2, 3]
    # A row's predictions come from models that didn't see it: with its label turned, they stay.
    other = toxic.copy()
    other[0] = 1 - other[0]
    turned = np.column_stack([*targets[:, :3].T, other])
    assert (toxicity.fit_chain(rows, turned)[1][0, :3] == seen[0, :3]).all()
    assert abs(toxicity.fit_chain(rows, turned)[1][0, 3] - seen[0, 3]) < 1e-12


def test_earlier_categories_decide_toxic(spark, small):
    sf_dir = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain, cut = toxicity.fit(spark, docs, labels, "doc_id", "text", "toxic")
    flags = lambda c: {r["doc_id"] for r in toxicity.score_toxicity(spark, docs, labels, chain=(c, cut)).where("toxic").collect()}
    whole, deaf = flags(chain), flags([(w, np.zeros_like(v), b) for w, v, b in chain])
    assert len(whole ^ deaf) > 0.1 * len(whole), (len(whole), len(deaf), len(whole ^ deaf), cut, [v for _, v, _ in chain])
    for c, name in enumerate(toxicity.CATEGORIES[:3]):
        # Every category before the last has both kinds of rows, and its own weight in the last model.
        assert chain[3][1][c] != 0, name


def test_toxicity_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    none = labels.where("toxic = 5")
    for marks in (labels, none):
        rows = toxicity.score_toxicity(spark, odd_docs, marks).collect()
        assert len(rows) == odd_docs.count()
    assert not any(r["toxic"] for r in rows)
    assert toxicity.score_toxicity(spark, no_docs, labels).count() == 0


def repeated(i):
    """Junk whose neighbouring words differ: a short phrase, and a line of 40 words, over and over."""
    phrase = " ".join(f"{w}{'abcdefgh'[i % 8]}" for w in ("blue", "river", "stone", "under", "quiet", "hills"))
    line = " ".join(f"{'abcdefghij'[n % 10]}{'klmno'[n // 10]}{'pqrstuvw'[i % 8]}" for n in range(40))
    return (phrase + " ") * 10, (line + "\n") * 20


def test_repeated_phrases_and_lines_are_faults():
    at = quality.LABELLERS.index("repeats")
    for text in repeated(3):
        v = quality.votes(quality.measures(text.encode()))
        assert v[at] == -1 and v[quality.LABELLERS.index("runs")] == 1
    # A long text of few words that doesn't repeat itself is none, however low its share of distinct words.
    rng = np.random.default_rng(0)
    long = " ".join(f"word{n}" for n in rng.integers(0, 600, 30_000))
    assert len(set(long.split())) / 30_000 < 0.04
    assert quality.votes(quality.measures(long.encode()))[at] == 1


def test_repeated_phrases_and_lines_are_dropped(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    junk = [(-1 - 2 * i - j, t) for i in range(8) for j, t in enumerate(repeated(i))]
    rows = quality.score_quality(spark, docs.unionByName(spark.createDataFrame(junk, "doc_id long, text string"))).collect()
    assert not any(r["keep"] or r["weak_good"] >= 0.5 for r in rows if r["doc_id"] < 0)
    assert np.mean([r["keep"] for r in rows if r["doc_id"] >= 0]) > 0.85
