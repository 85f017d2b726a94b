import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import decontam, mixing, quality

from .test_decontam import brute
from .test_omh import classes


def test_stages_equal_plain_python(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    before, at = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, small).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        at[k] = ({r["doc_id"]: r["text"] for r in before.collect()}, after.collect())
        if k < 4:
            assert after.columns == names
        before = after
    keep = {r["doc_id"] for r in quality.score_quality(spark, docs).where("keep").collect()}
    assert {r["doc_id"] for r in at[0][1]} == keep
    want = classes(list(at[1][0].items()))
    assert sorted(r["doc_id"] for r in at[1][1]) == sorted(set(want.values()))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute(list(at[2][0].items()), items) if not r[5]}
    assert {r["doc_id"] for r in at[2][1]} == clean
    times = Counter(r["doc_id"] for r in at[3][1])
    taken = {r["doc_id"]: r for r in mixing.mix(spark, spark.read.parquet(f"{tmp_path}/2")).collect()}
    assert max(times.values()) <= 3
    words = sum(len(re.findall(mixing.WORD, r["text"])) for r in at[3][1])
    assert abs(words - sum(r["taken"] for r in taken.values())) < 0.2 * words
    assert Counter(r["doc_id"] for r in at[4][1]) == times
    assert all(0 <= r["shard"] < 8 for r in at[4][1])


def test_run_twice(spark, small):
    a = sorted((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, small).collect())
    b = sorted((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, small).collect())
    assert a and a == b


def test_stage_edges(spark, odd_docs, no_docs, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, small).count() == 0
        rows = stage(spark, odd_docs, small)
        assert rows.count() <= 3 * odd_docs.count()
        assert set(odd_docs.columns) <= set(rows.columns)
    assert decontam.DIGEST[0] == "doc_id"


def test_clashing_and_dotted_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    more = {"keep": F.lit(False), "score": F.lit("s"), "weak_good": F.lit(1), "a.b": F.col("doc_id"), "row": F.lit(2), "times": F.lit(0), "doc__": F.lit("d"), "taken": F.lit(5)}
    more = docs.select("*", *[v.alias(k) for k, v in more.items()])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, more, small)
        assert rows.columns[: len(more.columns)] == more.columns
        assert all(r["a.b"] == r["doc_id"] and r["score"] == "s" for r in rows.collect())
        assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in stage(spark, docs, small).collect()), k


def test_texts_without_words_pass_the_mix(spark, small):
    docs = spark.createDataFrame([(1, "a", ""), (2, "a", None), (3, None, " "), (4, "b", "one two three four")], "doc_id long, source string, text string")
    got = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, small).collect())
    assert [got[i] for i in (1, 2, 3)] == [1, 1, 1] and got[4] >= 1


def test_runs_leave_only_their_result(spark, small):
    from pathlib import Path

    from tallyframe.llm.common import scratch_root

    root = Path(scratch_root(spark).removeprefix("file://").removeprefix("file:"))
    have = lambda: {p for p in root.rglob("*") if p.is_dir()}
    before = have()
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() and [p.name for p in have() - before if p.name.isdigit()] == ["4"]
    assert not [p for p in have() - before if p.name.startswith("omh")]
