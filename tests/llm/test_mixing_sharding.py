from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import common, mixing, sharding


def test_filled():
    assert mixing.filled([100, 100], [1, 1], 200, 3) == [100, 100]
    assert mixing.filled([10, 1000], [1, 1], 1010, 3) == [30, 980]
    assert mixing.filled([0, 5], [5, 1], 5, 3) == [0, 5]
    assert mixing.filled([], [], 0, 3) == []


@pytest.mark.parametrize("block", [7, None])
def test_mix_of_documents(spark, small, block):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(spark, docs, block_words=block).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, docs.repartition(3), block_words=block).collect()}
    text = {r["doc_id"]: r for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len([w for w in __import__("re").findall(mixing.WORD, text[r["doc_id"]]["text"])])
        assert r["taken"] <= 3 * r["size"] and again[r["doc_id"]] == r["taken"]
        by[r["source"]].append(r)
    assert sum(r["size"] for r in rows) == pytest.approx(sum(g[0]["target"] for g in by.values()))
    for i, source in enumerate(sorted(by)):
        group = by[source]
        assert group[0]["source_size"] == sum(r["size"] for r in group)
        # A few blocks short of the target at most.
        assert 0 <= group[0]["target"] - sum(r["taken"] for r in group) < 4 * (block or 1), (i, source)


def test_schedule_is_even(spark):
    targets = [500.0, 300.0, 200.0]
    slots = [r["source_no"] for r in mixing.schedule(spark, targets, 1).orderBy("slot").collect()]
    assert len(slots) == 1000
    for a in range(0, 1000, 100):
        for s, n in Counter(slots[a : a + 100]).items():
            assert abs(n - targets[s] / 10) <= 4
    ranks = defaultdict(list)
    for r in mixing.schedule(spark, targets, 1).orderBy("slot").collect():
        ranks[r["source_no"]].append(r["slot_rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())


def brute_mix(rows, targets, block):
    """Words taken of each (source_no, start) by walking the slots in plain Python."""
    total = sum(targets)
    n = -(-int(total) // block) if total == int(total) else int(total // block) + 1
    bounds = [int(sum(targets[: i + 1]) / total * mixing.POINTS) for i in range(len(targets))]
    used, taken, ranges = Counter(), Counter(), defaultdict(list)
    for r in rows:
        if r["size"]:
            ranges[r["source_no"]] += [(r["source_no"], r["start__"])] * r["size"]
    assert [r for v in ranges.values() for r in v] and all([x[1] for x in v] == sorted(x[1] for x in v) for v in ranges.values())

    def take(s, a, b):
        for w in range(a, min(b, int(targets[s]))):
            taken[ranges[s][w % len(ranges[s])]] += 1

    for i in range(n):
        point = i * mixing.GOLDEN % mixing.POINTS
        s = next((k for k, b in enumerate(bounds) if point < b), len(targets) - 1)
        take(s, used[s] * block, (used[s] + 1) * block)
        used[s] += 1
    for s in range(len(targets)):
        if used[s] < mixing.LEAST_SLOTS:
            take(s, used[s] * block, int(targets[s]))
    return taken


@pytest.mark.parametrize("block", [50, 1])
def test_slots_decide_what_is_taken(spark, small, block, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")))
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 3)

    def taken():
        rows, plan, targets = mixing.placed(spark, docs, (5.0, 2.0, 1.0), 1.0, 3.0, 17, "source", "text", ("doc_id",))
        rows = rows.orderBy("source_no", "start__").collect()
        want = brute_mix(rows, targets, block)
        got = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, docs, block_words=block).collect()}
        assert got == {r["kept__0"]: want[r["source_no"], r["start__"]] * (r["size"] > 0) for r in rows}
        return got

    golden = taken()
    if block > 1:
        # Another sequence of points gives another mix.
        monkeypatch.setattr(mixing, "GOLDEN", mixing.POINTS // 2)
        assert taken() != golden


def test_mixed_blocks_are_the_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mixed_blocks(spark, docs).collect()
    taken = Counter()
    for r in rows:
        taken[r["doc_id"]] += r["last"] - r["first"]
    got = {r["doc_id"]: r for r in mixing.mix(spark, docs).collect()}
    assert taken == Counter({k: r["taken"] for k, r in got.items() if r["taken"]})
    for r in rows:
        assert got[r["doc_id"]]["first_slot"] <= r["slot"] and 0 <= r["first"] < r["last"] <= got[r["doc_id"]]["size"]


def test_mix_edges(spark, odd_docs, no_docs):
    assert mixing.mix(spark, no_docs).count() == 0
    rows = mixing.mix(spark, odd_docs, block_words=16).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["source"] for r in rows if r["size"] == 0} >= {"a", "", None}


def test_running_sum_equals_plain_one(spark):
    data = [("g" if i % 3 else None, i % 7, i, i * 2) for i in range(60)]
    df = spark.createDataFrame(data, "g string, b int, o int, w int")
    got = {r["o"]: r["before"] for r in common.running_sum(df, ["g"], "b", [df["o"]], df["w"], "before").collect()}
    for g in ("g", None):
        total = 0
        for _, b, o, w in sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2])):
            assert got[o] == total
            total += w


def test_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sharding.assign_shards(spark, docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
        assert 0 <= r["shard"] < 8
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    nine = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(spark, docs, (1.0,) * 9).collect()}
    assert all(nine[r["doc_id"]] == r["grown_shard"] for r in rows)
    import zlib

    text = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["size"] == len(text[r["doc_id"]]) + 1 for r in rows)


def test_shard_weights(spark):
    keys = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    n = Counter(r["shard"] for r in sharding.with_shards(keys, (1.0, 2.0, 5.0, 0.0)).select("shard").collect())
    assert n[3] == 0
    for shard, w in enumerate((1, 2, 5)):
        assert n[shard] / 20_000 == pytest.approx(w / 8, abs=0.015)
    with pytest.raises(ValueError):
        sharding.with_shards(keys, (0.0,))


def test_shard_edges(spark, odd_docs, no_docs):
    assert sharding.assign_shards(spark, no_docs).count() == 0
    rows = sharding.assign_shards(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {1}
    assert sorted(r["slot"] for r in rows if r["doc_id"] == 1)[0] >= 0
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def brute_shards(rows, weights):
    """(shard, place) of (key, crc32, size) rows from the hashes' definition, in plain Python."""
    import math
    import struct

    import xxhash

    def hash52(*parts):
        h = 42
        for p in parts:
            if p is not None:
                h = xxhash.xxh64_intdigest(p, seed=h)
        return h >> 12

    out = []
    for key, crc, size in rows:
        text = b"null" if key is None else str(key).encode()
        score = [(-math.log((hash52(text, struct.pack("<i", i)) + 0.5) / 2**52) / w, i) for i, w in enumerate(weights) if w > 0]
        out.append((min(score)[1], hash52(*[None if v is None else struct.pack("<q", v) for v in (key, crc, size)])))
    return out


@pytest.mark.parametrize("weights", [(1.0,) * 8, (2.0, 0.0, 1.0, 4.0)])
def test_shards_and_slots_equal_plain_python(spark, small, weights):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "a"), (5, None), (-1, "b")], docs.schema))
    rows = sharding.assign_shards(spark, docs, weights).collect()
    keys = [(r["doc_id"], r["text_crc32"], r["size"]) for r in rows]
    want = brute_shards(keys, weights)
    grown = brute_shards(keys, (*weights, sum(weights) / len(weights)))
    by = defaultdict(list)
    for r, (shard, place), (more, _) in zip(rows, want, grown, strict=True):
        assert r["shard"] == shard and r["grown_shard"] == more
        by[shard].append((place, r["slot"]))
    assert all([slot for _, slot in sorted(v)] == list(range(len(v))) for v in by.values())
