"""Near-duplicate classes by Order MinHash.

A text is the sequence of its k-mers (five words), each labelled with how often it occurred before. A sketch
takes the few k-mers that are least under one hash, keeps them in text order and hashes that tuple, so two texts
agree in it with a probability that falls with edits and with moves. Texts that agree in a sketch meet in a
bucket. Small one-permutation signatures rule out pairs that are far apart; the rest are verified by a banded
alignment of their labelled k-mers.

Only links between classes matter, so no bucket emits all its pairs. Round one aligns a maximum spanning forest
of each bucket. Round two compares each text that isn't in its bucket's main class with the bucket's texts of
other classes, inside the task, and emits the links alone. Buckets are cut into blocks, so none has to fit into
one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, few, in_slices, looked_up, packed, stored, words

#: Words of a k-mer, k-mers of a sketch, sketches: two long texts at similarity 0.8 share a sketch with 0.8^4, so
#: they meet in none of 16 with a probability of 0.0002, at 0.9 of 3e-8; at 51 k-mers it is 0.0003.
K, TUPLE, SKETCHES = 5, 4, 16
#: Texts of so many k-mers at most also meet by single k-mers, so that no pair of such texts is missed: sketches of few k-mers
#: agree less often.
SHORT = 50
#: Bins of the signature, and the share of equal bins below which a pair isn't aligned: at similarity 0.8 the
#: share has a standard deviation of 0.035.
BINS, LEAST_BINS = 128, 0.65
BLOCK = 512
#: Rows of 16-byte keys that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000

_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str) -> list[bytes]:
    """Words of a text; a text without any is one word."""
    return words(text) or [text.encode("utf-8", "surrogatepass")]


def labelled(own: list[bytes]) -> list[tuple]:
    """k-mers in text order, each with the number of its earlier occurrences; a short text is one k-mer."""
    seen: dict[tuple, int] = {}
    out = []
    for i in range(max(1, len(own) - K + 1)):
        g = tuple(own[i : i + K])
        n = seen.get(g, 0)
        seen[g] = n + 1
        out.append((g, n))
    return out


def hashes(own: list[bytes]) -> np.ndarray:
    """64-bit hashes of the labelled k-mers in text order."""
    with np.errstate(over="ignore"):
        w = mixed(np.fromiter(map(zlib.crc32, own), np.uint64, len(own)) + np.uint64(1))
        n = max(1, len(w) - K + 1)
        h = np.zeros(n, np.uint64)
        for i in range(min(K, len(w))):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
        h = mixed(h)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            first = np.concatenate([[0], np.where(~same, np.arange(1, n), 0)])
            occurrence = np.arange(n) - np.maximum.accumulate(first)
            label = np.empty(n, np.uint64)
            label[order] = occurrence.astype(np.uint64)
            h = mixed(h + label * np.uint64(0xD6E8FEB86659FD93))
        return h


def sketches(h: np.ndarray) -> np.ndarray:
    """One hash per sketch: the least ``TUPLE`` k-mers under its own hash, in text order."""
    with np.errstate(over="ignore"):
        x = (h[None, :] ^ (h[None, :] >> np.uint64(29))) * _SEEDS[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        k = min(TUPLE, len(h))
        at = np.argpartition(x, k - 1, axis=1)[:, :k] if k < len(h) else np.broadcast_to(np.arange(k), (SKETCHES, k))
        picked = h[np.sort(at, axis=1)]
        out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + picked[:, i])
        return out.view(np.int64)


def prefix(h: np.ndarray, least: float) -> np.ndarray:
    """The least k-mers by hash of a short text, so many that two short texts at ``least`` or above share one of them.

    Sets of n k-mers at that similarity share at least ``least`` * n, so n less these and one more, in one order
    for all texts, can't all differ.
    """
    n = len(h)
    if n > SHORT:
        return np.empty(0, np.int64)
    return np.sort(h)[: n - int(np.ceil(least * n - 1e-9)) + 1].view(np.int64)


def signature(h: np.ndarray) -> bytes:
    """A byte of the least hash of each bin, 0 for an empty one."""
    ranked = np.sort(h)
    bins = (ranked >> np.uint64(57)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (ranked[first] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.tobytes()


def shares(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either signature fills."""
    equal = ((many == one) & (one != 0)).sum(1)
    return equal / np.maximum(1, ((many != 0) | (one != 0)).sum(1))


def similarity(a: list[bytes], b: list[bytes], least: float) -> float:
    """k-mers aligned in order over k-mers in either text, from a banded alignment.

    At ``least`` or above, no aligned pair is further off the diagonal than the band, so the band loses
    nothing there. Labelled k-mers are distinct, so the longest alignment is a longest increasing run.
    """
    left, right = labelled(a), labelled(b)
    total = len(left) + len(right)
    if min(len(left), len(right)) < least * max(len(left), len(right)):
        return 0.0
    band = int((1 - least) / (1 + least) * total) + 1
    place = {g: j for j, g in enumerate(right)}
    ends: list[int] = []
    for i, g in enumerate(left):
        j = place.get(g, -1)
        if j >= 0 and abs(i - j) <= band:
            at = bisect_left(ends, j)
            if at == len(ends):
                ends.append(j)
            else:
                ends[at] = j
    return len(ends) / (total - len(ends))


def signed(docs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """Every row's key and text id (md5; null for null), with sketches (behind them the k-mers of a short text) and signature of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, tuple] = {}
            sk, sig = [], []
            for i, t in zip(batch.column("th").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if i is None:
                    sk.append(None)
                    sig.append(None)
                    continue
                if i not in known:
                    h = hashes(tokens(t))
                    known[i] = np.concatenate([sketches(h), prefix(h, least)]), signature(h)
                sk.append(known[i][0])
                sig.append(known[i][1])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), pa.array(sk, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["k", "th", "sketches", "bins"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("th"), F.col(text).alias("t"))
    return rows.mapInArrow(in_slices(run), "k long, th binary, sketches array<long>, bins binary")


PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one key each from batches sorted by it; a key may pass from one batch into the next."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:], strict=False):
            key = tuple(c[s] for c in columns)
            if key != held_key and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


def matrix(bins: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), BINS)


def forest(bins: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest by share of equal bins, none below ``LEAST_BINS``."""
    n, out = len(bins), []
    best, other, left = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
    now = 0
    for _ in range(n - 1):
        left[now] = False
        rest = np.flatnonzero(left)
        s = shares(bins[now], bins[rest])
        better = s > best[rest]
        best[rest[better]], other[rest[better]] = s[better], now
        now = int(rest[np.argmax(best[rest])])
        if best[now] >= LEAST_BINS:
            out.append((int(other[now]), now))
    return out


def ordered_pairs(found: set[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=PAIR)


def spanning_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[tuple[bytes, bytes]] = set()
    for table in grouped(batches, ["bucket", "salt"]):
        ids = table.column("th").to_pylist()
        for i, j in forest(matrix(table.column("bins").to_pylist())) if len(ids) > 1 else ():
            if ids[i] != ids[j]:
                found.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
        if len(found) > 20_000:
            yield from ordered_pairs(found)
            found = set()
    yield from ordered_pairs(found)


def aligned_share(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """``similarity`` of two texts by the hashes of their labelled k-mers in text order, or 0 below ``least``."""
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    ranked = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b, a, sorter=ranked), len(b) - 1)
    place = ranked[at]
    there = b[place] == a
    if there.sum() < least * (total - there.sum()) - 1e-9:
        return 0.0
    band = int((1 - least) / (1 + least) * total) + 1
    i = np.flatnonzero(there)
    j = place[i]
    ends: list[int] = []
    for x in j[np.abs(i - j) <= band].tolist():
        k = bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
        else:
            ends[k] = x
    return len(ends) / (total - len(ends))


def crossing_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of stray texts with texts of other classes in one block, each class of the block being tied once.

    All pairs that may join two classes are aligned here, so that only links leave the task.
    """
    found: set[tuple[bytes, bytes]] = set()
    for table in grouped(batches, ["bucket", "salt", "stray_salt"]):
        ids, classes = table.column("th").to_pylist(), pc.dictionary_encode(table.column("comp").combine_chunks()).indices.to_numpy().copy()
        bins, stray = matrix(table.column("bins").to_pylist()), table.column("stray").to_numpy(zero_copy_only=False).astype(bool)
        kmers = [np.frombuffer(x, np.uint32) for x in table.column("kmers").to_pylist()]
        members = np.flatnonzero(~stray)
        for i in np.flatnonzero(stray):
            near = members[classes[members] != classes[i]]
            if not len(near):
                continue
            share = shares(bins[i], bins[near])
            for j in near[share >= LEAST_BINS][np.argsort(-share[share >= LEAST_BINS], kind="stable")]:
                if classes[i] != classes[j] and aligned_share(kmers[i], kmers[j], least) >= least - 1e-12:
                    found.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    classes[classes == classes[i]] = classes[j]
        if len(found) > 20_000:
            yield from ordered_pairs(found)
            found = set()
    yield from ordered_pairs(found)


def members_of(spark: SparkSession, signed_rows: DataFrame) -> DataFrame:
    """Texts in buckets of two and more: bucket, th, n (texts of the bucket), head (its least text id), bins."""
    texts = signed_rows.where("th IS NOT NULL").select("th", "sketches", "bins").dropDuplicates(["th"])
    texts = stored(spark, texts, "omh-texts")
    rows = texts.select("th", F.posexplode("sketches").alias("band", "value")).select("th", F.xxhash64(F.least("band", F.lit(SKETCHES)), "value").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("th").alias("head")).where("n > 1")
    shared = rows.join(sizes, "bucket")
    return stored(spark, shared.join(texts.select("th", "bins"), "th"), "omh-members")


def text_ids(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("th"), F.col(text).alias("t"))


def verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame, text: str, least: float) -> DataFrame:
    """The pairs (a, b of text ids) whose texts align to ``least`` or more."""
    pairs = stored(spark, pairs.distinct(), "omh-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    needed = few(stored(spark, needed, "omh-needed"), BROADCAST_ROWS)
    texts = stored(spark, text_ids(docs, text).join(needed, "th", "left_semi").dropDuplicates(["th"]), "omh-pair-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similarity(tokens(x), tokens(y), least) >= least - 1e-12 for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=PAIR).filter(pa.array(same))

    both = pairs.join(texts.select(F.col("th").alias("a"), F.col("t").alias("ta")), "a")
    both = both.join(texts.select(F.col("th").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")
    return stored(spark, both.mapInArrow(in_slices(run), "a binary, b binary"), "omh-links")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(th, comp) of every linked text: the least id it is connected to.

    Labels move to the least neighbour's or to the label of their label, so the rounds grow with the logarithm of
    a component's width. Labels stay distributed; the driver sees counts. A text of many links and a label of many
    texts are looked up in cells.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(spark, edges, "omh-edges")
    labels = stored(spark, edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("th"), "comp"), "omh-labels")
    ends, texts = buckets_for(edges.count()), buckets_for(labels.count())
    while True:
        around = looked_up(edges, "b", "a", labels.select(F.col("th").alias("b"), "comp"), ends).groupBy("a").agg(F.min("comp").alias("near"))
        jump = looked_up(labels, "comp", "th", labels.select(F.col("th").alias("comp"), F.col("comp").alias("next")), texts)
        moved = jump.join(around.select(F.col("a").alias("th"), "near"), "th")
        new = stored(spark, moved.select("th", F.col("comp").alias("old"), F.least("comp", "near", F.coalesce("next", "comp")).alias("comp")), "omh-labels")
        labels = new.select("th", "comp")
        if not new.where("old <> comp").limit(1).count():
            return labels


def salts(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def links_of(spark: SparkSession, docs: DataFrame, signed_rows: DataFrame, text: str, least: float) -> DataFrame:
    members = members_of(spark, signed_rows)
    mine = F.pmod(F.xxhash64("th"), salts("n")).cast("int")
    blocks = members.select("bucket", "th", "bins", mine.alias("salt"))
    # The head of a bucket stands in each of its blocks and so ties their forests together.
    heads = members.where((F.col("th") == F.col("head")) & (F.col("n") > BLOCK))
    heads = heads.select("bucket", "th", "bins", F.explode(F.sequence(F.lit(0), salts("n") - 1)).alias("salt"), mine.alias("own")).where("salt <> own").drop("own")
    blocks = blocks.unionByName(heads)
    dealt = blocks.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "th")
    tried = stored(spark, dealt.mapInArrow(spanning_pairs, "a binary, b binary").distinct(), "omh-tried")
    links = verified(spark, tried, docs, text, least)

    labels = components(spark, links)
    known = members.join(labels, "th", "left").withColumn("comp", F.coalesce("comp", "th"))
    main = known.where(F.col("th") == F.col("head")).select("bucket", F.col("comp").alias("main"))
    known = stored(spark, known.join(main, "bucket").withColumn("stray", F.col("comp") != F.col("main")), "omh-known")
    strays = known.where("stray").groupBy("bucket").agg(F.count("*").alias("strays"))
    known = stored(spark, known.join(strays, "bucket"), "omh-open")
    needed = stored(spark, known.select("th").distinct(), "omh-needed")

    def kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(hashes(tokens(t)) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(data, pa.binary())], names=["th", "kmers"])

    texts = text_ids(docs, text).join(few(needed, BROADCAST_ROWS), "th", "left_semi").dropDuplicates(["th"])
    open_texts = stored(spark, texts.mapInArrow(in_slices(kmers), "th binary, kmers binary"), "omh-kmers")
    own = F.pmod(F.xxhash64("th"), salts("strays")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), salts(n) - 1))
    sides = known.select("bucket", "th", "comp", "bins", mine.alias("salt"), every("strays").alias("stray_salt"), F.lit(False).alias("stray"))
    sides = sides.unionByName(known.where("stray").select("bucket", "th", "comp", "bins", every("n").alias("salt"), own.alias("stray_salt"), F.lit(True).alias("stray")))
    dealt = sides.join(open_texts, "th").repartition("bucket", "salt", "stray_salt").sortWithinPartitions("bucket", "salt", "stray_salt")
    more = dealt.mapInArrow(lambda batches: crossing_links(batches, least), "a binary, b binary")
    return links.unionByName(verified(spark, more, docs, text, least))


def near_classes(spark: SparkSession, docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with the class of its text.

    Returns ``key``, text_id (md5 of the text, null for null), class_id (the least ``key`` of all rows whose
    texts are linked, directly or through others) and keep (the row has the class's least ``key``, and the least
    text id among rows with that). Equal texts share a class; different texts are linked at an aligned share of
    k-mers of ``least`` or more. Empty texts equal each other; a null text is in a class of its own. Rows that
    repeat wholly are returned each, with equal values. Extra columns aren't read.
    """
    rows = stored(spark, signed(docs, key, text, least), "omh-rows")
    labels = components(spark, links_of(spark, docs, rows, text, least))
    texts = stored(spark, rows.where("th IS NOT NULL").groupBy("th").agg(F.min("k").alias("k")), "omh-first")
    first = F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("th"))
    linked = stored(spark, labels.join(texts, "th"), "omh-linked")
    best = linked.groupBy("comp").agg(F.min(first).alias("best"))
    linked = looked_up(linked, "comp", "th", best, buckets_for(linked.count())).select("th", "best")
    texts = texts.join(linked, "th", "left").select("th", F.coalesce("best", first).alias("best"))
    # Many rows may share one text, and all of them may lack one.
    out = looked_up(rows.select("k", "th"), "th", "k", texts, buckets_for(rows.count()))
    own = F.col("th").isNull()
    return out.select(
        F.col("k").alias(key),
        F.col("th").alias("text_id"),
        F.when(own, F.col("k")).otherwise(F.col("best.k")).alias("class_id"),
        (own | (F.col("k").eqNullSafe(F.col("best.k")) & (F.col("th") == F.col("best.th")))).alias("keep"),
    )


def deduplicate(spark: SparkSession, docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns; of rows that agree in key and text one stays. Null texts all stay."""
    classes = stored(spark, near_classes(spark, docs, least, key, text).select(F.col(key).alias("k"), "text_id", "keep"), "omh-classes")
    rows = packed(docs, key__=F.col(key).cast("long"), id__=F.unhex(F.md5(F.col(text).cast("binary"))))
    gone = few(stored(spark, classes.where("NOT keep").select("k", "text_id").distinct(), "omh-gone"), BROADCAST_ROWS)
    on = F.col("key__").eqNullSafe(F.col("k")) & (F.col("id__") == F.col("text_id"))
    rows = rows.join(gone, on, "left_anti")
    twice = classes.where("keep AND text_id IS NOT NULL").groupBy("k", "text_id").agg(F.count("*").alias("n")).where("n > 1")
    twice = stored(spark, twice.select("k", "text_id"), "omh-twice")
    if twice.limit(1).count():
        twice = few(twice, BROADCAST_ROWS)
        repeated = rows.join(twice, on, "left_semi").dropDuplicates(["key__", "id__"])
        rows = rows.join(twice, on, "left_anti").unionByName(repeated)
    return rows.select("doc__.*")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "keep")
