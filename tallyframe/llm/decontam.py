"""Benchmark decontamination over a positional inverted index.

The index is split by documents into segments. A segment's index lists, for every term of the benchmark,
the positions where it stands in the segment's text; documents stand one after another with gaps, so that
one integer says both which document and where. A phrase is found by intersecting the lists of its terms,
each shifted by the term's offset in the phrase, from the term that is rarest in the whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, stored, words

#: Words of one segment, about; a longer document is a segment of its own.
SEGMENT_WORDS = 500_000
#: Phrases of the benchmark that are searched at a time, about, and those of one piece of an item.
BLOCK_PHRASES, PIECE_PHRASES = 200_000, 10_000
#: Fixed value: words, as ``common.words`` finds them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INDEX = "segment string, keys array<string>, starts array<bigint>, sizes array<bigint>, terms array<int>, counts array<int>, places binary"


def build_index(docs: DataFrame, terms: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment: its documents and the positions of ``terms`` (word to number), as gaps in 32 bits.

    ``starts`` are positions of the documents' first words. Gaps between positions of one term compress to
    about a byte each.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number_of = TaskContext.get().partitionId(), count()
        keys, starts, sizes, found, at = [], [], [], [], 0
        schema = pa.schema([("segment", pa.string()), ("keys", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("places", pa.binary())])

        def flush() -> pa.RecordBatch:
            nonlocal at
            term = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.int32)
            place = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            number, first, times = np.unique(term, return_index=True, return_counts=True)
            gaps = np.diff(place, prepend=0)
            gaps[first] = place[first]
            out = pa.RecordBatch.from_pylist([{"segment": f"{part}-{next(number_of)}", "keys": list(keys), "starts": list(starts), "sizes": list(sizes), "terms": number.tolist(), "counts": times.tolist(), "places": gaps.astype("<u4").tobytes()}], schema)
            for x in (keys, starts, sizes, found):
                x.clear()
            at = 0
            return out

        get, none = terms.get, repeat(-1)
        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                own = words(t)
                if keys and at + len(own) > SEGMENT_WORDS:
                    yield flush()
                numbers = np.fromiter(map(get, own, none), np.int32, len(own))
                there = np.flatnonzero(numbers >= 0)
                keys.append(k)
                starts.append(at)
                sizes.append(len(own))
                found.append((numbers[there], there + at))
                at += len(own) + 1  # the gap keeps phrases inside one document
        if keys:
            yield flush()

    return docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(in_slices(index), INDEX)


def postings(row: dict) -> dict[int, np.ndarray]:
    gaps = np.frombuffer(row["places"], "<u4")
    ends = np.cumsum(row["counts"])
    return {t: np.cumsum(gaps[e - c : e], dtype=np.int64) for t, c, e in zip(row["terms"], row["counts"], ends, strict=True)}


def near(wanted: np.ndarray, have: np.ndarray, slop: int) -> np.ndarray:
    """Which of ``wanted`` have a member of the sorted ``have`` within ``slop``."""
    if not len(have):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(have, wanted - slop)
    ok = at < len(have)
    ok[ok] = have[at[ok]] <= wanted[ok] + slop
    return ok


def find_phrase(lists: dict[int, np.ndarray], phrase: tuple[int, ...], order: list[int], slop: int = 0) -> np.ndarray:
    """Starts of a phrase. ``order``: offsets in the phrase, that of the rarest term first.

    With ``slop``, every other term may stand so many words from its place: a proximity match.
    """
    none = np.zeros(0, np.int64)
    starts = lists.get(phrase[order[0]], none) - order[0]
    for o in order[1:]:
        if not len(starts):
            break
        starts = starts[near(starts + o, lists.get(phrase[o], none), slop)]
    return starts


def windows(items: list[tuple], size: int) -> dict[tuple[bytes, ...], set]:
    """Phrases of ``size`` consecutive words, or all words of a shorter item, and the items that have them."""
    out: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            out.setdefault(tuple(own[i : i + size]), set()).add(item)
    return out


RAW = pa.schema([("segment", pa.string()), ("ordinal", pa.int32()), ("k", pa.string()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
RAW_DDL = "segment string, ordinal int, k string, n_words long, starts array<long>, lengths array<int>, items array<string>"
FOUND = pa.schema([("k", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("match_starts", pa.list_(pa.int64())), ("match_lengths", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
FOUND_DDL = "k string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, match_starts array<long>, match_lengths array<int>, items array<string>"


def digested(r: dict) -> dict:
    """A document's matches with their counts: words in any range of words, items once each."""
    items, hit, end = sorted(set(r["items"])), 0, 0
    matches = sorted(set(zip(r["starts"], r["lengths"], strict=True)))
    for s, n in matches:
        hit += max(0, s + n - max(s, end))
        end = max(end, s + n)
    return {"k": r["k"], "n_words": r["n_words"], "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": hit > 0, "match_starts": [s for s, _ in matches], "match_lengths": [n for _, n in matches], "items": items}


def wanted(lists: dict[int, np.ndarray], plan: dict[int, list[tuple]]) -> Iterator[tuple]:
    """The phrases whose two rarest terms a segment holds."""
    for t in lists if len(lists) < len(plan) else plan:
        if t in lists:
            for x in plan.get(t, ()):
                if len(x[1]) < 2 or x[0][x[1][1]] in lists:
                    yield x


def pieces(benchmark: DataFrame, size: int, item: str, item_text: str) -> DataFrame:
    """Items (i, t, n, s) cut into pieces of ``PIECE_PHRASES`` phrases: t their words, n their phrases, s where they begin."""
    low = F.translate(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").distinct()
    rows = rows.select("i", F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    rows = rows.select("i", "w", F.greatest(F.size("w") - size + 1, F.lit(1)).alias("all"))
    rows = rows.select("i", "w", "all", F.explode(F.sequence(F.lit(0), F.col("all") - 1, F.lit(PIECE_PHRASES))).alias("s"))
    return rows.select("i", F.array_join(F.slice("w", F.col("s") + 1, PIECE_PHRASES + size - 1), " ").alias("t"), F.least(F.col("all") - F.col("s"), F.lit(PIECE_PHRASES)).alias("n"), "s")


def search(spark: SparkSession, docs: DataFrame, items: list[tuple], size: int, slop: int, key: str, text: str, whole: bool) -> DataFrame:
    """Matches of one block of items in every document: raw ones, or, where the block is the whole benchmark, digested."""
    phrases = windows(items, size)
    terms = {w: i for i, w in enumerate(dict.fromkeys(w for p in phrases for w in p))}
    index = stored(spark, build_index(docs, terms, key, text), "postings")
    # One row per term of this block of the benchmark, so at most as many as it has words.
    counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    often = {r["terms"]: r["n"] for r in counted.collect()}
    # By its rarest term: a segment looks up the phrases of terms that it holds, not all phrases.
    plan: dict[int, list[tuple]] = {}
    for p, own in phrases.items():
        p = tuple(terms[w] for w in p)
        if all(t in often for t in p):  # else the phrase isn't in the corpus
            order = sorted(range(len(p)), key=lambda o: (often[p[o]], o))
            plan.setdefault(p[order[0]], []).append((p, order, sorted(own, key=str)))
    plan = spark.sparkContext.broadcast(plan)  # BLOCK_PHRASES phrases, about

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from segment(batch.slice(i, 1).to_pylist()[0])

    def segment(row: dict) -> Iterator[pa.RecordBatch]:
        lists, starts = postings(row), np.array(row["starts"], np.int64)
        hits: dict[int, tuple[list, set]] = {}
        for p, order, own in wanted(lists, plan.value):
            for s in find_phrase(lists, p, order, slop).tolist():
                d = int(np.searchsorted(starts, s, "right")) - 1
                if s < 0 or s + len(p) > starts[d] + row["sizes"][d]:
                    continue  # only with slop: the phrase would pass the document's end
                ranges, found = hits.setdefault(d, ([], set()))
                ranges.append((s - row["starts"][d], len(p)))
                found.update(own)
        out = []
        for d, (k, n) in enumerate(zip(row["keys"], row["sizes"], strict=True)):
            ranges, found = hits.get(d, ((), ()))
            raw = {"segment": row["segment"], "ordinal": d, "k": k, "n_words": n, "starts": [s for s, _ in ranges], "lengths": [x for _, x in ranges], "items": [str(x) for x in found if x is not None]}
            out.append(digested(raw) if whole else raw)
        for i in range(0, len(out), 5000):
            yield pa.RecordBatch.from_pylist(out[i : i + 5000], FOUND if whole else RAW)

    return index.mapInArrow(in_slices(match), FOUND_DDL if whole else RAW_DDL)


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    slop: int = 0,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with the benchmark passages in it.

    Returns ``key``, n_words, n_hit (words inside any occurrence of a window of ``size`` item words), n_items,
    items_sha256, contaminated, and the matches themselves: match_starts and match_lengths (in words) and
    items (ids as strings, sorted). ``slop`` 0 finds exact phrases, more finds proximity matches.

    Null or wordless texts and items have no windows. Null item ids count as hits but name no item. Repeated
    rows are searched and returned each, and equal texts get equal results, so ties change nothing; ``key`` may be of
    any type that a string can be cast back to; extra columns aren't read; an empty table gives no rows. A very long
    text is a segment of its own. The benchmark is searched in blocks of ``BLOCK_PHRASES`` phrases, long items in
    pieces, so its size has no limit; each block reads the documents once.
    """
    kind = docs.schema[key].dataType
    cut = stored(spark, pieces(benchmark, size, item, item_text), "benchmark-pieces")
    total = cut.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_PHRASES))
    parts = []
    if blocks > 1:  # segments must hold the same rows for every block
        docs = stored(spark, docs.select(key, text), "documents")
    for b in range(blocks):
        # BLOCK_PHRASES on average, read one block at a time.
        mine = cut if blocks == 1 else cut.where(F.pmod(F.xxhash64("i", "s", "t"), F.lit(blocks)) == b)
        parts.append(search(spark, docs, [(r["i"], r["t"]) for r in mine.select("i", "t").collect()], size, slop, key, text, blocks == 1))
    found = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        # Rows of a document meet by segment and place in it; segments are the same for every block.
        found = found.groupBy("segment", "ordinal", "k", "n_words").agg(flat("starts"), flat("lengths"), flat("items"))

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pylist([digested(r) for r in batch.to_pylist()], FOUND)

        found = found.mapInArrow(in_slices(digest), FOUND_DDL)
    return found.withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)


DIGEST = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(spark, docs, items).select(*DIGEST)


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM q), p AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, sizes WHERE len(ws) >= n)
), m AS (SELECT p.doc_id, p.i, p.n, q.item_id FROM p JOIN q ON p.n = q.n AND p.phrase = q.phrase
), h AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY 1
), t AS (
  SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""
