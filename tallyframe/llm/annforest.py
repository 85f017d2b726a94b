"""Nearest vectors by inner product: a forest of random-projection trees.

Each tree cuts space by random hyperplanes at the medians of a bounded sample; every vector is filed under
its leaf in every tree. A query walks all trees through one priority queue of branches, ordered by how far
the query is from the cuts that lead there. It first scores its own leaves, which bounds how far its
neighbours can be, and then every leaf nearer than ``REACH`` x that distance / sqrt(dimensions): the part of
the distance that a random direction shows. Scores are exact, in double precision, on the original vectors.

Inner products become distances by one more coordinate that gives all vectors the largest norm.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

TREES, SAMPLE, LEAF_ROWS, REACH = 10, 16_384, 128, 0.65
#: Leaves of one block, which a task scores together; vectors and queries of one group, at most about.
BLOCK_LEAVES, CHUNK_ROWS, CHUNK_QUERIES = 64, 16_384, 2_048
#: Parts into which equal vectors are dealt before their least ids are kept.
PARTS = 32


def readable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, vid, vec, norm2, n) of usable vectors: vec as doubles in bytes, vid its md5.

    Null vectors, those of zeros only, and those with null or non-finite components are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float64)
                if len(x) and np.isfinite(x).all() and x.any():
                    x = x + 0.0  # -0.0 equals 0.0
                    data = x.tobytes()
                    out.append((i, hashlib.md5(data).digest(), data, float(x @ x), len(x)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "vid", "vec", "norm2", "n"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(run, "id long, vid binary, vec binary, norm2 double, n int")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 0))


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with a last coordinate that makes their squared norm ``norm2``."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(1)))])


def grow(sample: np.ndarray, rows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """Directions, cuts and depth: node n of a tree has children 2n + 1 (at most the cut) and 2n + 2."""
    rng = np.random.default_rng(seed)
    depth = max(0, min(int(np.log2(max(1, rows / LEAF_ROWS))), int(np.log2(max(1, len(sample) / 8)))))
    nodes = (1 << depth) - 1
    w = rng.standard_normal((TREES, nodes, sample.shape[1] if len(sample) else 1))
    w /= np.linalg.norm(w, axis=2, keepdims=True)
    cuts = np.zeros((TREES, nodes))
    for t in range(TREES):
        at = [np.arange(len(sample))]
        for level in range(depth):
            below = []
            for k, mine in enumerate(at):
                n = (1 << level) - 1 + k
                p = sample[mine] @ w[t, n]
                cuts[t, n] = np.median(p) if len(p) else 0.0
                below += [mine[p <= cuts[t, n]], mine[p > cuts[t, n]]]
            at = below
    return w, cuts, depth


def leaves_of(x: np.ndarray, w: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of each row in one tree."""
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, w[node]) > cuts[node])
    return node - ((1 << depth) - 1)


def reachable(q: np.ndarray, w: np.ndarray, cuts: np.ndarray, depth: int, radius: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, as far as ``radius`` allows; own leaves come first."""
    if not depth:
        return [(t, 0) for t in range(TREES)]
    margins, last = w @ q - cuts, (1 << depth) - 1
    queue, out = [(0.0, t, 0) for t in range(TREES)], []
    while queue:
        far, t, n = heapq.heappop(queue)
        if far > radius:
            break
        row = margins[t]
        while n < last:
            m = row[n]
            away = far if far > abs(m) else abs(m)
            if away <= radius:
                heapq.heappush(queue, (away, t, 2 * n + 1 + (m <= 0)))
            n = 2 * n + 1 + (m > 0)
        out.append((t, n - last))
    return out


PROBE = pa.schema([("block", pa.int64()), ("qid", pa.binary()), ("qvec", pa.binary()), ("bound", pa.float64()), ("leaves", pa.list_(pa.int32()))])
FOUND = pa.schema([("qid", pa.binary()), ("vid", pa.binary()), ("score", pa.float64())])


def score_group(index: pa.Table, probes: pa.Table, most: int) -> pa.Table:
    """Each query's ``most`` best vectors (and their ties) in the leaves that it probes, at its bound or above."""
    if not index.num_rows or not probes.num_rows:
        return FOUND.empty_table()
    x, leaf, vid = matrix(index.column("vec")), index.column("leaf").to_numpy(), index.column("vid").to_pylist()
    order = np.argsort(leaf, kind="stable")
    x, leaf = x[order], leaf[order]
    q, bound = matrix(probes.column("qvec")), probes.column("bound").to_numpy()
    out_q, out_v, out_s = [], [], []
    rough = q @ x.T
    for i, (qid, wanted) in enumerate(zip(probes.column("qid").to_pylist(), probes.column("leaves").to_pylist(), strict=True)):
        first, last = np.searchsorted(leaf, wanted), np.searchsorted(leaf, wanted, "right")
        mine = np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
        # Products of a matrix may differ in the last bits from the row sums below.
        mine = mine[rough[i, mine] >= bound[i] - 1e-9 * (1 + abs(bound[i]))] if np.isfinite(bound[i]) else mine
        if len(mine) > most:
            s = rough[i, mine]
            least = np.partition(s, len(s) - most)[len(s) - most]
            mine = mine[s >= least - 1e-9 * (1 + abs(least))]
        if len(mine):
            out_q += [qid] * len(mine)
            out_v += [vid[order[j]] for j in mine]
            out_s.append((x[mine] * q[i]).sum(1))
    scores = np.concatenate(out_s) if out_s else np.zeros(0)
    return pa.Table.from_arrays([pa.array(out_q, pa.binary()), pa.array(out_v, pa.binary()), pa.array(scores)], schema=FOUND)


def nearest(
    spark: SparkSession, vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows of each query: (query_id, rank, vec_id, score).

    Queries are the rows whose ``key`` is divisible by ``every``; candidates are all rows but the query's own.
    Nearest is the largest inner product; ties go to the smaller key. Null keys, unusable vectors (see
    ``readable``) and vectors of another length than the most common one take no part; rows that repeat wholly
    count once. Equal vectors are filed once, with their k + 1 least keys, which is all that can be returned.
    The trees are fit on ``SAMPLE`` vectors; every vector is indexed, and none is capped.
    """
    rows = stored(spark, readable(vectors, key, vector), "ann-rows")
    lengths = rows.groupBy("n").agg(F.count("*").alias("rows"), F.max("norm2").alias("norm2")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, norm2 = lengths[0]["n"], lengths[0]["norm2"]
    rows = rows.where(F.col("n") == size).select("id", "vid", "vec")
    # A common vector's ids are thinned in parts first, so none sees them all.
    part = Window.partitionBy("vid", F.pmod(F.xxhash64("id"), F.lit(PARTS))).orderBy("id")
    ids = rows.select("id", "vid").distinct().withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    ids = ids.groupBy("vid").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    ids = stored(spark, ids, "ann-ids")
    distinct = stored(spark, rows.select("vid", "vec").dropDuplicates(["vid"]), "ann-vectors")
    sample = [r["vec"] for r in distinct.orderBy("vid").limit(SAMPLE).collect()]  # md5 order is a random one
    sample = np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), size)
    model = spark.sparkContext.broadcast((*grow(lifted(sample, norm2), distinct.count()), norm2))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts, depth, norm2 = model.value
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                batch = whole.slice(s, 2000)
                x = lifted(matrix(batch.column("vec")), norm2)
                for t in range(TREES):
                    leaf = leaves_of(x, w[t], cuts[t], depth)
                    yield pa.RecordBatch.from_arrays([pa.array((t << 32) + leaf // BLOCK_LEAVES), pa.array(leaf.astype(np.int32)), batch.column("vid"), batch.column("vec")], names=["block", "leaf", "vid", "vec"])

    index = stored(spark, distinct.select("vid", "vec").mapInArrow(file, "block long, leaf int, vid binary, vec binary"), "ann-index")
    sizes = stored(spark, index.groupBy("block").agg(F.count("*").alias("n")), "ann-sizes")
    salts = F.ceil(F.col("n") / CHUNK_ROWS).cast("int")

    def probes(queries: DataFrame) -> DataFrame:
        """Blocks that each query (qid, qvec, bound) searches; without a bound, those of its own leaves."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, cuts, depth, norm2 = model.value
            for batch in batches:
                out = []
                for qid, qvec, bound in zip(*(batch.column(c).to_pylist() for c in ("qid", "qvec", "bound")), strict=True):
                    q = np.frombuffer(qvec, np.float64)
                    q = q * np.sqrt(norm2 / (q @ q))
                    scale = np.sqrt(norm2) / np.linalg.norm(np.frombuffer(qvec, np.float64))
                    radius = 0.0 if bound is None else np.inf if bound == -np.inf else REACH * np.sqrt(max(0.0, 2 * norm2 - 2 * bound * scale) / (len(q) + 1))
                    by: dict[int, list[int]] = {}
                    for t, leaf in reachable(np.append(q, 0.0), w, cuts, depth, radius):
                        by.setdefault((t << 32) + leaf // BLOCK_LEAVES, []).append(leaf)
                    out += [(b, qid, qvec, -np.inf if bound is None else bound, sorted(x)) for b, x in by.items()]
                    if len(out) > 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PROBE, strict=True)], schema=PROBE)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PROBE, strict=True)], schema=PROBE)

        return queries.mapInArrow(walk, "block long, qid binary, qvec binary, bound double, leaves array<int>")

    def searched(queries: DataFrame) -> DataFrame:
        asked = probes(queries)
        asked = stored(spark, asked, "ann-probes")
        groups = asked.groupBy("block").agg(F.count("*").alias("m")).join(sizes, "block")
        queries_in = F.ceil(F.col("m") / CHUNK_QUERIES).cast("int")
        groups = F.broadcast(stored(spark, groups.select("block", salts.alias("salts"), queries_in.alias("turns")), "ann-groups"))
        # Large blocks are cut into chunks of vectors and of queries, which all meet.
        left = index.join(groups, "block").select("block", "leaf", "vid", "vec", F.pmod(F.xxhash64("vid"), "salts").cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        right = asked.join(groups, "block").select("block", "qid", "qvec", "bound", "leaves", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("qid"), "turns").cast("int").alias("turn"))
        keys = ["block", "salt", "turn"]
        most = k + 1
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: score_group(a, b, most), "qid binary, vid binary, score double")
        return stored(spark, met.distinct(), "ann-found")

    asked = rows.where(F.col("id") % every == 0).select("id", "vid")
    queries = distinct.join(asked.select("vid").distinct(), "vid", "left_semi").select(F.col("vid").alias("qid"), F.col("vec").alias("qvec"))
    queries = stored(spark, queries, "ann-queries")
    near = searched(queries.withColumn("bound", F.lit(None).cast("double")))
    # Rows of equal vectors count each, so their number decides which score is the k + 1st.
    counted = near.join(ids.select("vid", F.size("ids").alias("c")), "vid")
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    reached = counted.withColumn("sum", F.sum("c").over(by_score)).where(F.col("sum") >= k + 1).groupBy("qid").agg(F.max("score").alias("b"))
    queries = queries.join(reached, "qid", "left").select("qid", "qvec", F.coalesce("b", F.lit(float("-inf"))).alias("bound"))
    found = searched(queries).unionByName(near).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = found.join(ids, "vid").join(asked.select(F.col("id").alias("query_id"), F.col("vid").alias("qid")).distinct(), "qid")
    pairs = pairs.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return pairs.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding."""
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
