"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over
the counts of vote patterns estimates how accurate each labeller is and how common bad documents are; the
posterior of a document's pattern is its weak label. The posteriors of a bounded sample train a linear scorer
over hashed features, which scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_slices, stored

#: Dimensions of the hashed features.
DIMENSIONS = 1 << 12
#: Documents that train the scorer, at most: the least hashes, so reruns agree.
SAMPLE = 6000
ROUNDS = 60
#: Value of a vote among the scorer's features.
VOTE = 2.0
#: Words of a stretch whose distinct words are counted, and odd factors that hash five words in a row.
STRETCH, FACTORS = 200, np.array([3, 1000003, 998244353, 7919, 104729])
#: Start weight of a fault, and priors of a labeller that sees one in a good text or says 'good' of a bad one.
FAULT, FALSE_ALARM, MISSED, ANCHOR = 8.0, 0.002, 0.7, 5.0
LABELLERS = ("symbols", "capitals", "pipes", "runs", "repeats", "marks")

#: A byte's class: letters a/A, digits 0, white space as a space, bytes of other characters as letters, the rest as it is.
SHAPES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b <= 32 or b == 127 else b for b in range(256))
#: Bytes that prose uses: letters, digits, white space and common punctuation.
PLAIN = np.array([chr(b) in " .,;:?!'\"()-aA0" for b in range(128)] + [True] * 128)


def measures(data: bytes) -> tuple[float, ...]:
    """Shares over a whole text, and its words: symbols, capitals, bars, repeated neighbours, distinct words, marks, repeated passages.

    Distinct words are counted in stretches of ``STRETCH`` words, as their share falls with the length of any text;
    a repeated passage is five words in a row that have stood in the text before.
    """
    shape = np.frombuffer(data.translate(SHAPES), np.uint8)
    n = max(1, len(shape))
    counts = np.bincount(shape, minlength=128)
    odd = counts[~PLAIN[: len(counts)]].sum() / n
    letters = counts[97] + counts[65]
    own = data.split()
    k = max(1, len(own))
    same = sum(map(bytes.__eq__, own, own[1:])) / k
    distinct = sum(len(set(own[i : i + STRETCH])) for i in range(0, len(own), STRETCH)) / k
    hashes = np.fromiter(map(hash, own), np.int64, len(own))
    passages = sum(hashes[i : len(own) - 4 + i] * f for i, f in enumerate(FACTORS)) if len(own) >= 5 else hashes[:0]
    again = 1 - len(set(passages.tolist())) / len(passages) if len(passages) else 0.0
    marks = (data.count(b"!!") + data.count(b"##") + data.count(b"**") + data.count(b"%%") + data.count(b"&&") + data.count(b"$$")) / k
    return odd, counts[65] / max(1, letters), counts[124] / k, same, distinct, marks, again, float(k)


def votes(m: tuple[float, ...]) -> list[int]:
    """1 good, -1 bad, 0 nothing, of each labeller in order; short texts give little to vote on."""
    odd, capitals, bars, same, distinct, marks, again, k = m
    if k < 5:
        return [0] * len(LABELLERS)

    def vote(x: float, good: float, bad: float) -> int:
        return 1 if x <= good else -1 if x >= bad else 0

    return [
        vote(odd, 0.002, 0.03),
        vote(capitals, 0.08, 0.3),
        vote(bars, 0.002, 0.1),
        vote(same, 0.02, 0.15),
        (-1 if distinct <= 0.12 or again >= 0.5 else 1 if distinct >= 0.3 and again <= 0.2 else 0) if k >= 40 else 0,
        vote(marks, 0.002, 0.1),
    ]


def features(data: bytes, m: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (index, value): shares of triples of byte classes, measures in steps, and votes."""
    shape = np.frombuffer(data.translate(SHAPES), np.uint8).astype(np.uint32)
    if len(shape) >= 3:
        triple = (shape[:-2] << np.uint32(14)) | (shape[1:-1] << np.uint32(7)) | shape[2:]
        # A triple without symbols, capitals or digits says nothing about form beyond its share.
        h = (triple * np.uint32(2654435761)) >> np.uint32(20)
        counts = np.bincount(h, minlength=DIMENSIONS).astype(np.float64)
        at = np.flatnonzero(counts)
        value = np.sqrt(counts[at] / len(triple))
    else:
        at, value = np.zeros(0, np.int64), np.zeros(0)
    steps = [zlib.crc32(f"{i}:{int(min(x, 1.0) * 20 + 0.5)}".encode()) % DIMENSIONS for i, x in enumerate(m[:-1])]
    # Votes carry what is learnt of one text with a fault over to others that have it to another degree.
    said = [zlib.crc32(f"vote {i}:{v}".encode()) % DIMENSIONS for i, v in enumerate(votes(m)) if v]
    values = [value, np.full(len(steps), 0.5), np.full(len(said), VOTE)]
    return np.concatenate([at, steps, said]).astype(np.int32), np.concatenate(values)


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior of 'good' for each vote pattern, given how often each occurs.

    Labellers are independent given the class; each votes on part of the documents and is right with its own
    probability in either class. Each labeller looks for one fault and says 'good' of texts with other faults, so
    the start weighs a 'bad' as ``FAULT`` times a 'good'; this also decides which class is 'good'. Faults that seldom
    meet in one text would let the classes run together, so both rates have priors that grow with the votes: false
    alarms at ``FALSE_ALARM``, weighing ``ANCHOR`` times all votes, faults missed at ``MISSED``, weighing as the votes
    on bad texts.
    """
    if not patterns:
        return {}
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    q = 1 / (1 + np.exp(-np.where(v > 0, 1.0, FAULT * v).sum(1)))
    for _ in range(rounds):
        good, bad = (n * q).sum() + 2, (n * (1 - q)).sum() + 1
        logit = np.full(len(n), np.log(good / bad))
        for j in range(v.shape[1]):
            voted = v[:, j] != 0
            held = ANCHOR * n[voted].sum() + 5
            right = ((n * q)[voted & (v[:, j] == 1)].sum() + (1 - FALSE_ALARM) * held) / ((n * q)[voted].sum() + held)
            rest = (n * (1 - q))[voted].sum()
            wrong = ((n * (1 - q))[voted & (v[:, j] == 1)].sum() + MISSED * (rest + 5)) / (rest + rest + 5)
            logit += np.where(v[:, j] == 1, np.log(right / wrong), 0) + np.where(v[:, j] == -1, np.log((1 - right) / (1 - wrong)), 0)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return {p: float(x) for (p, _), x in zip(patterns, q, strict=True)}


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full gradients with a step per weight (AdaGrad)."""
    w, b = np.zeros(size), 0.0
    if not rows:
        return w, b
    at = np.concatenate([i for i, _ in rows])
    value = np.concatenate([x for _, x in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    gw, gb, n = np.full(size, 1e-8), 1e-8, len(rows)
    for _ in range(ROUNDS):
        z = np.bincount(row, value * w[at], minlength=n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad, gbias = np.bincount(at, value * error[row], minlength=size) / n + l2 * w, error.mean()
        gw += grad**2
        gb += gbias**2
        w -= 0.5 * grad / np.sqrt(gw)
        b -= 0.5 * gbias / np.sqrt(gb)
    return w, b


def voted(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``columns`` and the votes of all labellers on the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [votes(measures((t or "").encode("utf-8", "surrogatepass"))) for t in batch.column("t__").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h__"), pa.array(v, pa.list_(pa.int8()))], names=["h__", "votes"])

    rows = docs.select(F.xxhash64(*columns).alias("h__"), F.col(text).alias("t__"))
    return rows.mapInArrow(in_slices(run), "h__ long, votes array<tinyint>")


def fit(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[dict, np.ndarray, float]:
    """Posteriors by vote pattern, from all rows, and the scorer's weights, from ``SAMPLE`` rows."""
    rows = stored(spark, voted(docs, text, [key, text]), "votes")
    # At most 3^6 patterns come to the driver.
    patterns = [(tuple(r["votes"]), r["n"]) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()]
    posterior = em(sorted(patterns))
    # The least hashes of all rows; equal rows have equal hashes and count once.
    picked = rows.select("h__").distinct().orderBy("h__").limit(SAMPLE)
    limit = picked.agg(F.max("h__")).first()[0]
    if limit is None:
        return posterior, np.zeros(DIMENSIONS), 0.0

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, t in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                m = measures(data)
                at, value = features(data, m)
                out.append((h, posterior[tuple(votes(m))], at.astype("<u2").tobytes(), value.astype("<f4").tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["h", "good", "at", "value"])

    chosen = docs.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("t")).where(F.col("h") <= limit)
    got = chosen.mapInArrow(in_slices(describe), "h long, good double, at binary, value binary").dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).collect()
    rows_ = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in got]
    w, b = train(rows_, np.array([r["good"] for r in got]), DIMENSIONS)
    return posterior, w, b


def score_quality(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Every row with its weak label and its score.

    Returns ``columns`` (``key`` alone by default), weak_good (posterior of the row's votes), score (probability
    of good quality by the linear scorer) and keep (score at ``least`` or above). Null and empty texts get no
    votes and are scored by the prior and the bias. Repeated rows and null keys are kept, extra columns pass only
    if named, and none may be called weak_good, score or keep. Equal texts get equal votes and scores, so ties change
    nothing. Texts of any length are read whole. An empty table gives no rows.
    """
    posterior, w, b = fit(spark, docs, key, text)
    columns = columns or [key]
    model = spark.sparkContext.broadcast((posterior, w, b))  # 32 KB of weights and 729 patterns at most
    inner = [f"c{i}__" for i in range(len(columns))]
    body = inner[columns.index(text)] if text in columns else "t__"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w, b = model.value
        for batch in batches:
            good, score = [], []
            for t in batch.column(body).to_pylist():
                data = (t or "").encode("utf-8", "surrogatepass")
                m = measures(data)
                at, value = features(data, m)
                good.append(posterior[tuple(votes(m))])
                score.append(float(1 / (1 + np.exp(-np.clip(w[at] @ value + b, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in inner], pa.array(good, pa.float64()), pa.array(score, pa.float64())], names=[*inner, "weak_good", "score"])

    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(columns, inner, strict=True)], *([] if text in columns else [F.col(text).alias(body)]))
    schema = StructType([*[rows.schema[i] for i in inner], StructField("weak_good", DoubleType()), StructField("score", DoubleType())])
    out = rows.mapInArrow(in_slices(run), schema)
    return out.select(*[F.col(i).alias(c) for c, i in zip(columns, inner, strict=True)], "weak_good", "score", (F.col("score") >= least).alias("keep"))


def op3_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return score_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
