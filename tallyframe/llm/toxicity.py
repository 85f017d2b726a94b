"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a linear model over hashed words that also sees the
probabilities of the earlier categories. In training these come out of fold: each row's are predicted by
models that didn't see the row, so later models learn from predictions as good as those they will get.

Labels mark toxic documents only; the categories before it come from them. Marker words, and stems of four and five bytes,
are those that toxic training documents hold far more often than others. A toxic document with a marker word is an
'insult', one with a stem that only toxic documents have a 'slur', one with three markers or more 'harassment'.
'toxic' itself, the label, is the last model of the chain: what the earlier ones say decides it together with the words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_slices, stored, words

CATEGORIES = ("insult", "slur", "harassment", "toxic")
#: Dimensions of the hashed words; labelled rows that train the models, at most, and bytes of their features: those of
#: the least hashes.
DIMENSIONS, SAMPLE, SAMPLE_BYTES = 1 << 18, 8_000, 96_000_000
FOLDS, ROUNDS, L2 = 3, 100, 1e-5
#: What an earlier probability counts beside a word, which counts 1: its distance from one half is taken so many times.
HEARD = 8.0
#: How strongly a feature must tell the classes apart.
LEAST_ROOT = 4.0
#: Words whose scores a worker remembers.
REMEMBERED = 400_000
#: Toxic documents that a marker is in, at least; times that their share is that of others; markers of 'harassment'.
MARKED, TIMES, HARASSMENT = 3, 20, 3


def slots(word: bytes) -> tuple[int, int, int]:
    """Features of a word: itself, and its first four and five bytes, which inflected forms share."""
    crc = zlib.crc32
    return crc(word) % DIMENSIONS, crc(b"4" + word[:4]) % DIMENSIONS, crc(b"5" + word[:5]) % DIMENSIONS


class Rows:
    """Sparse rows: each distinct word of a text adds its features once."""

    def __init__(self, hashed: list[np.ndarray]):
        """``hashed``: for each row, the features of its distinct words as rows of three."""
        sizes = [x.size for x in hashed]
        self.at = np.concatenate([x.ravel() for x in hashed]).astype(np.int32) if hashed else np.zeros(0, np.int32)
        self.n = len(hashed)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)

    def pick(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and new row numbers of the chosen rows."""
        number = np.full(self.n, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        keep = number[self.row] >= 0
        return self.at[keep], number[self.row[keep]]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def heard(p: np.ndarray) -> np.ndarray:
    """Earlier probabilities as inputs of a later model."""
    return HEARD * (p - 0.5)


def telling(at: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which features tell the classes apart: the signed root of G² is ``LEAST_ROOT`` or more in size.

    Most hashed words are too rare to say anything; without this their noise adds up in long texts.
    """
    total = np.bincount(at, minlength=DIMENSIONS).astype(float)
    hits = np.bincount(at, y[row], minlength=DIMENSIONS)
    share = np.bincount(row, minlength=len(y)) @ y / max(1, len(row))
    part = lambda n, e: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    g = 2 * (part(hits, total * share) + part(total - hits, total * (1 - share)))
    return g >= LEAST_ROOT**2


def fit_linear(at: np.ndarray, row: np.ndarray, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression: weights of hashed words, of the earlier probabilities, and a bias."""
    w, v, b = np.zeros(DIMENSIONS), np.zeros(extra.shape[1]), 0.0
    if not len(y):
        return w, v, -30.0
    n, used = len(y), telling(at, row, y)
    keep = np.flatnonzero(used[at])
    at, row = at[keep], row[keep]
    gw, gv, gb = np.full(DIMENSIONS, 1e-6), np.full(extra.shape[1], 1e-6), 1e-6
    for _ in range(ROUNDS):
        error = (logistic(np.bincount(row, w[at], minlength=n) + extra @ v + b) - y) / n
        grad = np.bincount(at, error[row], minlength=DIMENSIONS) + L2 * w
        gw += grad**2
        w -= 0.3 * grad / np.sqrt(gw)
        if len(v):
            grad = extra.T @ error + L2 * v
            gv += grad**2
            v -= 0.3 * grad / np.sqrt(gv)
        gb += error.sum() ** 2
        b -= 0.3 * error.sum() / np.sqrt(gb)
    return w, v, b


def fit_chain(rows: Rows, targets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], np.ndarray]:
    """One model per column of ``targets``, in order, and what models that didn't see a row predict for it."""
    fold = np.arange(rows.n) % FOLDS
    seen, chain = np.zeros((rows.n, 0)), []
    for c in range(targets.shape[1]):
        y, out = targets[:, c], np.zeros(rows.n)
        for f in range(FOLDS):
            a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w, v, bias = fit_linear(*rows.pick(a), heard(seen[a]), y[a])
            at, row = rows.pick(b)
            out[b] = logistic(np.bincount(row, w[at], minlength=len(b)) + heard(seen[b]) @ v + bias)
        chain.append(fit_linear(rows.at, rows.row, heard(seen), y))
        seen = np.column_stack([seen, out])
    return chain, seen


def category_labels(toxic: np.ndarray, rows: Rows) -> np.ndarray:
    """Targets of all categories from the labels of the last; markers are hashed words and stems."""

    def marked(at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many markers each row has."""
        bad = np.bincount(at, toxic[row], minlength=DIMENSIONS)
        rest = np.bincount(at, minlength=DIMENSIONS) - bad
        n_bad, n_rest = max(1.0, toxic.sum()), max(1.0, len(toxic) - toxic.sum())
        markers = (bad >= MARKED) & (bad / n_bad > TIMES * (rest + 0.5) / n_rest)
        return np.bincount(row, markers[at], minlength=len(toxic))

    words_, stems = marked(rows.at[0::3], rows.row[0::3]), marked(rows.at[2::3], rows.row[2::3])
    yes = toxic > 0
    return np.column_stack([yes & (words_ > 0), yes & (stems > 0), yes & (words_ >= HARASSMENT), yes]).astype(float)


def hashed_words(text: str | None) -> np.ndarray:
    """Features of a text's distinct words, three a row, in the order of the words."""
    own = sorted(set(words(text)))
    return np.array([slots(w) for w in own], np.int32).reshape(len(own), 3)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list, float]:
    """The chain, and the probability of 'toxic' above which rows are told apart best by models that didn't see them.

    Texts become features where they are; ``SAMPLE`` rows and ``SAMPLE_BYTES`` of features come to the driver at most.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    # Keys that repeat count once, as toxic if any row says so.
    picked = marked.groupBy("k").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [hashed_words(t).astype("<i4").tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("k"), batch.column("y"), pa.array(data, pa.binary())], names=["h", "k", "y", "at"])

    rows = rows.groupBy("h", "k", "y").agg(F.min("t").alias("t")).select("h", F.col("k").cast("string").alias("k"), F.col("y").cast("double").alias("y"), "t")
    rows = stored(spark, rows.mapInArrow(in_slices(describe), "h long, k string, y double, at binary"), "toxicity-sample")
    sizes = sorted((r["h"], r["k"], r["n"]) for r in rows.select("h", "k", F.octet_length("at").alias("n")).collect())
    total = np.cumsum([n for *_, n in sizes])
    fits = int(np.searchsorted(total, SAMPLE_BYTES, "right"))
    if not fits:
        return [], 1.0
    got = sorted(rows.where(F.col("h") <= sizes[fits - 1][0]).collect(), key=lambda r: (r["h"], r["k"]))[:fits]
    toxic = np.array([float(r["y"] > 0) for r in got])
    if toxic.min() == toxic.max():
        return [], 1.0
    sparse = Rows([np.frombuffer(r["at"], "<i4").reshape(-1, 3) for r in got])
    del got
    chain, seen = fit_chain(sparse, category_labels(toxic, sparse))
    return chain, threshold(seen[:, -1], toxic)


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut in the middle of the gap with the best F1 on held-out rows; 0.5 without rows of both kinds."""
    if not len(p) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0
    i = int(np.argmax(f1))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0.0)) / 2)


def score_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", least: float | None = None, chain: tuple[list, float] | None = None
) -> DataFrame:
    """Probabilities of each category for every row.

    Returns ``key``, p_insult, p_slur, p_harassment, p_toxic and toxic (p_toxic, of the chain's last model, at
    ``least`` or above; by default the threshold found on labelled rows by models that didn't see them). Null and empty
    texts have no words and get probability 0, never toxic. Without labels of both kinds nothing is toxic and
    probabilities are 0. Labels of repeated keys count once, as toxic if any is; a key's training text is its least
    one. Repeated rows and null keys are kept, equal rows with equal results, so ties change nothing; extra columns
    aren't read; an empty table gives no rows. Texts of any length are read whole.
    ``chain``, a pair of models and threshold, replaces what is trained here.
    """
    chain, cut = chain or fit(spark, docs, labels, key, text, label)
    cut = cut if least is None else least
    models = spark.sparkContext.broadcast([(w.astype(np.float32), v, b) for w, v, b in chain])  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        weights = np.stack([w for w, _, _ in models.value]) if models.value else None
        for batch in batches:
            out = np.zeros((batch.num_rows, len(CATEGORIES)))
            for i, t in enumerate(batch.column("t").to_pylist() if models.value else ()):
                own = set(words(t))
                new = [w for w in own if w not in known]
                if new:
                    if len(known) > REMEMBERED:
                        known.clear()
                        new = list(own)
                    at = np.array([slots(w) for w in new])
                    for w, s in zip(new, map(tuple, weights[:, at].sum(2, dtype=np.float64).T.tolist()), strict=True):
                        known[w] = s
                if own:
                    # A set's order isn't fixed, and sums of doubles depend on it.
                    z = np.array(sorted(map(known.__getitem__, own))).sum(0)
                    for c, (_, v, b) in enumerate(models.value):
                        out[i, c] = logistic(z[c] + heard(out[i, :c]) @ v + b)
            yield pa.RecordBatch.from_arrays([batch.column("k"), *[pa.array(out[:, c]) for c in range(len(CATEGORIES))]], names=["k", *[f"p_{c}" for c in CATEGORIES]])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = rows.mapInArrow(in_slices(run), StructType([rows.schema["k"], *[StructField(f"p_{c}", DoubleType()) for c in CATEGORIES]]))
    return out.select(F.col("k").alias(key), *[f"p_{c}" for c in CATEGORIES], ((F.col("p_toxic") >= cut) & (F.col("p_toxic") > 0)).alias("toxic"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, trained on the labels."""
    return score_toxicity(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
