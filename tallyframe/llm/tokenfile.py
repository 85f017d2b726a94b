"""Token ids in shard files with Elias-Fano coded document boundaries.

A shard file holds the ids of its documents one after another and, in place of a table of 64-bit
offsets, an Elias-Fano code of where each document ends: about 2 + log2(ids per document) bits a
document. A sampled select structure finds any boundary without decoding the rest.

File layout (little-endian): 8 magic bytes, the header (see HEADER), then the sections in order: ids
(id_bytes each), low bits, high bits, select samples (u32), document ids (i64).
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_slices, scratch_path, stored

MAGIC = b"TFEFIDS1"
#: id_bytes, documents, null document ids (these come last), ids, low bits a boundary, bytes of: low, high, samples.
HEADER = "<IQQQIQQQ"
#: Every so many set bits, the place of one is kept.
SELECT_EVERY = 256
#: Distinct chunks of text whose ids a worker remembers.
REMEMBERED = 500_000
#: Characters of text that are encoded together.
TOGETHER = 3_000_000
#: Marks that may end a chunk; an apostrophe can belong to a contraction.
MARKS, DIGITS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', "0123456789"


class EliasFano:
    """A non-decreasing sequence of integers from 0 to ``top``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        bits = max(0, int(top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(top >> bits) + n + 1, np.uint8)
        high[ones] = 1
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SELECT_EVERY].astype(np.uint32))

    def select(self, i: int) -> int:
        """Place of the i-th set high bit, from the sample before it."""
        at, left = int(self.samples[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at // 8
        first = np.unpackbits(self.high[byte : byte + 1], bitorder="little")[at % 8 :]
        ones = np.flatnonzero(first)
        if left < len(ones):
            return at + int(ones[left])
        left, byte = left - len(ones), byte + 1
        while True:
            part = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            ones = np.flatnonzero(part)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left, byte = left - len(ones), byte + 64

    def get(self, i: int) -> int:
        value = (self.select(i) - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= ((int(self.low[bit >> 3]) >> (bit & 7)) & 1) << k
        return value

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high + low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def pack(doc_ids: list[int | None], ids: list[bytes], id_bytes: int) -> bytes:
    """One shard file. ``ids``: each document's ids as unsigned integers of ``id_bytes`` bytes."""
    ends = np.cumsum([len(x) // id_bytes for x in ids], dtype=np.int64)
    top = int(ends[-1]) if len(ends) else 0
    code = EliasFano.encode(ends, top)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    low, high, samples = code.low.tobytes(), code.high.tobytes(), code.samples.astype("<u4").tobytes()
    head = struct.pack(HEADER, id_bytes, len(ids), len(ids) - len(known), top, code.low_bits, len(low), len(high), len(samples))
    return b"".join([MAGIC, head, *ids, low, high, samples, known.astype("<i8").tobytes()])


class Shard:
    """A shard file in memory or mapped; ``doc(i)`` reads one document through the select structure."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a shard of token ids")
        width, n, nulls, top, bits, low, high, samples = struct.unpack_from(HEADER, data, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEADER)
        part = lambda size: data[at : at + size]
        self.n, self.ids = n, np.frombuffer(part(top * width), f"<u{width}")
        at += top * width
        pieces = []
        for size, kind in ((low, "u1"), (high, "u1"), (samples, "<u4")):
            pieces.append(np.frombuffer(part(size), kind))
            at += size
        self.ends = EliasFano(n, bits, *pieces)
        self.doc_ids = [*np.frombuffer(part((n - nulls) * 8), "<i8").tolist(), *[None] * nulls]

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.ends.get(i - 1) if i else 0 : self.ends.get(i)]


class Encoder:
    """Ids of whole texts. Chunks between spaces and newlines are encoded once and remembered.

    A tokenizer that drops white space and whose pattern never matches across any gives a text the ids of its
    chunks, in order; others encode texts whole. ``tests/llm`` holds this against encoding whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.kind, self.known, self.cores = ("<u2" if size <= 1 << 16 else "<u4"), {"": b""}, {"": b""}
        self.end = np.array([end_id], self.kind).tobytes()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: What the tokenizer lets us do: cut at spaces, cut before closing marks, fold capitals.
        self.cuts = ids("one two,\nthree") == ids("one") + ids("two,") + ids("three")
        self.parts = ids("one.,") == ids("one") + ids(".,") and ids("1)!") == ids("1") + ids(")!")
        self.folds = ids("ONE Two") == ids("one two") and not any(t.isalnum() for t in added)

    def of_words(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of each chunk. Many are encoded as one text and told apart by where their ids come from."""
        width = int(self.kind[-1])
        for i in range(0, len(chunks), 500):
            part = chunks[i : i + 500]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(c) + 1 for c in part])
            cuts = np.searchsorted(np.array([s for s, _ in coded.offsets]), ends).tolist()
            data = np.array(coded.ids, self.kind).tobytes()
            yield from (data[width * s : width * e] for s, e in zip([0, *cuts], cuts, strict=False))

    def of_new(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by those of their core and tail.

        The pattern parts a letter or digit from the marks after it, and the tokenizer lower-cases; so a chunk that
        ends in a run of marks has the ids of the rest and of the run, and a capital A-Z is its small letter.
        """
        cores, split = self.cores, []
        for c in chunks:
            if c.isalnum():  # the most usual case: nothing to part, and no added token, as these hold marks
                split.append((c.lower() if self.folds and c.isascii() else c, ""))
                continue
            core, plain = c, not self.special.search(c)
            if plain and self.parts:
                core = c.rstrip(MARKS)
                # A letter whose small form has two characters may end in a mark itself.
                if not core or not (core[-1] in DIGITS or core[-1].isalpha() and len(core[-1].lower()) == 1):
                    core = c
            split.append((core.lower() if plain and self.folds and core.isascii() else core, c[len(core) :]))
        new = list(set(chain.from_iterable(split)).difference(cores))
        cores.update(zip(new, self.of_words(new), strict=True))
        out = [cores[core] + cores[tail] if tail else cores[core] for core, tail in split]
        if len(cores) > REMEMBERED:
            for c in new:
                del cores[c]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return [np.array(x.ids, self.kind).tobytes() + self.end for x in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        known = self.known
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(known))
        known.update(zip(new, self.of_new(new), strict=True))
        out = [b"".join([*map(known.__getitem__, chunks), self.end]) for chunks in split]
        if len(known) > REMEMBERED:  # words met early tend to be the frequent ones
            for c in new:
                del known[c]
        return out


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per worker process and tokenizer; functions come to a worker anew with each task."""
    held = sys.modules.setdefault("tallyframe_worker", types.ModuleType("tallyframe_worker")).__dict__
    if (path, end_id) not in held:
        held[path, end_id] = Encoder(path, end_id)
    return held[path, end_id]


def pieces(rows: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Runs of rows whose texts, the last field, have ``most`` characters together, or one row."""
    out, size = [], 0
    for r in rows:
        if out and size + len(r[-1]) > most:
            yield out
            out, size = [], 0
        out.append(r)
        size += len(r[-1])
    if out:
        yield out


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    """Whole file or none: written under another name, then renamed, so that a repeated task does no harm."""
    fs, name = store(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, name)


def write_token_files(
    spark: SparkSession,
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    shard_chars: int = 24_000_000,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encodes all rows into shard files below ``folder`` in ascending ``key`` order and returns the manifest.

    Rows go to key ranges of about ``shard_chars`` bytes of text and are sorted there by key and text (null keys
    last, null texts as empty ones); each range is one task and gives files of half as many ids at most, or of one
    document. The manifest has a row per file: part, seq, path, n_docs, n_tokens, base (ids in all files before).
    Rows that repeat are all written. An empty table gives an empty manifest. Other columns aren't read.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // shard_chars))
    order = [F.col("k").asc_nulls_last(), F.xxhash64("t"), F.col("t")]
    # A key that many rows share is cut by its texts' hashes.
    rows = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    part = F.spark_partition_id().alias("part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, end_id)
        width = int(coder.kind[-1])
        keys, ids, held, seq, part, done = [], [], 0, 0, 0, []

        def flush() -> None:
            nonlocal held, seq
            name = f"{folder}/ids-{part:06d}-{seq:04d}.efids"
            put(name, pack(keys, ids, width))
            done.append((part, seq, name, len(ids), held // width))
            keys.clear()
            ids.clear()
            held, seq = 0, seq + 1

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "k", "t")), strict=True))
            for some in pieces(rows, TOGETHER):
                for (p, k, _), coded in zip(some, coder.encode([t for *_, t in some]), strict=True):
                    if ids and held + len(coded) > shard_chars // 2 * width:
                        flush()
                    part = p
                    keys.append(k)
                    ids.append(coded)
                    held += len(coded)
        if ids:
            flush()
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_tokens"])

    files = rows.select(part, "k", "t").mapInArrow(in_slices(write, 2 * TOGETHER), "part int, seq int, path string, n_docs long, n_tokens long")
    files = stored(spark, files, "token-files")
    # One row per file: a file for every shard_chars bytes of text.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the files: ``key``, start, n_tokens and ids_crc32 (of its ids as little-endian u32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = store(row["path"])
                with fs.open_input_file(name) as f:
                    shard = Shard(f.read())
                ends = shard.ends.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                for a in range(0, shard.n, 5000):
                    b = min(shard.n, a + 5000)
                    crc = [zlib.crc32(shard.ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[a:b], pa.int64()), pa.array(starts[a:b] + row["base"]), pa.array(ends[a:b] - starts[a:b]), pa.array(crc, pa.int64())],
                        names=[key, "start", "n_tokens", "ids_crc32"],
                    )

    rows = manifest.select("path", "base")
    n = max(1, min(manifest.count(), 100_000))
    return rows.repartition(n, "path").mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long")


def op4_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to shard files and read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "token-ids")
    return read_token_files(write_token_files(spark, docs, folder, public_tokenizers.path("word_bpe_49k.json")))
