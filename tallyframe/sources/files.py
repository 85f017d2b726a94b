"""Uploads, artifacts and token sources."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Limits of an upload.
MAX_BYTES, PDF = 50 * 1024 * 1024, b"%PDF"


def uploads(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted files (doc_hash, path, size, content) and rejected ones with the first reason, in this order:
    not a PDF, too large, empty. Equal contents are accepted once. Spark's file reader passes over files without any
    byte, so those are in neither result where they are read from a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    kind = F.substring(F.col("content"), 1, 4)
    reason = (
        F.when((F.col("length") > 0) & (kind != F.lit(PDF)), "UNSUPPORTED_MEDIA_TYPE")
        .when(F.col("length") > max_bytes, "TOO_LARGE")
        .when(F.col("length") == 0, "EMPTY")
    )
    files = files.select(F.sha2("content", 256).alias("doc_hash"), "path", F.col("length").alias("size"), "content", reason.alias("reason"))
    return files.where("reason IS NULL").drop("reason").dropDuplicates(["doc_hash"]), files.where("reason IS NOT NULL").drop("content")


def artifact_path(kind: str, doc: Column, run: Column | None = None, page: Column | None = None) -> Column:
    """Where an artifact of a document lies: raw, rendered, normalized, extractions, document or canonical."""
    if kind not in ("raw", "rendered", "normalized", "extractions", "document", "canonical"):
        raise ValueError(kind)
    parts = [doc, F.lit(kind)] + ([run] if run is not None else []) + ([F.format_string("page_%04d", page)] if page is not None else [])
    return F.concat_ws("/", *parts)


def write_partitioned(rows: DataFrame, path: str, keys: Sequence[str] = ("doc_id", "run_id"), kind: str = "parquet") -> None:
    """Rows by key, replacing only the keys that they have: running a document again leaves one result of it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(kind).save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One export as CSV with a header; as many files as partitions."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


TOKENS = "doc_id string, page_index int, token int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"
WORD = re.compile(r"\S+")


class TokenSource(DataSource):
    """Tokens of fixed-width text files, one per page: a stand-in for any reader of positioned text.

    Options: path, the files' comma-separated paths; width and height, characters and lines of a page.
    """

    @classmethod
    def name(cls) -> str:
        return "page_tokens"

    def schema(self) -> str:
        return TOKENS

    def reader(self, schema: StructType) -> DataSourceReader:
        return TokenReader(self.options)


class Page(InputPartition):
    def __init__(self, index: int, path: str):
        self.index, self.path = index, path


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.width, self.height = int(options.get("width", 100)), int(options.get("height", 60))

    def partitions(self) -> list[InputPartition]:
        return [Page(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, name = pafs.FileSystem.from_uri(partition.path if "://" in partition.path else f"file://{partition.path}")
        with fs.open_input_file(name) as f:
            text = f.read().decode("utf-8", "replace")
        n = 0
        for row, line in enumerate(text.splitlines()):
            for m in WORD.finditer(line):
                box = (m.start() / self.width, row / self.height, m.end() / self.width, (row + 1) / self.height)
                yield (name.rpartition("/")[2].partition(".")[0], partition.index, n, m[0], *(round(min(1.0, x), 6) for x in box), 0.95)
                n += 1


def ocr_tokens(words: DataFrame, least: float = 10) -> DataFrame:
    """Recognised words that aren't blank, from a confidence of ``least`` in a hundred; confidence from 0 to 1."""
    return words.where((F.trim("text") != "") & (F.col("conf") >= least)).withColumn("confidence", F.col("conf") / 100).drop("conf")


def normalised_boxes(words: DataFrame, width: Column, height: Column, from_bottom: bool = False) -> DataFrame:
    """Boxes in shares of the page from its top left, to six places."""
    y0, y1 = (height - F.col("y1"), height - F.col("y0")) if from_bottom else (F.col("y0"), F.col("y1"))
    return words.withColumns({"x0": F.round(F.col("x0") / width, 6), "x1": F.round(F.col("x1") / width, 6), "y0": F.round(y0 / height, 6), "y1": F.round(y1 / height, 6)})
