"""Helpers shared by the operators: scratch tables, two-level running sums, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import scratch_path as new_path
from ..sources.scratch import scratch_root

__all__ = ["buckets_for", "few", "in_slices", "looked_up", "packed", "recording", "remove", "running_sum", "scratch_path", "scratch_root", "stored", "words"]

#: Rows that one ranking window should hold; the number of buckets follows the row count.
BUCKET_ROWS = 1_000


#: The list that takes the paths of scratch tables made meanwhile, of each thread of work its own.
_record: ContextVar[list[str] | None] = ContextVar("record", default=None)


@contextlib.contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Adds to ``paths`` what scratch tables are made meanwhile."""
    token = _record.set(paths)
    try:
        yield
    finally:
        _record.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = new_path(spark, name)
    paths = _record.get()
    if paths is not None:
        paths.append(path)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage."""
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables that nothing reads any more and empties the list."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows in one column, doc__, beside ``more``: then no column of theirs clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc__"), *[c.alias(n) for n, c in more.items()])


def few(df: DataFrame, most: int = 400_000) -> DataFrame:
    """``df`` for a broadcast join if it has ``most`` rows at most, else as it is, for a shuffled one.

    For narrow tables that are stored: they are counted here.
    """
    return F.broadcast(df) if df.count() <= most else df


def buckets_for(rows: int) -> int:
    """So many hash ranges that neither a range nor the list of ranges outgrows a task."""
    return max(1, min(-(-rows // BUCKET_ROWS), int(max(rows, 1) ** 0.5) + 1))


def looked_up(df: DataFrame, key: str, by: str, table: DataFrame, cells: int) -> DataFrame:
    """``df`` with the columns of ``table``, which has a row a ``key`` at most, or nulls; one key may have most rows of ``df``.

    Rows of a key are dealt to ``cells`` by a hash of ``by``, and a row of the table goes to each cell that has any. ``df``
    is read twice, so it should be stored.
    """
    cell = F.pmod(F.xxhash64(by), F.lit(cells))
    dealt = df.withColumn("cell__", cell)
    there = dealt.select(key, "cell__").where(F.col(key).isNotNull()).distinct().join(table, key)
    return dealt.join(there, [key, "cell__"], "left").drop("cell__")


def running_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], weight: Column, out: str) -> DataFrame:
    """``out``: the sum of ``weight`` over the rows before this one within ``group``.

    Rows are ordered by ``bucket`` and then by ``order``. The window of one bucket and the window over
    the sums of the buckets are both small, also where one group holds most of the rows.
    """
    before = Window.partitionBy(*group).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, "bucket__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"bucket__": F.col(bucket), "weight__": weight.cast("long")})
    sums = df.groupBy(*group, "bucket__").agg(F.sum("weight__").alias("sum__"))
    sums = sums.withColumn("base__", F.coalesce(F.sum("sum__").over(before), F.lit(0)))
    keys = [*group, "bucket__"]
    sums = sums.select(*[F.col(c).alias(f"{i}__key") for i, c in enumerate(keys)], "base__")
    ranked = df.withColumn("own__", F.coalesce(F.sum("weight__").over(within), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"{i}__key")) for i, c in enumerate(keys)]
    total = (F.col("own__") + F.col("base__")).cast("long").alias(out)
    return ranked.join(sums, on).select(*[c for c in df.columns if c not in ("bucket__", "weight__")], total)


def tidy() -> None:
    """Gives freed memory back; workers live on and would hold their peaks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_slices(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int = 2_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over slices of about ``size`` bytes of the batches that a task gets, so that few texts become objects at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * size // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(cut(batches))
        finally:
            tidy()

    return sliced


#: Lower-cases A-Z and turns every byte that can't be in a word ([0-9a-z] or 0x80 and above) into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words of a whole text: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []
