"""Stages from raw documents to shards; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontam, mixing, omh, quality, sharding
from tallyframe.llm.common import few, packed, recording, remove, scratch_root, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Each stage returns the columns of its documents, whatever their names, and passes whole rows through one column, so that
# theirs can't clash with an operator's. Scratch tables in the shared folder stay until ``run`` removes them.


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart also where a doc_id is null or repeats with another text: 128 bits of both, as hex digits."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.md5(F.concat(mark(F.col(key)), F.lit("\x00"), mark(F.col(text))).cast("binary"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts get no votes and are judged by the prior, like other texts too short to vote on. Repeated rows
    are judged alike and all stay or go, so ties change nothing; very long texts are read whole; an empty table gives
    no rows.
    """
    rows = packed(docs, row__=row_key(), text__=F.col("text"))
    return quality.score_quality(spark, rows, key="row__", text="text__", columns=["doc__"]).where("keep").select("doc__.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least doc_id.

    Null texts are no one's duplicates and all stay; empty texts equal each other. Of rows that agree in doc_id and text
    one stays. A doc_id that several texts of a class share is a tie: the least md5 stays. Very long texts are
    compared whole; an empty table gives no rows.
    """
    return omh.deduplicate(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null, empty and wordless texts hold none and stay. Repeated rows stay or go together, so ties change nothing; very
    long texts are searched whole; an empty table gives no rows.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_contamination(spark, docs.select(row_key().alias("row"), "text"), items, key="row")
    gone = stored(spark, found.where("contaminated").select("row").distinct(), "contaminated")
    return packed(docs, row__=row_key()).join(few(gone), F.col("row__") == F.col("row"), "left_anti").select("doc__.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix's slots take its words: left out, once or up to three times.

    A document that a slot cuts stays if half of its words or more were taken, in each of its turns. Null, empty and blank
    texts have no words for the mix to take or leave and pass once. Of rows that agree in doc_id and text, each comes
    as often as the one that was taken most. A null source is a source. Very long texts count whole; an empty table
    gives no rows.
    """
    taken = mixing.mix(spark, docs.select(row_key().alias("row"), "source", "text"), keep=("row",))
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int"))
    times = taken.groupBy("row").agg(F.max(times).alias("times"))
    times = stored(spark, times.where("times > 0"), "mix-times")
    out = packed(docs, row__=row_key()).join(few(times), F.col("row__") == F.col("row"))
    return out.select("doc__", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("doc__.*")


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, text_crc32, law, shard and grown_shard.

    These columns replace any of the same names. Null doc_ids share a shard, and so do rows of equal doc_id, so ties
    change nothing; null texts count as empty; very long texts are hashed whole; an empty table gives no rows.
    """
    return sharding.with_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", place_in_shards),
]

#: The classifier and the near-duplicate stage can't be put in SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Once a stage's result is written, its scratch tables and its input go; the last result stays in the shared folder.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{scratch_root(spark)}/tallyframe-stages/{uuid.uuid4().hex}"
    for k, (_, f) in enumerate(STAGES):
        left: list[str] = [f"{out}/{k - 1}"] if k else []
        with recording(left):
            f(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        remove(spark, left)
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
