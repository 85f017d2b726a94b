"""Sharding by weighted rendezvous hashing.

Each record scores every shard with a hash of its stable key and the shard's number; the best score
wins. A shard's score doesn't depend on the other shards, so adding one moves rows only into it, and
removing one moves only its rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, running_sum, stored

#: Hashes are cut to 52 bits, which doubles hold exactly.
HASH_RANGE = 1 << 52


def hash52(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 12)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, …) of a key; null keys share one shard. Equal scores go to the lower shard.

    A shard's score is -ln(u) / weight with u uniform in (0, 1); the least wins, which picks each shard
    with probability weight / sum of weights.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct(
            (-F.ln((hash52(text, F.lit(i)) + 0.5) / float(HASH_RANGE)) / F.lit(float(w))).alias("score"),
            F.lit(i).alias("shard"),
        )
        for i, w in enumerate(weights)
        if w > 0
    ]
    if not scores:
        raise ValueError("one weight at least must be above zero")
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def with_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard and grown_shard (see ``assign_shards``); no row moves.

    These columns replace any of the same names.
    """
    weights = list(weights)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "size": (F.octet_length(body) + 1).cast("long"),
            "text_crc32": F.crc32(body.cast("binary")),
            "law": F.lit("key"),
            "shard": rendezvous(F.col(key), weights),
            "grown_shard": rendezvous(F.col(key), [*weights, sum(weights) / len(weights)]),
        }
    )


def assign_shards(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row.

    Returns ``key``, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 (unsigned, of the text's
    UTF-8; null: of no bytes), law ('key'), shard, slot (gapless from 0 in each shard) and grown_shard (the shard
    if one more shard of the mean weight is added).

    The key alone decides the shard: repeated rows and equal keys (null included) share one. Slots follow
    a hash of key, checksum and size; rows that agree in all three take any order among themselves. An
    empty table gives no rows. Other columns of ``docs`` aren't read, whatever their names.
    """
    rows = with_shards(docs.select(F.col(key).alias("key__"), F.col(text).alias("text__")), weights, "key__", "text__").drop("text__")
    rows = rows.withColumn("place__", hash52(F.col("key__"), F.col("text_crc32"), F.col("size")))
    rows = stored(spark, rows, "shards")
    n = buckets_for(rows.count())
    rows = rows.withColumn("range__", F.floor(F.col("place__") * F.lit(n / HASH_RANGE)))
    rows = running_sum(rows, ["shard"], "range__", [F.col("place__"), F.col("key__")], F.lit(1), "slot")
    return rows.select(F.col("key__").alias(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over eight equal shards."""
    return assign_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

