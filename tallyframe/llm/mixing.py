"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule takes the golden-ratio point frac(i * phi) through the cumulative target weights,
which spreads every source evenly over any stretch of the mix. The slots of a source are ranked; rank r
takes block r of the source's shuffled stream of words, which repeats from its start when it is used up.
All blocks have the same number of words, so the slots decide how much of a source the mix takes, and which
of its documents. Blocks stop at a source's target.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, running_sum, stored

#: White space of words; the fractional part of the golden ratio in units of 1 / POINTS, made odd.
WORD = r"[^\x20\x09-\x0D]+"
POINTS = 1 << 62
GOLDEN = 2850178375720181497
#: Words of a block, at most; smaller mixes have 2^SLOT_BITS slots or one for each word.
BLOCK_WORDS, SLOT_BITS = 1024, 18
#: A source that the schedule gives fewer slots than these gets what is missing to its target in one slot at the end.
LEAST_SLOTS = 512
#: Slots whose ranks one window counts.
CHUNK = 1 << 14
#: Words of a cell in which slots and documents meet, at least.
CELL = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def filled(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` x its size and the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0 and sizes[i] > 0], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def block_size(total: float) -> int:
    return max(1, min(BLOCK_WORDS, int(total) >> SLOT_BITS))


def schedule(spark: SparkSession, targets: Sequence[float], block_words: int) -> DataFrame:
    """Slots (slot, source_no, slot_rank) of the mix, ranked per source without a window over a whole source.

    There is a slot for every ``block_words`` of the sum of the targets. Points are integers, exact at any number of
    slots. Each is looked up in a table of equal cells of [0, 1), about four for each source.
    """
    total = sum(targets)
    n = int(-(-total // block_words)) if total else 0
    bounds, at = [], 0.0
    for t in targets:
        at += t
        bounds.append(int(at / total * POINTS) if total else 0)
    last = max((i for i, t in enumerate(targets) if t > 0), default=0)
    bounds[last:] = [POINTS] * (len(bounds) - last)
    width = POINTS // max(1, 4 * len(targets))
    cells = []
    for c in range(-(-POINTS // width) if n else 0):
        first, end = bisect_right(bounds, c * width), bisect_right(bounds, (c + 1) * width - 1)
        cells.append((c, [(bounds[i], i) for i in range(first, min(end, last) + 1)]))
    lookup = spark.createDataFrame(cells, "cell__ long, parts array<struct<bound:long,no:int>>")
    point = F.pmod(F.col("slot").cast("decimal(18,0)") * F.lit(Decimal(GOLDEN)), F.lit(Decimal(POINTS))).cast("long")
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point)
    slots = slots.withColumn("cell__", F.expr(f"point div {width}L")).join(F.broadcast(lookup), "cell__")  # five numbers a source
    source = F.element_at(F.filter("parts", lambda x: F.col("point") < x["bound"]), 1)["no"]
    slots = slots.select("slot", source.alias("source_no"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    return running_sum(slots, ["source_no"], "chunk", [F.col("slot")], F.lit(1), "slot_rank").select("slot", "source_no", "slot_rank")


def blocks(spark: SparkSession, plan: DataFrame, targets: Sequence[float], block_words: int) -> DataFrame:
    """The word ranges [from__, to__) of each source's stream that its slots take: slot, source_no, slot_rank, turn.

    ``plan`` has source_no, source_size and whole, the target in whole words. A block is cut where the stream
    restarts. Block r of a source begins at word r * ``block_words`` of its repeated stream.
    """
    slots = schedule(spark, targets, block_words)
    given = slots.groupBy("source_no").agg(F.count("*").alias("given"))
    few = plan.join(given, "source_no", "left").select("source_no", "whole", F.coalesce("given", F.lit(0)).alias("slot_rank"))
    few = few.where((F.col("slot_rank") < LEAST_SLOTS) & (F.col("slot_rank") * block_words < F.col("whole")))
    closing = few.select((F.col("source_no") + int(-(-sum(targets) // block_words))).cast("long").alias("slot"), "source_no", F.col("slot_rank").cast("long"), F.col("whole").alias("end"))
    slots = slots.withColumn("end", (F.col("slot_rank") + 1) * block_words).unionByName(closing)
    rows = slots.join(F.broadcast(plan.select("source_no", "source_size", "whole")), "source_no")  # a row for each source
    rows = rows.withColumns({"a": F.col("slot_rank") * block_words, "b": F.least("end", "whole")}).where("b > a")
    rows = rows.withColumn("turn", F.explode(F.expr("sequence(a div source_size, (b - 1) div source_size)")))
    return rows.select(
        "slot",
        "source_no",
        "slot_rank",
        "turn",
        F.greatest(F.col("a") - F.col("turn") * F.col("source_size"), F.lit(0)).alias("from__"),
        F.least(F.col("b") - F.col("turn") * F.col("source_size"), F.col("source_size")).alias("to__"),
    )


def placed(
    spark: SparkSession, docs: DataFrame, weights: Sequence[float], budget_share: float, most_repeats: float, seed: int, source: str, text: str, keep: Sequence[str]
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Rows (kept__i, source__, size, source_no, source_size, target, start__) in their source's shuffled stream, the plan, and the targets."""
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"kept__{i}") for i, c in enumerate(keep)],
        F.col(f"`{source}`").alias("source__"),
        word_count(F.col(f"`{text}`")).alias("size"),
    )
    rows = stored(spark, rows.withColumn("place__", F.shiftrightunsigned(F.xxhash64(*[F.col(f"kept__{i}") for i in range(len(keep))], "size", F.lit(seed)), 12)), "mix")
    totals = rows.groupBy("source__").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    # Python orders str by code points.
    totals.sort(key=lambda r: (r["source__"] is None, r["source__"] or ""))
    sizes = [r["s"] for r in totals]
    targets = filled(sizes, [weights[i % len(weights)] for i in range(len(sizes))], budget_share * sum(sizes), most_repeats)
    plan = spark.createDataFrame(
        [(i, r["source__"], int(r["s"]), float(t), int(t)) for i, (r, t) in enumerate(zip(totals, targets, strict=True))],
        "source_no int, name__ string, source_size long, target double, whole long",
    )
    n = buckets_for(sum(r["n"] for r in totals))
    rows = rows.join(F.broadcast(plan), F.col("source__").eqNullSafe(F.col("name__"))).drop("name__")
    rows = rows.withColumn("range__", F.floor(F.col("place__") * F.lit(n / (1 << 52))))
    order = [F.col("place__"), *[F.col(f"kept__{i}") for i in range(len(keep))], F.col("size")]
    return stored(spark, running_sum(rows, ["source_no"], "range__", order, F.col("size"), "start__"), "mix-placed"), plan, targets


def takings(spark: SparkSession, rows: DataFrame, plan: DataFrame, targets: Sequence[float], block_words: int) -> DataFrame:
    """What each slot takes of which row: slot, source_no, slot_rank, turn, start__ (which tells the rows of a source apart), first, last (words of the row, last excluded)."""
    # Both sides are cut at multiples of a cell, so that overlaps become an equality.
    cell = max(block_words, CELL)
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))).alias("cell__")
    used = blocks(spark, plan, targets, block_words)
    used = used.select("*", cells(F.col("from__"), F.col("to__")))
    end = F.col("start__") + F.col("size")
    worded = rows.where("size > 0").select("source_no", "start__", end.alias("end__"), cells(F.col("start__"), end))
    low, high = F.col("cell__") * cell, (F.col("cell__") + 1) * cell
    a, b = F.greatest("from__", "start__", low), F.least("to__", "end__", high)
    met = worded.join(used, ["source_no", "cell__"]).select("slot", "source_no", "slot_rank", "turn", "start__", (a - F.col("start__")).alias("first"), (b - F.col("start__")).alias("last"))
    return met.where("first < last")


def mixed_blocks(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    budget_share: float = 1.0,
    most_repeats: float = 3.0,
    block_words: int | None = None,
    seed: int = 17,
    source: str = "source",
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The mix itself: slot, slot_rank, turn, ``keep``, source, first and last (words of the row, from 0, last excluded).

    In the order of slot, turn and first it is the sequence of words to train on. Parameters and handling as in ``mix``;
    a piece that crosses cells comes in several rows.
    """
    rows, plan, targets = placed(spark, docs, weights, budget_share, most_repeats, seed, source, text, keep)
    got = takings(spark, rows, plan, targets, block_words or block_size(sum(targets)))
    got = got.select("slot", "slot_rank", "turn", F.col("source_no").alias("no__"), F.col("start__").alias("at__"), "first", "last")
    out = got.join(rows.where("size > 0"), (F.col("source_no") == F.col("no__")) & (F.col("start__") == F.col("at__")))
    return out.select("slot", "slot_rank", "turn", *[F.col(f"kept__{i}").alias(c) for i, c in enumerate(keep)], F.col("source__").alias(source), "first", "last")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    budget_share: float = 1.0,
    most_repeats: float = 3.0,
    block_words: int | None = None,
    seed: int = 17,
    source: str = "source",
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """How many words of each row the mix takes.

    Sources in code point order, null last, get ``weights``, repeating; together they take
    ``budget_share`` of all words, each at most ``most_repeats`` times its own. Returns ``keep``, source,
    size, source_size, target, taken, first_slot (null if nothing is taken) and n_slots. A source takes what its slots
    hold, blocks of ``block_words`` (by default ``block_size``) up to its target: a few blocks less at most. No row gives
    more than ``most_repeats`` times its size. The shuffle hashes ``keep`` and ``seed``, so that
    reruns agree; rows that agree in all of these and in size are interchangeable.

    Null and blank texts have size 0 and give nothing; an empty table gives no rows; columns not named here
    aren't read; texts of any length are counted whole and cut at block ends. The driver sees one row per source,
    never rows of documents.
    """
    rows, plan, targets = placed(spark, docs, weights, budget_share, most_repeats, seed, source, text, keep)
    got = takings(spark, rows, plan, targets, block_words or block_size(sum(targets)))
    # Rows with words differ in where they start, so source and start identify them.
    got = got.groupBy("source_no", "start__").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    got = got.select(F.col("source_no").alias("no__"), F.col("start__").alias("at__"), "taken", "first_slot", "n_slots")
    out = rows.join(got, (F.col("source_no") == F.col("no__")) & (F.col("start__") == F.col("at__")) & (F.col("size") > 0), "left")
    return out.select(
        *[F.col(f"kept__{i}").alias(c) for i, c in enumerate(keep)],
        F.col("source__").alias(source),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_slot",
        F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
    )


def op1_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights 5, 2, 1."""
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
