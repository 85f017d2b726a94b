"""Review queue, costs and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edges of the histograms.
DOCUMENT_SECONDS = (1, 5, 10, 30, 60, 120, 300, 600)
STAGE_SECONDS = (0.1, 0.5, 1, 5, 10, 30, 60)
CALL_SECONDS = (0.1, 0.5, 1, 2, 5, 10, 30)
STATUSES = ("PENDING", "IN_REVIEW", "RESOLVED", "SKIPPED")


def queue_stats(reviews: DataFrame) -> DataFrame:
    """Counts of each status and of all, in one row."""
    return reviews.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES], F.count("*").alias("total"))


def pending(reviews: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Pending reviews by priority, then age."""
    return reviews.where(F.col("status") == "PENDING").orderBy("priority", "created_at", "review_id").offset(offset).limit(limit)


def cost_summary(costs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return costs.groupBy(*keys).agg(F.sum("cost_usd").cast("decimal(20,6)").alias("cost_usd"), F.sum("pages").alias("pages"), F.count("*").alias("calls"))


def cumulative_buckets(rows: DataFrame, labels: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Observations at each edge or below, with +Inf, and the count, per label."""
    counts = rows.groupBy(*labels).agg(*[F.count_if(F.col(value) <= e).alias(f"le_{i}") for i, e in enumerate(edges)], F.count(value).alias("le_inf"))
    cells = [F.struct(F.lit(float(e)).alias("edge"), F.col(f"le_{i}").alias("n")) for i, e in enumerate(edges)]
    cells.append(F.struct(F.lit(float("inf")).alias("edge"), F.col("le_inf").alias("n")))
    return counts.select(*labels, F.inline(F.array(*cells)))
