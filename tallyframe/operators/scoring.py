"""Document scores, hard gates and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FAIL_AT, PASS_AT, SCORE_WEIGHTS, WARN_AT

PARTS = ("amount", "direction", "date", "balance")


def score_documents(rows: DataFrame, doc: str = "doc_id", opening: str = "opening", closing: str = "closing") -> DataFrame:
    """Score, gates, warnings and status of each document from its transactions.

    ``rows`` has direction, amount, balance_confirmed and a confidence_* column per part; missing confidences
    count as 0. Sums are of decimals, so they don't depend on the order of rows.
    """
    dec = lambda c: F.coalesce(F.col(f"confidence_{c}"), F.lit(0.0)).cast("decimal(10,6)")
    size = F.abs("amount")
    out = rows.groupBy(doc).agg(
        F.count("*").alias("n_rows"),
        *[F.sum(dec(p)).alias(f"sum_{p}") for p in PARTS],
        F.count_if(F.col("balance_confirmed")).alias("n_confirmed"),
        F.count_if(F.col("direction") == "UNKNOWN").alias("n_unknown"),
        F.sum(F.when(F.col("direction") == "DEBIT", size)).alias("debits"),
        F.sum(F.when(F.col("direction") == "CREDIT", size)).alias("credits"),
        F.max(opening).alias("opening"),
        F.max(closing).alias("closing"),
    )
    out = out.withColumn("sum_recon", F.col("n_confirmed").cast("decimal(20,6)"))
    # A weighted sum of exact decimals over the row count, so that rounding meets true halves.
    total = sum((F.col(f"sum_{p}") * F.lit(f"{w:.2f}").cast("decimal(3,2)") for p, w in SCORE_WEIGHTS[1:]), F.col(f"sum_{SCORE_WEIGHTS[0][0]}") * F.lit(f"{SCORE_WEIGHTS[0][1]:.2f}").cast("decimal(3,2)"))
    score = total / F.col("n_rows").cast("decimal(12,0)")
    out = out.withColumns({f"mean_{p}": F.col(f"sum_{p}").cast("double") / F.col("n_rows") for p, _ in SCORE_WEIGHTS})
    zero = F.lit(0).cast("decimal(25,2)")
    gap = F.abs(F.col("opening") + F.coalesce("credits", zero) - F.coalesce("debits", zero) - F.col("closing")).cast("decimal(25,2)")
    out = out.withColumns({"score": F.round(score, 4).cast("double"), "balance_gap": gap})
    return out.drop(*[f"sum_{p}" for p, _ in SCORE_WEIGHTS]).transform(decide)


def gates() -> Column:
    """Names of the gates that a scored document trips."""
    return F.array_compact(
        F.array(
            F.when(F.col("n_unknown") == F.col("n_rows"), "HARD_GATE_ALL_DIRECTIONS_UNKNOWN"),
            F.when((F.col("mean_recon") < 0.5) & (F.col("n_rows") > 5), "HARD_GATE_LOW_RECONCILIATION"),
            F.when(F.col("mean_amount") < 0.5, "HARD_GATE_LOW_AMOUNT_CONFIDENCE"),
            F.when(F.col("balance_gap") > 5, F.concat(F.lit("HARD_GATE_BALANCE_MISMATCH_"), F.col("balance_gap").cast("string"))),
        )
    )


def warnings() -> Column:
    return F.array_compact(
        F.array(
            F.when((F.col("n_unknown") > 0) & (F.col("n_unknown") < F.col("n_rows")), F.concat(F.lit("WARN_"), F.col("n_unknown").cast("string"), F.lit("_UNKNOWN_DIRECTIONS"))),
            F.when(F.col("mean_date") < 0.7, "WARN_LOW_DATE_CONFIDENCE"),
            F.when((F.col("mean_recon") >= 0.5) & (F.col("mean_recon") < 0.8), "WARN_MODERATE_RECONCILIATION"),
        )
    )


def decide(scored: DataFrame) -> DataFrame:
    """``scored`` with gates, warnings and status; a balance mismatch sends a gated document to review."""
    scored = scored.withColumns({"gates": gates(), "warnings": warnings()})
    mismatch = F.exists("gates", lambda g: g.contains("BALANCE_MISMATCH"))
    s = F.col("score")
    status = (
        F.when(F.size("gates") > 0, F.when(mismatch, "NEEDS_REVIEW").otherwise("FAIL"))
        .when((s >= PASS_AT) & (F.size("warnings") == 0), "PASS")
        .when(s >= WARN_AT, "PASS_WITH_WARNINGS")
        .when(s >= FAIL_AT, "NEEDS_REVIEW")
        .otherwise("FAIL")
    )
    return scored.withColumn("status", status)


def stored_status(score: Column) -> Column:
    """Struct (validation_status, document_status) from a rounded score alone."""
    return F.struct(
        F.when(score >= PASS_AT, "PASS").when(score >= WARN_AT, "PASS_WITH_WARNINGS").when(score >= FAIL_AT, "NEEDS_REVIEW").otherwise("FAIL").alias("validation_status"),
        F.when(score >= WARN_AT, "COMPLETED").otherwise("NEEDS_REVIEW").alias("document_status"),
    )


def enhancement_profile(confidence: Column) -> Column:
    """The image profile a page's confidence calls for."""
    return F.when(confidence >= 0.85, "A").when(confidence >= 0.70, "B").when(confidence >= 0.50, "C").otherwise("D")
