"""Queries on layout, columns, rows and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..operators import columns, layout, scoring, solver
from ..sources import derived
from .inputs_sql import LEDGER_RAW, LINES, TOKENS
from .solver_queries import _CASE3 as CASE3


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cluster_lines(derived.tokens(spark, sf_dir))


def fixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that the derived tokens were set in, for every page."""
    pages = derived.tokens(spark, sf_dir).select("doc_id").distinct()
    edges = F.array(*[F.struct(F.lit(i).alias("column_index"), F.lit(a).alias("x_start"), F.lit(b).alias("x_end")) for i, (a, b) in enumerate(derived.COLUMN_EDGES)])
    return pages.select("doc_id", F.inline(edges))


def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page with their texts."""
    return layout.build_boxes(lined(spark, sf_dir), ["doc_id", "line_index"])


def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_histogram(derived.tokens(spark, sf_dir))


def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.detect_columns(lined(spark, sf_dir))


def assign_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.assign_columns(derived.tokens(spark, sf_dir), fixed_columns(spark, sf_dir))
    return rows.select("doc_id", "token", "column_index")


def build_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each page: tokens of one row of tokens and one column."""
    rows = layout.assign_columns(derived.tokens(spark, sf_dir), fixed_columns(spark, sf_dir))
    rows = rows.withColumn("row_index", F.floor(F.col("token") / 4).cast("int"))
    return layout.build_boxes(rows, ["doc_id", "row_index", "column_index"]).drop("confidence")


def reconstruct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.reconstruct_rows(derived.lines(spark, sf_dir))
    return rows.groupBy("doc_id", "row_index", "is_marker").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("raw_text"))


def first_cell_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first token of each return flag of an order's part column."""
    rows = derived.tokens(spark, sf_dir).withColumn("column_index", F.floor(F.col("x0") / 0.21).cast("int"))
    return layout.first_cells(rows, ["doc_id", "column_index"], ["token"]).select("doc_id", "column_index", "token", "text")


def opening_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last amount on marker lines of each document."""
    rows = derived.lines(spark, sf_dir).where("kind = 'M'")
    return rows.groupBy("doc_id").agg(F.min_by("amount", "line").alias("opening"), F.max_by("amount", "line").alias("closing"), F.count("*").alias("n_markers"))


def date_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.ledger(spark, sf_dir).withColumn("shown", F.when(F.col("tx_key") % 3 == 0, F.col("tx_date")))
    rows = layout.forward_filled(rows, ["account"], ["seq"], "shown", F.col("shown").isNull(), "filled")
    return rows.select("account", "tx_key", "filled")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values (doc_id, column_index, n, value) of four columns of each account."""
    rows = derived.ledger_raw(spark, sf_dir)
    k = F.col("tx_key")
    cells = F.array(
        F.col("date_raw"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.regexp_replace("description", "[0-9]+", "shop")),
        F.when(k % 2 == 0, F.col("amount").cast("string")).otherwise(F.lit("")),
        F.col("balance").cast("string"),
    )
    return rows.select(F.col("account").alias("doc_id"), F.col("seq").alias("n"), F.posexplode(cells).alias("column_index", "value"))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_stats(values(spark, sf_dir), ["doc_id", "column_index"], ["n"])


def sign_change_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.ledger(spark, sf_dir).withColumn("value", F.concat(F.lit("£"), F.format_number("balance", 2)))
    return columns.sign_change_score(rows, ["account"], ["seq"], "value")


def assign_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the columns of each account; every other account has headers."""
    stats = columns.column_stats(values(spark, sf_dir), ["doc_id", "column_index"], ["n"])
    header = derived.cased(F.col("column_index"), 4, F.lit("Date"), F.lit("Details"), F.lit("Money out"), F.lit(""))
    stats = stats.withColumn("header_role", F.when(F.col("doc_id") % 2 == 0, rules.header_role(header)))
    edges = F.array(*[F.struct(F.lit(a).alias("x_start"), F.lit(b).alias("x_end")) for a, b in derived.COLUMN_EDGES])
    stats = stats.withColumns({"x_start": edges[F.col("column_index")]["x_start"], "x_end": edges[F.col("column_index")]["x_end"]})
    return columns.assign_roles(stats)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = solver.infer_by_balance(derived.ledger_raw(spark, sf_dir), ["account"], ["seq"])
    last = Window.partitionBy("account").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.col("tx_key")
    rows = rows.withColumns(
        {
            "closing": F.last("balance").over(last),
            "confidence_direction": F.col("confidence"),
            "confidence_amount": F.when(k % 12 == 0, F.lit(None)).otherwise(0.95),
            "confidence_date": F.when(F.col("account") % 5 == 0, 0.6).otherwise(0.95),
            "confidence_balance": F.when(F.col("balance_confirmed"), 0.95).otherwise(0.5),
        }
    )
    return scoring.score_documents(rows, doc="account")


def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rows.select("account", "n_rows", "n_confirmed", "n_unknown", F.round("mean_amount", 6).alias("mean_amount"), F.round("mean_direction", 6).alias("mean_direction"), F.round("mean_recon", 6).alias("mean_recon"), "score", "debits", "credits")


def score_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("account", F.array_join("gates", "|").alias("gates"), F.array_join("warnings", "|").alias("warnings"), "balance_gap")


def score_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("s", scoring.stored_status(F.col("score")))
    return rows.select("account", "status", "s.*", scoring.enhancement_profile(F.col("score")).alias("profile"))


def text_layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's words make a text layer."""
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("n", "text"))
    return layout.has_text_layer(docs, ["doc_id"], "n")


def median_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction angle per user: the median of near-horizontal angles, if it is neither slight nor wild."""
    angles = derived.table(spark, sf_dir, "events").select("user_id", (F.col("value") / 10).alias("angle")).where(F.abs("angle") < 20)
    rows = angles.groupBy("user_id").agg(F.median("angle").alias("m"), F.count("*").alias("n_lines")).where("n_lines >= 3")
    return rows.select("user_id", "n_lines", F.round("m", 6).alias("skew"), ((F.abs("m") > 0.5) & (F.abs("m") < 15)).alias("corrected"))


def first_n_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of the first fifty tokens with any, per order."""
    rows = derived.tokens(spark, sf_dir).where("confidence > 0")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("token")))
    return ranked.where("r <= 50").groupBy("doc_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


_COLUMNS = "cols AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(derived.COLUMN_EDGES)) + ") v(column_index, x_start, x_end))"
_ASSIGNED = f"""{TOKENS}, {_COLUMNS}, near AS (
  SELECT t.*, column_index, (x0 + x1) / 2 BETWEEN x_start AND x_end AS holds,
    row_number() OVER (PARTITION BY doc_id, token ORDER BY NOT ((x0 + x1) / 2 BETWEEN x_start AND x_end),
      CASE WHEN (x0 + x1) / 2 BETWEEN x_start AND x_end THEN 0 ELSE abs((x_start + x_end) / 2 - (x0 + x1) / 2) END, column_index) AS r
  FROM tokens t, cols
), assigned AS (SELECT * FROM near WHERE r = 1)"""

_VALUES = f"""{LEDGER_RAW}, vals AS (
  SELECT account AS doc_id, seq AS n, 0 AS column_index, date_raw AS value FROM ledger_raw
  UNION ALL SELECT account, seq, 1, CASE WHEN tx_key % 4 = 0 THEN '' ELSE regexp_replace(description, '[0-9]+', 'shop', 'g') END FROM ledger_raw
  UNION ALL SELECT account, seq, 2, CASE WHEN tx_key % 2 = 0 THEN amount::VARCHAR ELSE '' END FROM ledger_raw
  UNION ALL SELECT account, seq, 3, balance::VARCHAR FROM ledger_raw
)"""


def _turns(source: str, keys: str, order: str) -> str:
    return rf"""nums AS (SELECT {keys}, {order}, try_cast(regexp_replace(value, '[£$€,\s]', '', 'g') AS DOUBLE) AS v FROM {source}
  WHERE regexp_full_match(regexp_replace(value, '[£$€,\s]', '', 'g'), '[+-]?(\d+\.?\d*|\.\d+)')
), diffs AS (SELECT {keys}, {order}, v - lag(v) OVER (PARTITION BY {keys} ORDER BY {order}) AS d FROM nums
), turning AS (SELECT {keys}, d, d * lag(d) OVER (PARTITION BY {keys} ORDER BY {order}) < 0 AS turn FROM diffs
), turns AS (SELECT {keys}, round(CASE WHEN count(d) >= 3 THEN 1 - count(*) FILTER (WHERE turn) / count(d)::DOUBLE ELSE 0 END, 6) AS monotonic_score FROM turning GROUP BY ALL)"""


def _like() -> tuple[str, str]:
    from .parser_queries import _DATE_LIKE, _NUMERAL, _SUFFIX

    amount = rf"regexp_full_match(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(value, '£|GBP|,', '', 'g')), {_SUFFIX}, '')), '^\(|\)$', '', 'g'), '^[-−]', ''), '-$', '')), {_NUMERAL})"
    return f"regexp_matches(value, '{_DATE_LIKE}')", amount


_DATE, _AMOUNT = _like()

_SCORED = f"""{CASE3.rstrip()}, last AS (
  SELECT account, arg_max(balance, seq) AS closing FROM ledger_raw GROUP BY 1
), s AS (
  SELECT account, count(*) AS n_rows, count(*) FILTER (WHERE balance_confirmed) AS n_confirmed, count(*) FILTER (WHERE direction = 'UNKNOWN') AS n_unknown,
    avg(CASE WHEN tx_key % 12 = 0 THEN 0 ELSE 0.95::DOUBLE END) AS mean_amount, avg(confidence) AS mean_direction,
    CASE WHEN account % 5 = 0 THEN 0.6 ELSE 0.95 END AS mean_date, avg(CASE WHEN balance_confirmed THEN 0.95::DOUBLE ELSE 0.5 END) AS mean_balance,
    count(*) FILTER (WHERE balance_confirmed) / count(*)::DOUBLE AS mean_recon, max(opening) AS opening,
    sum(CASE WHEN direction = 'DEBIT' THEN abs(amount) END)::DECIMAL(25,2) AS debits, sum(CASE WHEN direction = 'CREDIT' THEN abs(amount) END)::DECIMAL(25,2) AS credits
  FROM case3 GROUP BY 1
), scored AS (
  SELECT *, round((mean_balance * 0.35 + mean_amount * 0.25 + mean_direction * 0.20 + mean_date * 0.10 + mean_recon * 0.10)::DOUBLE + 1e-9, 4) AS score,
    abs(opening + coalesce(credits, 0) - coalesce(debits, 0) - closing)::DECIMAL(25,2) AS balance_gap FROM s JOIN last USING (account)
), judged AS (
  SELECT *, concat_ws('|', CASE WHEN n_unknown = n_rows THEN 'HARD_GATE_ALL_DIRECTIONS_UNKNOWN' END, CASE WHEN mean_recon < 0.5 AND n_rows > 5 THEN 'HARD_GATE_LOW_RECONCILIATION' END,
      CASE WHEN mean_amount < 0.5 THEN 'HARD_GATE_LOW_AMOUNT_CONFIDENCE' END, CASE WHEN balance_gap > 5 THEN 'HARD_GATE_BALANCE_MISMATCH_' || balance_gap::VARCHAR END) AS gates,
    concat_ws('|', CASE WHEN n_unknown > 0 AND n_unknown < n_rows THEN 'WARN_' || n_unknown::VARCHAR || '_UNKNOWN_DIRECTIONS' END, CASE WHEN mean_date < 0.7 THEN 'WARN_LOW_DATE_CONFIDENCE' END,
      CASE WHEN mean_recon >= 0.5 AND mean_recon < 0.8 THEN 'WARN_MODERATE_RECONCILIATION' END) AS warnings FROM scored
)"""

SQL = {
    "column_histogram": f"WITH {TOKENS} SELECT doc_id, least(floor(x0 * 120), 119)::INTEGER AS bin, count(*) AS n FROM tokens WHERE x0 BETWEEN 0 AND 1 GROUP BY 1, 2",
    "assign_tokens": f"WITH {_ASSIGNED} SELECT doc_id, token, column_index FROM assigned",
    "build_cells": f"""WITH {_ASSIGNED} SELECT doc_id, (token // 4)::INTEGER AS row_index, column_index, string_agg(text, ' ' ORDER BY x0, token) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_tokens
      FROM assigned GROUP BY 1, 2, 3""",
    "reconstruct_rows": f"""WITH {LINES}, e AS (
        SELECT *, y0 - lag(y1) OVER w AS gap, lag(y1 - y0) OVER w AS height FROM lined WINDOW w AS (PARTITION BY doc_id ORDER BY line)
      ), g AS (SELECT *, sum((kind IN ('M', 'D') OR (kind = 'T' AND coalesce(CASE WHEN height > 0 THEN gap > 1.8::DOUBLE * height ELSE gap >= 0.02 END, false)))::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM e
      ), o AS (SELECT *, first_value(kind) OVER w AS opener, row_number() OVER w AS r FROM g WINDOW w AS (PARTITION BY doc_id, grp ORDER BY line)
      ), k AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INTEGER AS row_index FROM o WHERE grp > 0 AND (opener = 'D' OR (opener = 'M' AND r = 1)))
      SELECT doc_id, row_index, opener = 'M' AS is_marker, min(line) AS first_line, count(*) AS n_lines, string_agg(text, ' ' ORDER BY line) AS raw_text FROM k GROUP BY 1, 2, 3""",
    "first_cell_per_column": f"WITH {TOKENS} SELECT doc_id, column_index, token, text FROM (SELECT *, floor(x0 / 0.21)::INTEGER AS column_index FROM tokens) QUALIFY row_number() OVER (PARTITION BY doc_id, column_index ORDER BY token) = 1",
    "opening_closing": f"WITH {LINES} SELECT doc_id, arg_min(amount, line) AS opening, arg_max(amount, line) AS closing, count(*) AS n_markers FROM lined WHERE kind = 'M' GROUP BY 1",
    "date_forward_fill": f"WITH {LEDGER_RAW} SELECT account, tx_key, last_value(CASE WHEN tx_key % 3 = 0 THEN tx_date END IGNORE NULLS) OVER (PARTITION BY account ORDER BY seq) AS filled FROM ledger_raw",
    "column_stats": rf"""WITH {_VALUES}, {_turns("vals", "doc_id, column_index", "n")}, s AS (
        SELECT doc_id, column_index, greatest(count(*) FILTER (WHERE value <> ''), 1)::DOUBLE AS k, count(*) FILTER (WHERE value <> '' AND {_DATE}) AS dates, count(*) FILTER (WHERE value <> '' AND {_AMOUNT}) AS amounts,
          count(*) FILTER (WHERE value = '') AS blanks, count(*) AS total, count(*) FILTER (WHERE regexp_full_match(value, '[a-zA-Z\s\-\.]+') AND length(value) > 3) AS texts,
          avg(length(value)) FILTER (WHERE value <> '') AS len, count(DISTINCT value) FILTER (WHERE value <> '') AS kinds FROM vals GROUP BY 1, 2)
      SELECT s.doc_id, s.column_index, round(dates / k, 6) AS date_rate, round(amounts / k, 6) AS amount_rate, round(blanks / total::DOUBLE, 6) AS empty_rate, round(texts / k, 6) AS text_rate,
        round(coalesce(len, 0), 6) AS mean_length, round(kinds / k, 6) AS unique_ratio, coalesce(monotonic_score, 0)::DOUBLE AS monotonic_score FROM s LEFT JOIN turns USING (doc_id, column_index)""",
    "sign_change_score": f"WITH {LEDGER_RAW}, v AS (SELECT account, seq, '£' || format('{{:,.2f}}', balance) AS value FROM ledger_raw), {_turns('v', 'account', 'seq')} SELECT account, monotonic_score::DOUBLE AS monotonic_score FROM turns",
    "score_documents": f"""WITH {_SCORED} SELECT account, n_rows, n_confirmed, n_unknown, round(mean_amount, 6) AS mean_amount, round(mean_direction, 6) AS mean_direction, round(mean_recon, 6) AS mean_recon, score, debits, credits FROM judged""",
    "score_gates": f"WITH {_SCORED} SELECT account, gates, warnings, balance_gap FROM judged",
    "score_status": f"""WITH {_SCORED} SELECT account,
        CASE WHEN gates <> '' THEN CASE WHEN contains(gates, 'BALANCE_MISMATCH') THEN 'NEEDS_REVIEW' ELSE 'FAIL' END WHEN score >= 0.85 AND warnings = '' THEN 'PASS' WHEN score >= 0.7 THEN 'PASS_WITH_WARNINGS' WHEN score >= 0.5 THEN 'NEEDS_REVIEW' ELSE 'FAIL' END AS status,
        CASE WHEN score >= 0.85 THEN 'PASS' WHEN score >= 0.7 THEN 'PASS_WITH_WARNINGS' WHEN score >= 0.5 THEN 'NEEDS_REVIEW' ELSE 'FAIL' END AS validation_status,
        CASE WHEN score >= 0.7 THEN 'COMPLETED' ELSE 'NEEDS_REVIEW' END AS document_status, CASE WHEN score >= 0.85 THEN 'A' WHEN score >= 0.7 THEN 'B' WHEN score >= 0.5 THEN 'C' ELSE 'D' END AS profile FROM judged""",
    "text_layer_quality": r"""WITH w AS (SELECT doc_id, i, string_split(coalesce(text, ''), ' ')[i] AS t FROM (SELECT *, unnest(generate_series(1, len(string_split(coalesce(text, ''), ' ')))) AS i FROM documents)),
      s AS (SELECT doc_id, count(*) AS n_words, round(avg(CASE WHEN i <= 50 THEN regexp_matches(t, '\p{L}')::INTEGER END), 6) AS letter_share FROM w GROUP BY 1)
      SELECT *, n_words >= 10 AND letter_share > 0.3 AS has_text, CASE WHEN n_words >= 10 AND letter_share > 0.3 THEN 'PDF_TEXT' ELSE 'OCR' END AS path FROM s""",
    "median_skew": """WITH m AS (SELECT user_id, count(*) AS n_lines, median(value / 10) AS m FROM events WHERE abs(value / 10) < 20 GROUP BY 1 HAVING count(*) >= 3)
      SELECT user_id, n_lines, round(m, 6) AS skew, abs(m) > 0.5 AND abs(m) < 15 AS corrected FROM m""",
    "first_n_mean": f"WITH {TOKENS} SELECT doc_id, round(avg(confidence), 6) AS confidence, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token) AS r FROM tokens WHERE confidence > 0) WHERE r <= 50 GROUP BY 1",
}

#: Folds that SQL can't express; tests hold them against plain Python.
FOLDS = ("cluster_lines", "detect_columns", "assign_roles")
QUERIES = {name: globals()[name] for name in (*SQL, *FOLDS)}
