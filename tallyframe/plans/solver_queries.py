"""Queries on directions and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import solver
from ..sources import derived
from .inputs_sql import LEDGER_RAW

SEGMENT, ORDER = ["account"], ["seq"]
KEPT = ("account", "tx_key")
SOLUTION = ("direction", "direction_source", "confidence", "balance_confirmed", "tolerance_used", "correction_applied")


def result(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*KEPT, *SOLUTION, *more)


def solve_balance_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions from the running balance of each account."""
    return result(solver.infer_by_balance(derived.ledger_raw(spark, sf_dir), SEGMENT, ORDER))


def split_columns(rows: DataFrame) -> DataFrame:
    k = F.col("tx_key")
    return rows.withColumns({"debit": F.when((k % 2 == 0) | (k % 19 == 0), F.col("amount")), "credit": F.when(((k % 2 == 1) & (k % 23 != 0)) | (k % 19 == 0), F.col("amount"))})


def solve_separate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_columns(derived.ledger_raw(spark, sf_dir))
    return result(rows.withColumn("s", solver.by_columns(F.col("debit"), F.col("credit"))).select(*KEPT, "s.*"))


def solve_signed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(derived.ledger_raw(spark, sf_dir).withColumn("s", solver.by_sign(F.col("amount_raw"))).select(*KEPT, "s.*"))


def solve_text_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result(derived.ledger_raw(spark, sf_dir).withColumn("s", solver.by_text(F.col("description"))).select(*KEPT, "s.*"))


def account_roles() -> F.Column:
    sets = (("DEBIT", "CREDIT", "BALANCE"), ("SINGLE_AMOUNT", "BALANCE"), ("SINGLE_AMOUNT",), ("DATE",))
    return derived.cased(F.col("account"), 4, *[F.array(*[F.lit(x) for x in s]) for s in sets])


def solve_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with different columns, each solved by its case and checked against its chain."""
    rows = split_columns(derived.ledger_raw(spark, sf_dir))
    # Half of the accounts show no signs.
    rows = rows.withColumn("amount_raw", F.when(F.col("account") % 8 < 4, F.col("amount").cast("string")).otherwise(F.col("amount_raw")))
    return result(solver.solve(rows, account_roles(), SEGMENT, ORDER), "solver_case")


def ocr_balance_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions from balances of which every third has a digit misread."""
    rows = derived.ledger(spark, sf_dir)
    text = F.col("balance").cast("string")
    wrong = F.when(F.col("tx_key") % 3 == 0, F.concat(F.regexp_extract(text, r"^([^18]*)[18]?.*$", 1), F.translate(F.regexp_extract(text, r"^[^18]*([18]?).*$", 1), "18", "73"), F.regexp_extract(text, r"^[^18]*[18]?(.*)$", 1))).otherwise(text)
    rows = rows.withColumns({"seen": wrong.cast("decimal(15,2)"), "base": F.col("balance") + F.when(F.col("truth") == "DEBIT", F.col("amount")).otherwise(-F.col("amount"))})
    return rows.withColumn("found", solver.corrected_direction(F.col("base"), F.col("amount"), F.col("seen"))).select(*KEPT, F.coalesce("found", F.lit("NONE")).alias("found"))


def validate_balance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known directions against balances of which most are missing."""
    rows = derived.ledger_raw(spark, sf_dir)
    none = F.lit(None)
    rows = rows.withColumns(
        {
            "reported": F.when(F.col("tx_key") % 3 != 0, F.col("reported")),
            "direction": F.when(F.col("tx_key") % 10 == 0, "UNKNOWN").otherwise(F.col("truth")),
            "balance_confirmed": F.lit(False),
            "tolerance_used": none.cast("decimal(6,4)"),
            "confidence": F.lit(0.75),
        }
    )
    rows = solver.validate_chain(rows, SEGMENT, ORDER)
    return rows.select(*KEPT, "direction", "expected_balance", "balance_confirmed", "tolerance_used", "confidence")


def account_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation of each account: the flagship."""
    return solver.account_summary(solve_balance_inference(spark, sf_dir), SEGMENT)


def _ladder(diff: str) -> str:
    return f"CASE WHEN {diff} <= 0 THEN 0 WHEN {diff} <= 0.01 THEN 0.01 WHEN {diff} <= 0.02 THEN 0.02 WHEN {diff} <= 0.05 THEN 0.05 WHEN {diff} <= 1.00 THEN 1.00 END::DECIMAL(6,4)"


def _ladder_confidence(t: str) -> str:
    return f"CASE {t} WHEN 0 THEN 0.98 WHEN 0.01 THEN 0.95 WHEN 0.02 THEN 0.90 WHEN 0.05 THEN 0.80 WHEN 1.00 THEN 0.60 END"


def _corrected(previous: str, seen: str) -> str:
    """The first place, then debit before credit."""
    fixed = f"try_cast(substr({seen}::VARCHAR, 1, i - 1) || CASE substr({seen}::VARCHAR, i, 1) WHEN '7' THEN '1' WHEN '3' THEN '8' END || substr({seen}::VARCHAR, i + 1) AS DECIMAL(15,2))"
    test = f"CASE WHEN substr({seen}::VARCHAR, i, 1) NOT IN ('7', '3') THEN NULL WHEN abs({previous} - amount - {fixed}) <= 0.01 THEN 'DEBIT' WHEN abs({previous} + amount - {fixed}) <= 0.01 THEN 'CREDIT' END"
    return f"list_filter(list_transform(range(1, length({seen}::VARCHAR) + 1), lambda i: {test}), lambda d: d IS NOT NULL)[1]"


_CASE3 = f"""{LEDGER_RAW}, prev AS (
  SELECT *, coalesce(last_value(reported IGNORE NULLS) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening) AS previous FROM ledger_raw
), h AS (
  SELECT *, {_ladder("abs(previous - amount - reported)")} AS down, {_ladder("abs(previous + amount - reported)")} AS up FROM prev
), f AS (
  SELECT *, CASE WHEN reported IS NOT NULL AND down IS NULL AND up IS NULL THEN {_corrected("previous", "reported")} END AS fixed FROM h
), case3 AS (
  SELECT account, tx_key,
    CASE WHEN reported IS NULL THEN 'UNKNOWN' WHEN down IS NOT NULL AND up IS NOT NULL THEN 'UNKNOWN' WHEN down IS NOT NULL THEN 'DEBIT' WHEN up IS NOT NULL THEN 'CREDIT' ELSE coalesce(fixed, 'UNKNOWN') END AS direction,
    'BALANCE_SOLVER' AS direction_source,
    (CASE WHEN reported IS NULL THEN 0.2 WHEN down IS NOT NULL AND up IS NOT NULL THEN 0.3 WHEN coalesce(down, up) IS NOT NULL THEN {_ladder_confidence("coalesce(down, up)")} WHEN fixed IS NOT NULL THEN 0.7 ELSE 0.2 END)::DOUBLE AS confidence,
    reported IS NOT NULL AND NOT (down IS NOT NULL AND up IS NOT NULL) AND (coalesce(down, up) IS NOT NULL OR fixed IS NOT NULL) AS balance_confirmed,
    (CASE WHEN down IS NOT NULL AND up IS NOT NULL THEN least(down, up) WHEN coalesce(down, up) IS NOT NULL THEN coalesce(down, up) WHEN fixed IS NOT NULL THEN 0.01 END)::DECIMAL(6,4) AS tolerance_used,
    CASE WHEN fixed IS NOT NULL THEN 'OCR_BALANCE_CORRECTION' END AS correction_applied,
    seq, opening, amount, reported
  FROM f
)"""

_SPLIT = """split AS (
  SELECT *, CASE WHEN tx_key % 2 = 0 OR tx_key % 19 = 0 THEN amount END AS debit,
    CASE WHEN (tx_key % 2 = 1 AND tx_key % 23 <> 0) OR tx_key % 19 = 0 THEN amount END AS credit FROM ledger_raw
), case1 AS (
  SELECT account, tx_key,
    CASE WHEN debit IS NOT NULL AND credit IS NOT NULL OR debit IS NULL AND credit IS NULL THEN 'UNKNOWN' WHEN debit IS NOT NULL THEN 'DEBIT' ELSE 'CREDIT' END AS direction,
    'COLUMN' AS direction_source,
    (CASE WHEN debit IS NOT NULL AND credit IS NOT NULL THEN 0.3 WHEN debit IS NULL AND credit IS NULL THEN 0.2 ELSE 0.9 END)::DOUBLE AS confidence,
    CASE WHEN debit IS NOT NULL AND credit IS NOT NULL THEN 'BOTH_COLUMNS_POPULATED' WHEN debit IS NULL AND credit IS NULL THEN 'NO_AMOUNT_IN_EITHER_COLUMN' END AS correction_applied
  FROM split
)"""


def _signed(source: str) -> str:
    bare = "regexp_replace(amount_raw, '[£, ]', '', 'g')"
    return f"""signed AS (
  SELECT *, CASE
      WHEN regexp_full_match(r, '\\(\\d+\\.?\\d*\\)') THEN -(r[2:-2]::DECIMAL(20,6))
      WHEN regexp_full_match(r, '\\d+\\.?\\d*DR') THEN -(r[:-3]::DECIMAL(20,6))
      WHEN regexp_full_match(r, '\\d+\\.?\\d*CR') THEN r[:-3]::DECIMAL(20,6)
      WHEN regexp_full_match(r, '\\d+\\.?\\d*-') THEN -(r[:-2]::DECIMAL(20,6))
      WHEN regexp_full_match(r, '-\\d+\\.?\\d*') THEN r::DECIMAL(20,6)
      WHEN regexp_full_match(r, '\\d+\\.?\\d*') THEN r::DECIMAL(20,6) END AS v,
    regexp_full_match(r, '\\(\\d+\\.?\\d*\\)|\\d+\\.?\\d*(DR|CR)') AS strong
  FROM (SELECT *, {bare} AS r FROM {source})
), case2 AS (
  SELECT account, tx_key, CASE WHEN v < 0 THEN 'DEBIT' WHEN v > 0 THEN 'CREDIT' ELSE 'UNKNOWN' END AS direction, 'SIGN' AS direction_source,
    (CASE WHEN v IS NULL THEN 0 WHEN strong THEN 0.85 ELSE 0.75 END)::DOUBLE AS confidence FROM signed
)"""


_CASE4 = """case4 AS (
  SELECT account, tx_key, CASE WHEN contains(d, ' DR') OR contains(d, 'DEBIT') THEN 'DEBIT' WHEN contains(d, ' CR') OR contains(d, 'CREDIT') THEN 'CREDIT' ELSE 'UNKNOWN' END AS direction
  FROM (SELECT *, upper(description) AS d FROM ledger_raw)
), case4b AS (
  SELECT *, CASE direction WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'HEADER' END AS direction_source, (CASE direction WHEN 'UNKNOWN' THEN 0 ELSE 0.6 END)::DOUBLE AS confidence FROM case4
)"""

_NONE = "false AS balance_confirmed, NULL::DECIMAL(6,4) AS tolerance_used"


def _chain(source: str, balance: str) -> str:
    """Expected balances by carrying known amounts on from the last balance, as nested windows."""
    return f"""g AS (
  SELECT *, {balance} AS bal, count({balance}) OVER b AS grp, coalesce(last_value({balance} IGNORE NULLS) OVER b, opening) AS anchor
  FROM {source} WINDOW b AS (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT *, anchor + coalesce(sum(CASE WHEN bal IS NULL AND direction <> 'UNKNOWN' AND amount IS NOT NULL THEN CASE direction WHEN 'DEBIT' THEN -abs(amount) ELSE abs(amount) END END)
    OVER (PARTITION BY account, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g
), x AS (
  SELECT *, (CASE direction WHEN 'DEBIT' THEN base - abs(amount) WHEN 'CREDIT' THEN base + abs(amount) END)::DECIMAL(15,2) AS expected_balance FROM e
), u AS (
  SELECT *, CASE WHEN direction <> 'UNKNOWN' AND bal IS NOT NULL AND opening IS NOT NULL THEN {_ladder("abs(expected_balance - bal)")} END AS used FROM x
)"""


_ROUTED = f"""{_CASE3.replace("WITH", "")}, rawed AS (
  SELECT * REPLACE (CASE WHEN account % 8 < 4 THEN amount::VARCHAR ELSE amount_raw END AS amount_raw) FROM ledger_raw
), {_SPLIT}, {_signed("rawed")}, {_CASE4}, share AS (
  SELECT account, avg(regexp_matches(amount_raw, '[()]|DR|CR|-$|^-')::INTEGER) > 0.3 AS many FROM rawed GROUP BY 1
), route AS (
  SELECT r.*, account % 4 IN (0, 1) AS has_balance,
    CASE account % 4 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN many THEN 2 ELSE 3 END WHEN 2 THEN CASE WHEN many THEN 2 ELSE 4 END ELSE 0 END AS solver_case
  FROM rawed r JOIN share USING (account)
), s AS (
  SELECT r.account, r.tx_key, r.seq, r.opening, r.amount, CASE WHEN has_balance THEN r.reported END AS chain_balance, solver_case,
    CASE solver_case WHEN 1 THEN c1.direction WHEN 2 THEN c2.direction WHEN 3 THEN c3.direction WHEN 4 THEN c4.direction ELSE 'UNKNOWN' END AS direction,
    CASE solver_case WHEN 1 THEN c1.direction_source WHEN 2 THEN c2.direction_source WHEN 3 THEN c3.direction_source WHEN 4 THEN c4.direction_source ELSE 'UNKNOWN' END AS direction_source,
    CASE solver_case WHEN 1 THEN c1.confidence WHEN 2 THEN c2.confidence WHEN 3 THEN c3.confidence WHEN 4 THEN c4.confidence ELSE 0 END AS confidence,
    CASE solver_case WHEN 3 THEN c3.balance_confirmed ELSE false END AS was, CASE solver_case WHEN 3 THEN c3.tolerance_used END AS before_used,
    CASE solver_case WHEN 1 THEN c1.correction_applied WHEN 3 THEN c3.correction_applied END AS correction_applied
  FROM route r JOIN case1 c1 USING (tx_key) JOIN case2 c2 USING (tx_key) JOIN case3 c3 USING (tx_key) JOIN case4b c4 USING (tx_key)
), {_chain("s", "chain_balance")}"""

SQL = {
    "solve_balance_inference": f"WITH {_CASE3} SELECT account, tx_key, direction, direction_source, confidence, balance_confirmed, tolerance_used, correction_applied FROM case3",
    "account_reconciliation": f"""WITH {_CASE3} SELECT account, count(*) AS n_rows, count(*) FILTER (WHERE balance_confirmed) AS n_confirmed,
      count(*) FILTER (WHERE direction = 'UNKNOWN') AS n_unknown, round(count(*) FILTER (WHERE balance_confirmed) / count(*)::DOUBLE, 4) AS reconciliation_rate FROM case3 GROUP BY account""",
    "solve_separate_columns": f"WITH {LEDGER_RAW}, {_SPLIT} SELECT account, tx_key, direction, direction_source, confidence, {_NONE}, correction_applied FROM case1",
    "solve_signed_amounts": f"WITH {LEDGER_RAW}, {_signed('ledger_raw')} SELECT account, tx_key, direction, direction_source, confidence, {_NONE}, NULL::VARCHAR AS correction_applied FROM case2",
    "solve_text_hints": f"WITH {LEDGER_RAW}, {_CASE4} SELECT account, tx_key, direction, direction_source, confidence, {_NONE}, NULL::VARCHAR AS correction_applied FROM case4b",
    "solve_routed": f"""WITH {_ROUTED} SELECT account, tx_key, direction, direction_source,
      (CASE WHEN used IS NOT NULL THEN greatest(confidence, {_ladder_confidence("used")}) ELSE confidence END)::DOUBLE AS confidence, was OR used IS NOT NULL AS balance_confirmed,
      coalesce(used, before_used)::DECIMAL(6,4) AS tolerance_used, correction_applied, solver_case::INTEGER AS solver_case FROM u""",
    "ocr_balance_correction": f"""WITH {LEDGER_RAW}, seen AS (
      SELECT account, tx_key, amount, balance + CASE truth WHEN 'DEBIT' THEN amount ELSE -amount END AS base,
        (CASE WHEN tx_key % 3 = 0 AND p > 0 THEN substr(b, 1, p - 1) || CASE substr(b, p, 1) WHEN '1' THEN '7' ELSE '3' END || substr(b, p + 1) ELSE b END)::DECIMAL(15,2) AS seen
      FROM (SELECT *, balance::VARCHAR AS b, CASE WHEN instr(balance::VARCHAR, '1') = 0 THEN instr(balance::VARCHAR, '8') WHEN instr(balance::VARCHAR, '8') = 0 THEN instr(balance::VARCHAR, '1') ELSE least(instr(balance::VARCHAR, '1'), instr(balance::VARCHAR, '8')) END AS p FROM ledger_raw))
      SELECT account, tx_key, coalesce({_corrected("base", "seen")}, 'NONE') AS found FROM seen""",
    "validate_balance_chain": f"""WITH {LEDGER_RAW}, given AS (
      SELECT account, tx_key, seq, opening, amount, CASE WHEN tx_key % 3 <> 0 THEN reported END AS rep, CASE WHEN tx_key % 10 = 0 THEN 'UNKNOWN' ELSE truth END AS direction FROM ledger_raw
    ), {_chain("given", "rep")} SELECT account, tx_key, direction, expected_balance, used IS NOT NULL AS balance_confirmed, used AS tolerance_used,
      (CASE WHEN used IS NOT NULL THEN greatest(0.75, {_ladder_confidence("used")}) ELSE 0.75 END)::DOUBLE AS confidence FROM u""",
}

QUERIES = {name: globals()[name] for name in SQL}
