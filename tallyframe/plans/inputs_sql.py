"""SQL of the derived inputs, written from their definitions for DuckDB."""

from __future__ import annotations

from ..sources.derived import HEADERS, PAGE_TOPS, PHRASES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def cased(key: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE ({key}) % {len(values)} {whens} ELSE {values[-1]} END"


LEDGER = """
ledger AS (
  SELECT o_custkey AS account, o_orderkey AS tx_key, o_orderdate::DATE AS tx_date, o_totalprice::DECIMAL(15,2) AS amount,
    CASE WHEN o_orderkey % 2 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS truth, c_acctbal::DECIMAL(15,2) AS opening, c_name AS file_name,
    o_orderstatus AS status, o_orderpriority AS priority,
    (row_number() OVER w - 1)::INTEGER AS seq,
    (c_acctbal::DECIMAL(15,2) + sum(CASE WHEN o_orderkey % 2 = 0 THEN -(o_totalprice::DECIMAL(15,2)) ELSE o_totalprice::DECIMAL(15,2) END) OVER w)::DECIMAL(15,2) AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

_SHOWN, _PLAIN = "format('{:,.2f}', amount)", "amount::VARCHAR"
_AMOUNT_RAW = cased(
    "tx_key",
    (
        _SHOWN,
        f"'£' || {_SHOWN}",
        f"'(' || {_SHOWN} || ')'",
        f"{_SHOWN} || ' DR'",
        f"{_SHOWN} || ' CR'",
        f"'-' || {_PLAIN}",
        f"{_PLAIN} || '-'",
        f"CASE WHEN tx_key % 16 = 7 THEN '-' ELSE 'GBP ' || {_PLAIN} END",
    ),
)
_DATE_RAW = cased(
    "tx_key",
    (
        "strftime(tx_date, '%-d %B %Y')",
        "strftime(tx_date, '%d %b %Y')",
        "strftime(tx_date, '%d %b %y')",
        "strftime(tx_date, '%-dth %b %Y')",
        "upper(strftime(tx_date, '%d%b%y'))",
        "upper(strftime(tx_date, '%d%b'))",
        "strftime(tx_date, '%Y-%m-%d')",
        "strftime(tx_date, '%d/%m/%Y')",
        "strftime(tx_date, '%d-%m-%Y')",
        "strftime(tx_date, '%d.%m.%Y')",
        "strftime(tx_date, '%-d/%-m/%Y')",
        "strftime(tx_date, '%d/%m/%y')",
        "strftime(tx_date, '%d %b')",
        "CASE WHEN tx_key % 28 = 13 THEN 'pending' ELSE strftime(tx_date, '%-d/%-m') END",
    ),
)
LEDGER_RAW = f"""{LEDGER}, ledger_raw AS (
  SELECT *, {_AMOUNT_RAW} AS amount_raw, {_DATE_RAW} AS date_raw,
    (CASE WHEN tx_key % 7 = 0 THEN NULL WHEN tx_key % 11 = 0 THEN balance + 0.01::DECIMAL(15,2)
      WHEN tx_key % 13 = 0 THEN translate(balance::VARCHAR, '73', '18')::DECIMAL(15,2) ELSE balance END)::DECIMAL(15,2) AS reported,
    {cased("tx_key", ("'CARD PAYMENT '", "'DIRECT DEBIT '", "'BANK CREDIT '", "'FEE DR '", "'TRANSFER '"))} || tx_key::VARCHAR AS description
  FROM ledger
)"""

DOC_TEXT = f"""
doc_text AS (
  SELECT doc_id, {cased("doc_id", tuple(quoted(p) for p in PHRASES))} || chr(10) || coalesce(text, '') AS text FROM documents
)"""

PAGE_TOPS_SQL = f"""{LEDGER}, page_tops AS (
  SELECT account AS doc_id, seq AS page_index, {cased("tx_key", tuple(quoted(p) for p in PAGE_TOPS))} AS top_text FROM ledger
)"""

LINES = f"""{LEDGER}, lines AS (
  SELECT account AS doc_id, seq AS line, tx_key AS k, amount,
    CASE WHEN tx_key % 17 = 0 THEN 'M' WHEN tx_key % 3 = 0 THEN 'D' WHEN tx_key % 3 = 1 THEN 'A' ELSE 'T' END AS kind,
    round(seq * 0.02::DOUBLE + CASE WHEN tx_key % 5 = 0 THEN 0.015::DOUBLE ELSE 0.0::DOUBLE END, 6) AS y0,
    CASE WHEN tx_key % 17 = 0 THEN 'Balance brought forward' ELSE 'row ' || tx_key::VARCHAR END AS text
  FROM ledger
), lined AS (SELECT *, round(y0 + CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE 0.01::DOUBLE END, 6) AS y1 FROM lines)"""

TOKENS = """
items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_shipdate) - 1 AS n FROM lineitem
), cells AS (
  SELECT l_orderkey AS doc_id, n, l_partkey, 0 AS c, 0.02::DOUBLE AS pos, strftime(l_shipdate, '%d/%m/%Y') AS text FROM items
  UNION ALL SELECT l_orderkey, n, l_partkey, 1, 0.22::DOUBLE, 'PART ' || l_partkey::VARCHAR FROM items
  UNION ALL SELECT l_orderkey, n, l_partkey, 2, 0.62::DOUBLE, l_quantity::DECIMAL(15,2)::VARCHAR FROM items
  UNION ALL SELECT l_orderkey, n, l_partkey, 3, 0.82::DOUBLE, l_extendedprice::DECIMAL(15,2)::VARCHAR FROM items
), tokens AS (
  SELECT doc_id, (n * 4 + c)::INTEGER AS token, round(pos + (l_partkey % 7) * 0.01::DOUBLE, 6) AS x0,
    round(round(pos + (l_partkey % 7) * 0.01::DOUBLE, 6) + 0.05::DOUBLE, 6) AS x1,
    round(n * 0.03::DOUBLE + c * 0.001::DOUBLE, 6) AS y0, round(round(n * 0.03::DOUBLE + c * 0.001::DOUBLE, 6) + 0.01::DOUBLE, 6) AS y1,
    text, 0.9::DOUBLE + (l_partkey % 10) * 0.01::DOUBLE AS confidence
  FROM cells
)"""

TEMPLATES = f"""
templates AS (SELECT p_partkey AS template_id, p_brand AS provider, p_name AS name, p_partkey % 9 <> 0 AS is_active FROM part),
versions AS (
  SELECT template_id, v::INTEGER AS version_number, (p_size + v)::INTEGER AS sample_count,
    string_split({cased("template_id + v", tuple(quoted(h) for h in HEADERS))}, '|') AS headers
  FROM (SELECT p_partkey AS template_id, p_size, unnest(generate_series(1, p_size % 3 + 1)) AS v FROM part WHERE p_partkey % 4 <> 0)
)"""

REVIEWS = f"""
reviews AS (
  SELECT event_id AS review_id, user_id AS doc_id, {cased("event_id", ("'PENDING'", "'IN_REVIEW'", "'RESOLVED'", "'SKIPPED'"))} AS status,
    (event_id % 10 + 1)::INTEGER AS priority, ts AS created_at FROM events
)"""
