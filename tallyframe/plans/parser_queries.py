"""Queries on amounts, dates, headers, pages and texts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, dates, fixed, rules
from ..operators import segments
from ..sources import derived
from .inputs_sql import DOC_TEXT, LEDGER_RAW, PAGE_TOPS_SQL, TEMPLATES, cased, quoted

AS_OF = date(2024, 6, 1)
#: Cells with faults, by key.
CELLS = ("1234.56", "1,234.56", "£500.00", "(500.00)", "100.00 DR", "250.00 CR", "-75.50", "75.50-", "0.00", "500", "", "-", "1,234,567.89", "(-5.00)", "-5.00 DR", "12,345,678.00", "abc", "€ 7.5", ".5", "--", "(100.00) DR", "9 D", "(3.00", "1.2.3")
HEADERS = ("Date", "Value date", "Transaction details", "Money out (£)", "Paid in", "Withdrawn", "Balance", "(GBP) Amount", "Ref", "Type", "Cheque no", "", "Debit", "Credit", "When", "Running", "Sort code", "Nothing", "Deposits", "Description")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.ledger_raw(spark, sf_dir)
    odd = derived.cased(F.floor(F.col("tx_key") / 3), len(CELLS), *[F.lit(c) for c in CELLS])
    return rows.withColumn("cell", F.when(F.col("tx_key") % 3 == 0, odd).otherwise(F.col("amount_raw")))


def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    return rows.withColumn("p", amounts.parse_amount(F.col("cell"))).select("tx_key", "cell", "p.*")


def amount_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("tx_key", amounts.is_amount_like(F.col("cell")).alias("amount_like"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.ledger_raw(spark, sf_dir)
    return rows.withColumn("p", dates.parse_date(F.col("date_raw"), AS_OF)).select("tx_key", "date_raw", "p.*")


def date_period_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.ledger_raw(spark, sf_dir)
    start, end = F.trunc("tx_date", "month"), F.last_day("tx_date")
    return rows.withColumn("p", dates.parse_date(F.col("date_raw"), AS_OF, start, end)).select("tx_key", "p.*")


def date_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.ledger_raw(spark, sf_dir)
    return rows.select("tx_key", dates.is_date_like(F.concat(F.lit("on "), F.col("date_raw"))).alias("date_like"), dates.is_date_like(F.col("amount_raw")).alias("amount_as_date"))


def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", derived.cased(F.col("p_partkey"), len(HEADERS), *[F.lit(h) for h in HEADERS]).alias("header"))
    return rows.select("p_partkey", "header", rules.header_role(F.col("header")).alias("role"), rules.header_word_count(F.col("header")).cast("int").alias("words"))


def table_column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.template_versions(spark, sf_dir)
    rows = rows.withColumn("headers", F.concat("headers", F.array(F.lit("Transaction date"), F.lit("Money in"))))
    return rows.select("template_id", "version_number", F.array_join(F.transform(rules.table_roles(F.col("headers")), lambda r: F.coalesce(r, F.lit("-"))), ",").alias("roles"))


def summary_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of documents are balance markers or summaries."""
    rows = derived.doc_text(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    text = F.col("text")
    return rows.select("doc_id", "line", rules.is_balance_marker(text).alias("is_marker"), rules.is_summary_row(text).alias("is_summary"), rules.is_marker_word(text).alias("has_word"))


def segment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.segment_pages(derived.page_tops(spark, sf_dir))
    return rows.select("doc_id", "page_index", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"), "is_start", "segment_index")


def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_ranges(segments.segment_pages(derived.page_tops(spark, sf_dir)))


def classify_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.classify(derived.doc_text(spark, sf_dir)).select("doc_id", "doc_family", "family_confidence")


def detect_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.classify(derived.doc_text(spark, sf_dir)).select("doc_id", "provider", "provider_confidence")


def customer_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.doc_text(spark, sf_dir).select("doc_id", segments.customer(F.col("text")).alias("c")).select("doc_id", "c.*")


_CELLS = f"""{LEDGER_RAW}, cells AS (
  SELECT tx_key, CASE WHEN tx_key % 3 = 0 THEN {cased("tx_key // 3", tuple(quoted(c) for c in CELLS))} ELSE amount_raw END AS cell FROM ledger_raw
)"""
_NUMERAL = r"'[+-]?(\d+\.?\d*|\.\d+)'"
_SUFFIX = r"'(?i)\s*(DR|CR|D|C)$'"

_AMOUNTS = rf"""{_CELLS}, a AS (
  SELECT *, trim(cell) AS t, trim(regexp_replace(trim(cell), 'GBP|gbp|EUR|eur|[£₤$€]', '', 'g')) AS bare FROM cells
), b AS (SELECT *, regexp_full_match(bare, '\(.*\)') AS wrapped FROM a
), c AS (SELECT *, CASE WHEN wrapped THEN trim(bare[2:-2]) ELSE bare END AS body FROM b
), d AS (SELECT *, upper(regexp_extract(body, {_SUFFIX}, 1)) AS suffix, trim(regexp_replace(body, {_SUFFIX}, '')) AS rest FROM c
), e AS (SELECT *, CASE WHEN suffix IN ('DR', 'D') THEN true WHEN suffix IN ('CR', 'C') THEN false ELSE wrapped END AS neg FROM d
), f AS (SELECT *, NOT neg AND (ends_with(rest, '-') OR starts_with(rest, '-') OR starts_with(rest, '−')) AS minus,
    regexp_replace(CASE WHEN neg THEN rest WHEN ends_with(rest, '-') THEN rest[:-2] WHEN starts_with(rest, '-') OR starts_with(rest, '−') THEN rest[2:] ELSE rest END, '[, ]', '', 'g') AS digits FROM e
), g AS (SELECT *, CASE WHEN t NOT IN ('', '-', '--', '---') AND regexp_full_match(digits, {_NUMERAL}) THEN try_cast(digits AS DECIMAL(20,6)) END AS v FROM f
)"""

_LIKE = rf"""{_CELLS}, a AS (SELECT *, trim(regexp_replace(trim(cell), '£|GBP|,', '', 'g')) AS s FROM cells
), b AS (SELECT *, trim(regexp_replace(trim(regexp_replace(s, {_SUFFIX}, '')), '^\(|\)$', '', 'g')) AS s2 FROM a
), c AS (SELECT *, regexp_replace(regexp_replace(s2, '^[-−]', ''), '-$', '') AS s3 FROM b)"""


def _year(pattern: str, name: str) -> str:
    y = f"try_cast(regexp_extract(t, '{pattern}', 3) AS INTEGER)"
    if "MON" in name and name != "DDMONYY":
        short = f"CASE WHEN {y} + 2000 >= {AS_OF.year + 50} THEN {y} + 1900 WHEN {y} + 2000 < {AS_OF.year - 50} THEN {y} + 2100 ELSE {y} + 2000 END"
    else:
        short = f"CASE WHEN {y} > 50 THEN 1900 + {y} ELSE 2000 + {y} END"
    return f"CASE WHEN length(regexp_extract(t, '{pattern}', 3)) >= 3 THEN {y} ELSE {short} END"


def _dates(source: str, start: str, end: str) -> str:
    """The first of the formats that gives a valid date, as one struct per format."""
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    tries = []
    for name, pattern, maybe in dates.FORMATS:
        p = "(?i)^" + (pattern.replace(r"(?!\w)", r"(?:\W|$)"))
        one, two = f"try_cast(regexp_extract(t, '{p}', 1) AS INTEGER)", f"try_cast(regexp_extract(t, '{p}', 2) AS INTEGER)"
        month = f"list_position({months}, lower(substr(regexp_extract(t, '{p}', 2), 1, 3)))" if "MON" in name else two
        if name == "YYYY-MM-DD":
            y, m, d = one, two, f"try_cast(regexp_extract(t, '{p}', 3) AS INTEGER)"
        elif name in ("DDMON", "DD_MON"):
            y, m, d = f"coalesce(year({start}), year({end}), {AS_OF.year}) + CASE WHEN month({start}) >= 11 AND {month} <= 2 THEN 1 ELSE 0 END", month, one
        elif name == "DD/MM":
            y, m, d = f"coalesce(year({start}), {AS_OF.year}) + CASE WHEN month({start}) = 12 AND {month} = 1 THEN 1 ELSE 0 END", month, one
        else:
            y, m, d = _year(p, name), month, one
        value = f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"
        unclear = "false"
        if maybe and name.startswith("DD") and "MON" not in name:
            unclear = f"({one} <= 12 AND {two} <= 12 AND {one} <> {two} AND NOT coalesce({value} BETWEEN {start} AND {end} + INTERVAL {dates.GRACE_DAYS} DAY, false))"
        tries.append(f"CASE WHEN regexp_matches(t, '{p}') AND {value} IS NOT NULL THEN {{'d': {value}, 'f': '{name}', 'u': {unclear}}} END")
    return f"""{LEDGER_RAW}, found AS (
      SELECT tx_key, date_raw, coalesce({", ".join(tries)}) AS x FROM (SELECT *, trim(date_raw) AS t, {source} FROM ledger_raw)
    ), said AS (
      SELECT tx_key, date_raw, x.d AS parsed_date, coalesce(x.f, 'UNKNOWN') AS format_detected,
        (CASE WHEN x IS NULL THEN 0 WHEN year(x.d) > {AS_OF.year + 1} THEN 0.3 WHEN year(x.d) < 2000 THEN 0.5 WHEN x.u THEN 0.7 ELSE 0.95 END)::DOUBLE AS confidence,
        coalesce(x.u, false) AS is_ambiguous FROM found
    )"""


_DATE_LIKE = "(?i)" + "|".join(f"(?:{p})" for p in fixed.DATE_LIKE)


def _bare(c: str) -> str:
    return rf"trim(regexp_replace(trim(regexp_replace(trim(lower({c})), '\([a-z]{{3}}\)\s*', '', 'g')), '[£$€]\s*', '', 'g'))"


def _has(h: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({h}, '{w}')" for w in words) + ")"


_ROLE = " ".join(f"WHEN {_has('h', words)} THEN '{role}'" for role, words in fixed.HEADER_ROLES)
_WORDS = " + ".join(f"contains(lower(header), '{w}')::INTEGER" for w in fixed.HEADER_WORDS)
_TABLE = {role: _has("h", words) for role, words in fixed.TABLE_ROLES}


def _score(patterns: tuple[str, ...]) -> str:
    out = []
    for p in patterns:
        if "(?!" in p:  # no lookahead here: what it forbids doesn't stand beside it in these texts
            out.append(r"(regexp_matches(t, '\bhp\b') AND NOT regexp_matches(t, '\bhp\b\s*(sauce|printer)'))::INTEGER")
        else:
            out.append(f"regexp_matches(t, '{p}')::INTEGER")
    return "(" + " + ".join(out) + ")"


_PROVIDERS = ", ".join(f"{{'s': least({_score(p)} * 0.4::DOUBLE, 1.0::DOUBLE), 'r': {-i}, 'n': '{n}'}}" for i, (n, p) in enumerate(fixed.PROVIDERS))


def _any(patterns: tuple[str, ...]) -> str:
    return "regexp_matches(t, '" + "|".join(f"(?:{p})" for p in patterns) + "')"


_PAGES = f"""{PAGE_TOPS_SQL}, p AS (
  SELECT *, ({_any(fixed.PERIOD_SIGNS)}::INTEGER + {_any(fixed.OPENING_SIGNS)}::INTEGER + {_any(fixed.ACCOUNT_SIGNS)}::INTEGER + CASE WHEN {_any(fixed.PAGE_ONE_SIGNS)} THEN 0.4 ELSE 0 END)::DOUBLE AS score
  FROM (SELECT *, lower(top_text) AS t FROM page_tops)
), s AS (SELECT *, page_index = 0 OR score >= 0.8 AS is_start FROM p
), z AS (SELECT *, (sum(is_start::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_index) - 1)::INTEGER AS segment_index FROM s)"""

SQL = {
    "parse_amounts": f"""WITH {_AMOUNTS} SELECT tx_key, cell, CASE WHEN neg OR minus THEN -v ELSE v END AS amount, v IS NOT NULL AND (neg OR minus) AS is_negative,
      CASE WHEN v IS NULL THEN NULL WHEN minus THEN 'MINUS' WHEN suffix <> '' THEN 'DR_CR' WHEN wrapped THEN 'PARENTHESES' END AS sign_convention,
      (CASE WHEN v IS NULL THEN 0 WHEN v = 0 THEN 0.8 WHEN abs(v) > 10000000 THEN 0.5 WHEN minus OR suffix <> '' THEN 0.9 ELSE 0.95 END)::DOUBLE AS confidence FROM g""",
    "amount_like": f"WITH {_LIKE} SELECT tx_key, regexp_full_match(trim(s3), {_NUMERAL}) AS amount_like FROM c",
    "parse_dates": f"WITH {_dates('NULL::DATE AS p0, NULL::DATE AS p1', 'p0', 'p1')} SELECT * FROM said",
    "date_period_disambiguation": f"WITH {_dates(chr(100) + 'ate_trunc(' + chr(39) + 'month' + chr(39) + ', tx_date)::DATE AS p0, last_day(tx_date) AS p1', 'p0', 'p1')} SELECT * EXCLUDE (date_raw) FROM said",
    "date_like": f"WITH {LEDGER_RAW} SELECT tx_key, regexp_matches('on ' || date_raw, '{_DATE_LIKE}') AS date_like, regexp_matches(amount_raw, '{_DATE_LIKE}') AS amount_as_date FROM ledger_raw",
    "header_roles": f"""WITH x AS (SELECT p_partkey, {cased("p_partkey", tuple(quoted(h) for h in HEADERS))} AS header FROM part), y AS (SELECT *, {_bare("header")} AS h FROM x)
      SELECT p_partkey, header, CASE WHEN h = '' THEN NULL WHEN contains(h, 'value') AND contains(h, 'date') THEN 'VALUE_DATE' WHEN {_has("h", ("paid out", "money out"))} THEN 'DEBIT'
        WHEN {_has("h", ("paid in", "money in"))} THEN 'CREDIT' {_ROLE} END AS role, ({_WORDS})::INTEGER AS words FROM y""",
    "table_column_map": f"""WITH {TEMPLATES}, x AS (
        SELECT template_id, version_number, i, {_bare("headers[i]")} AS h FROM (SELECT template_id, version_number, headers || ['Transaction date', 'Money in'] AS headers, unnest(generate_series(1, len(headers) + 2)) AS i FROM versions)
      ), d AS (SELECT *, min(CASE WHEN h <> '' AND {_TABLE["date"]} THEN i END) OVER w AS date_at FROM x WINDOW w AS (PARTITION BY template_id, version_number)
      ), e AS (SELECT *, min(CASE WHEN h <> '' AND {_TABLE["description"]} AND i IS DISTINCT FROM date_at THEN i END) OVER w AS text_at FROM d WINDOW w AS (PARTITION BY template_id, version_number)
      ) SELECT template_id, version_number, string_agg(CASE WHEN h = '' THEN '-' WHEN i = date_at THEN 'date' WHEN i = text_at THEN 'description' WHEN {_TABLE["paid_in"]} THEN 'paid_in'
        WHEN {_TABLE["withdrawn"]} THEN 'withdrawn' WHEN {_TABLE["balance"]} THEN 'balance' WHEN {_TABLE["amount"]} THEN 'amount' ELSE '-' END, ',' ORDER BY i) AS roles FROM e GROUP BY 1, 2""",
    "summary_row_filter": f"""WITH {DOC_TEXT}, x AS (SELECT doc_id, (i - 1)::INTEGER AS line, trim(lower(string_split(text, chr(10))[i]), ' \t') AS t FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM doc_text))
      SELECT doc_id, line, {_any(fixed.BALANCE_MARKERS)} AS is_marker, {_any((*fixed.BALANCE_MARKERS, *fixed.SUMMARY_ROWS))} AS is_summary,
        contains(t, 'brought forward') OR contains(t, 'carried forward') OR contains(t, 'b/f') OR contains(t, 'c/f') AS has_word FROM x""",
    "segment_pages": f"WITH {_PAGES} SELECT doc_id, page_index, round(score, 4) AS score, CASE WHEN page_index = 0 THEN 1.0 ELSE round(least(score / 2, 1.0), 4) END::DOUBLE AS confidence, is_start, segment_index FROM z",
    "segment_ranges": f"WITH {_PAGES} SELECT doc_id, segment_index, min(page_index) AS start_page, max(page_index) AS end_page, count(*) AS n_pages FROM z GROUP BY 1, 2",
    "classify_family": f"""WITH {DOC_TEXT}, x AS (SELECT doc_id, least({_score(fixed.MOTOR_WORDS)} * 0.15::DOUBLE, 1.0::DOUBLE) AS m, least({_score(fixed.BANK_WORDS)} * 0.12::DOUBLE, 1.0::DOUBLE) AS b FROM (SELECT doc_id, lower(text) AS t FROM doc_text))
      SELECT doc_id, CASE WHEN b > m AND b >= 0.3 THEN 'BANK_STATEMENT' WHEN m > b AND m >= 0.3 THEN 'MOTOR_FINANCE' ELSE 'UNKNOWN' END AS doc_family, round(greatest(m, b), 6) AS family_confidence FROM x""",
    "detect_provider": f"""WITH {DOC_TEXT}, x AS (SELECT doc_id, list_max([{_PROVIDERS}]) AS best FROM (SELECT doc_id, lower(text) AS t FROM doc_text))
      SELECT doc_id, CASE WHEN best.s > 0 THEN best.n END AS provider, round(best.s, 6) AS provider_confidence FROM x""",
    "customer_block": rf"""WITH {DOC_TEXT}, l AS (
        SELECT doc_id, i, trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(13)) AS s FROM (SELECT *, unnest(generate_series(1, least(50, len(string_split(text, chr(10)))))) AS i FROM doc_text)
      ), k AS (SELECT *, regexp_matches(s, '(?i){fixed.POSTCODE}') AS is_code, s = '' OR regexp_matches(s, '(?i){fixed.BOILERPLATE}') OR length(s) > 80 AS stops,
        regexp_matches(s, '(?i){fixed.TITLES}') AND NOT regexp_matches(s, '(?i){fixed.BOILERPLATE}') AS titled FROM l
      ), c AS (SELECT doc_id, min(i) FILTER (WHERE is_code) AS pc, min(i) FILTER (WHERE titled) AS first_title FROM k GROUP BY 1
      ), s AS (SELECT k.doc_id, c.pc, greatest(coalesce(max(i) FILTER (WHERE stops AND i < pc), 0), pc - 7) AS stop FROM k JOIN c USING (doc_id) WHERE pc IS NOT NULL GROUP BY 1, 2
      ), b AS (SELECT k.doc_id, list(k.s ORDER BY i) AS block, regexp_replace(upper(regexp_extract(max(k.s) FILTER (WHERE i = s.pc), '(?i){fixed.POSTCODE}', 1)), ' ', '', 'g') AS code FROM k JOIN s USING (doc_id) WHERE i > stop AND i <= s.pc GROUP BY 1)
      SELECT c.doc_id, CASE WHEN c.pc IS NOT NULL THEN block[1] ELSE t.s END AS name, CASE WHEN len(block) > 1 THEN array_to_string(block[2:], ', ') END AS address, code[:-4] || ' ' || code[-3:] AS postcode
      FROM c LEFT JOIN b ON c.doc_id = b.doc_id LEFT JOIN k t ON t.doc_id = c.doc_id AND t.i = c.first_title""",
}

QUERIES = {name: globals()[name] for name in SQL}
