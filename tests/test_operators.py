"""Window forms against plain folds, and known answers."""

from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.operators import columns, layout, segments, solver

MONEY = st.integers(0, 500_000).map(lambda x: Decimal(x) / 100)
ROW = st.tuples(MONEY, st.one_of(st.none(), MONEY), st.sampled_from(["DEBIT", "CREDIT", "UNKNOWN"]))


def frame(spark, rows, opening):
    data = [(1, i, a, b, d, opening, False, None, 0.5) for i, (a, b, d) in enumerate(rows)]
    return spark.createDataFrame(data, "account int, seq int, amount decimal(15,2), reported decimal(15,2), direction string, opening decimal(15,2), balance_confirmed boolean, tolerance_used decimal(6,4), confidence double")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=12), st.one_of(st.none(), MONEY))
def test_chain_equals_fold(spark, rows, opening):
    got = [r["expected_balance"] for r in solver.validate_chain(frame(spark, rows, opening), ["account"], ["seq"]).orderBy("seq").collect()]
    want, base = [], opening
    for amount, reported, direction in rows:
        step = {"DEBIT": -amount, "CREDIT": amount}.get(direction)
        want.append(None if base is None or step is None else base + step)
        base = reported if reported is not None else base + step if base is not None and step is not None else base
    assert got == want


CASES = [
    ([("50", "950")], "1000", [("DEBIT", True)]),
    ([("200", "1200")], "1000", [("CREDIT", True)]),
    ([("50", "950"), ("200", "1150"), ("75.25", "1074.75")], "1000", [("DEBIT", True), ("CREDIT", True), ("DEBIT", True)]),
    ([("50", "950.01")], "1000", [("DEBIT", True)]),
    ([("50", "950")], None, [("UNKNOWN", False)]),
    ([("0.30", "999.70")], "1000", [("UNKNOWN", False)]),
    ([("50", "750"), ("10", "760")], "900", [("UNKNOWN", False), ("CREDIT", True)]),
    ([("30", "977")], "941", [("CREDIT", True)]),
]


@pytest.mark.parametrize(("rows", "opening", "want"), CASES)
def test_balance_cases(spark, rows, opening, want):
    data = [(Decimal(a), Decimal(b), "UNKNOWN") for a, b in rows]
    found = solver.infer_by_balance(frame(spark, data, None if opening is None else Decimal(opening)).drop("direction", "balance_confirmed", "tolerance_used", "confidence"), ["account"], ["seq"])
    assert [(r["direction"], r["balance_confirmed"]) for r in found.orderBy("seq").collect()] == want


def test_empty_inputs(spark):
    assert solver.infer_by_balance(frame(spark, [], None).drop("direction", "balance_confirmed", "tolerance_used", "confidence"), ["account"], ["seq"]).collect() == []
    assert layout.reconstruct_rows(spark.createDataFrame([], "doc_id int, line int, kind string, y0 double, y1 double")).collect() == []


TOKEN = st.tuples(st.integers(0, 60).map(lambda y: y / 1000), st.integers(0, 900).map(lambda x: x / 1000))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TOKEN, min_size=1, max_size=25))
def test_lines_equal_fold(spark, tokens):
    rows = [(7, i, x, x + 0.01, y, y + 0.01, "w", 0.9) for i, (y, x) in enumerate(tokens)]
    found = layout.cluster_lines(spark.createDataFrame(rows, "doc_id int, token int, x0 double, x1 double, y0 double, y1 double, text string, confidence double"))
    got = {r["token"]: r["line_index"] for r in found.collect()}
    want, anchor, line = {}, None, -1
    for y, x, t in sorted((y, x, i) for i, (y, x) in enumerate(tokens)):
        if anchor is None or abs(y - anchor) > layout.PDF_TOLERANCE:
            anchor, line = y, line + 1
        want[t] = line
    assert got == want


LINE = st.tuples(st.sampled_from("MDAT"), st.integers(0, 30).map(lambda g: g / 1000), st.sampled_from([0.0, 0.01]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINE, min_size=1, max_size=14))
def test_rows_equal_fold(spark, lines):
    data, y = [], 0.0
    for i, (kind, gap, height) in enumerate(lines):
        y = round(y + gap, 6)
        data.append((1, i, kind, y, round(y + height, 6)))
        y = round(y + height, 6)
    found = layout.reconstruct_rows(spark.createDataFrame(data, "doc_id int, line int, kind string, y0 double, y1 double"))
    got = {r["line"]: r["row_index"] for r in found.collect()}
    want, open_, n, before = {}, None, -1, None
    for _, i, kind, y0, y1 in data:
        if kind == "M":
            n, open_ = n + 1, None
            want[i] = n
        elif kind == "D":
            n += 1
            open_ = n
            want[i] = n
        elif open_ is not None:
            if kind == "T":
                gap, height = y0 - before[1], before[1] - before[0]
                if (gap > 1.8 * height) if height > 0 else gap >= 0.02:
                    open_ = None
            if open_ is not None:
                want[i] = open_
        before = (y0, y1)
    assert got == want


def test_column_edges():
    counts = np.zeros(layout.BINS)
    for at in (5, 40, 80, 110):
        counts[at] = 50
    edges = layout.column_edges(counts, 50)
    assert len(edges) == 4
    assert edges[0][0] == 0.0 and edges[-1][1] == 1.0
    assert layout.column_edges(np.zeros(layout.BINS), 10) == [(0.0, 1.0)]


def test_peaks_keep_the_higher_of_two_close_ones():
    h = np.array([0, 5, 0, 6, 0, 0, 0, 3, 3, 0], float)
    assert layout.peaks(h, 1, 4) == [3, 7]
    assert layout.peaks(h, 4, 1) == [1, 3]


def column(**stats):
    base = {"header_role": None, "date_rate": 0, "amount_rate": 0, "empty_rate": 0, "text_rate": 0, "mean_length": 5, "unique_ratio": 0, "monotonic_score": 0, "x_start": 0.0, "x_end": 0.1}
    return base | stats


def test_roles():
    cols = [
        column(date_rate=0.9),
        column(text_rate=0.9, mean_length=20, x_start=0.1, x_end=0.5),
        column(amount_rate=0.9, empty_rate=0.5, x_start=0.5, x_end=0.6),
        column(amount_rate=0.9, empty_rate=0.5, x_start=0.6, x_end=0.7),
        column(amount_rate=0.9, monotonic_score=0.9, x_start=0.7, x_end=1.0),
    ]
    assert columns.decided(cols) == ["DATE", "DESCRIPTION", "DEBIT", "CREDIT", "BALANCE"]
    assert columns.decided([column(header_role="DATE"), column(header_role="DATE"), column()]) == ["DATE", "VALUE_DATE", "DESCRIPTION"]
    assert columns.decided([column(), column(x_start=0.2, x_end=0.9)]) == ["DATE", "DESCRIPTION"]
    assert columns.decided([]) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Bank\nMr J Smith\n1 High St\nLondon\nsw1a1aa\nrest", ("Bank", "Mr J Smith, 1 High St, London, sw1a1aa", "SW1A 1AA")),
        ("Statement\nMr J Smith\n1 High St SW1A 1AA", ("Mr J Smith", "1 High St SW1A 1AA", "SW1A 1AA")),
        ("Statement of Mr X\nMrs Ann Jones\nhello", ("Mrs Ann Jones", None, None)),
        ("nothing here", (None, None, None)),
        (None, (None, None, None)),
        ("SW1A 1AA", ("SW1A 1AA", None, "SW1A 1AA")),
    ],
)
def test_customer(spark, text, want):
    rows = spark.createDataFrame([(text,)], "text string").select(segments.customer(F.col("text")).alias("c"))
    c = rows.first()["c"]
    assert (c["name"], c["address"], c["postcode"]) == want
