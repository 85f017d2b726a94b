"""Every query with SQL gives the SQL's rows."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyframe.plans import registry


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows):
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, small, name):
    got = registry.QUERIES[name](spark, small)
    want = duck.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    wanted = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    have = [r.asDict() for r in got.collect()]
    assert have
    assert rows_of(columns, have) == rows_of(columns, wanted)


def test_entry(spark):
    assert entry.entry(spark).columns == ["account", "n_rows", "n_confirmed", "n_unknown", "reconciliation_rate"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) >= 60


def test_llm_is_not_imported_by_the_rest():
    root = Path(__file__).resolve().parents[1] / "tallyframe"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
