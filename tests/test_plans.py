"""Plans keep to few exchanges, pruned columns and pushed filters, and run no Python where none is needed."""

import re

import pytest

from tallyframe.operators import ledger
from tallyframe.plans import registry


@pytest.fixture
def plan_of(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every table were large
    yield lambda name: registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


#: The join of orders and customers deals both by account; all windows reuse that.
ONE_DEAL = ("account_reconciliation", "solve_routed", "validate_balance_chain", "reconstruct_rows", "segment_ranges", "score_status", "column_stats", "date_forward_fill", "sign_change_score")


@pytest.mark.parametrize("name", ONE_DEAL)
def test_windows_share_the_join_s_partitioning(plan_of, name):
    assert len(re.findall(r"Exchange hashpartitioning", plan_of(name))) == 2


@pytest.mark.parametrize("name", ["cluster_lines", "detect_columns", "column_histogram", "first_n_mean"])
def test_one_exchange(plan_of, name):
    assert len(re.findall(r"Exchange hashpartitioning", plan_of(name))) == 1


FOLDS = {"detect_columns", "assign_roles"}


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith("stream")))
def test_no_python_and_no_cross_join(plan_of, name):
    plan = plan_of(name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert bool(re.search("Python|Pandas|Arrow", plan)) is (name in FOLDS)


def test_filters_and_columns_reach_the_scan(spark, small):
    rows = ledger.filtered(spark.read.parquet(f"{small}/orders.parquet"), o_orderstatus="F").select("o_orderkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", plan)
