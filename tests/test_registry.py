"""The registered queries against their SQL, and the shape of their plans."""

import re

import duckdb
import pytest

from __spark_entry__ import entry
from check_oracle import compare, connect
from registry import all_queries as queries
from registry import all_sql as oracle_sql

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SMALL, queries()[name], oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


# Patterns from columns are translated in Python; the others run jobs that their plans don't show.
LAZY = [n for n in NAMES if not n.startswith(("csv", "file", "workbook", "parquet", "step_metrics", "change_summary", "run_result", "regex_columns"))]


@pytest.mark.parametrize("name", LAZY)
def test_plans_hold_no_python_and_no_cross_join(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "MapInPandas", "MapInArrow"):
        assert bad not in plan, plan
    # Only a final aggregate or a top-k may end in one partition.
    if "SinglePartition" in plan:
        assert re.search(r"HashAggregate|TakeOrdered", plan)


def test_projections_prune_columns(spark):
    plan = queries()["drop_rename_columns"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan


def test_filters_are_pushed(spark):
    plan = queries()["filter_keep"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    for part in ("GreaterThan(o_totalprice,100000.0)", "EqualNullSafe(o_orderstatus,F)", "StringStartsWith(o_orderpriority,1)"):
        assert part in pushed
    dropped = queries()["filter_drop_null_safe"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in dropped


def test_runs_without_sort_or_dedupe_never_shuffle(spark):
    for name in ("fill_missing", "rule_cases_cumulative", "order_desk_document", "run_workflow_sequence", "highlight_cells"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1, name


def test_workbooks_of_signless_zeros_and_repeated_keys(spark, tmp_path):
    """A zero below zero reads 0, and rows of one key come in the same order on both sides."""
    rows = [(k, f"name {k}", k % 3, float(k) / 4, "BUILDING") for k in range(20)]
    rows += [(7, "name 8", 1, -0.0, "MACHINERY"), (7, "name 6", 1, 2.5, "AUTO"), (11, "name 12", 2, -0.0, "AUTO")]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert compare(spark, con, str(tmp_path), queries()["workbook_all_sheets"], oracle_sql()["workbook_all_sheets"]) is None
