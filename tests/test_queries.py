"""Every registered query: its plan's shape and its rows against the check SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from callmetrics.plans.catalog import CHECKS, QUERIES
from tools.check import TABLES, compare, connect

SF_DIR = "/root/testdata/sf0.001"

# Pairs of all rows, row-at-a-time Python, and whole tables in one window.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")
# Whole texts and replicates are scored by Arrow functions in their rows.
TEXT_QUERIES = [n for n in QUERIES if re.match(r"tr[1-9]_|wn[78]_|me12_|me14_", n)]
# Joins that a broadcast hides at this scale.
JOINED = ["jn1_calls_instances", "jn2_study_events", "ag7_cohort_audit", "sk4_update_scores", "jn3_remaining_plan", "me14_out_of_fold_metadata"]


@pytest.fixture(scope="module")
def duck():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in FORBIDDEN if bad in plan and not (bad == "ArrowEvalPython" and name in TEXT_QUERIES)]
    if name in CHECKS:
        assert compare(df, duck.execute(CHECKS[name])) is None
    else:
        assert df.count() >= 0


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["level_value", "correct", "silent_wrong", "loud", "spend_microdollars"]
    assert df.count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
    assert len(TABLES) == 14 and duckdb.__version__


def test_scan_reads_only_what_it_needs(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = QUERIES["ag1_study_status"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema"):]
    assert "o_custkey" not in read and "o_orderpriority" in read
    plan = QUERIES["tr5_texture_peaks"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("texture", "")


def test_filters_reach_the_scan(spark):
    plan = QUERIES["sk2_add_instances"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_nationkey)" in plan


@pytest.mark.parametrize("name", ["tr1_trace_features", "tr2_repetition", "wn7_rolling_risk", "wn8_first_trigger", "tr6_trigger_replay"])
def test_texts_are_not_moved(spark, name):
    assert "Exchange" not in QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_one_pass_plans(spark):
    plan = lambda name: QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan("rs1_rescored_status").count("FileScan") == 1 and "Join" not in plan("rs1_rescored_status")
    assert plan("ag7_cohort_audit").count("FileScan") == 2
    assert "Window" not in plan("jn5_plan_summary")


@pytest.mark.parametrize("name", JOINED)
def test_without_broadcasts(spark, duck, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, SF_DIR)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [bad for bad in FORBIDDEN if bad in plan]
        assert compare(df, duck.execute(CHECKS[name])) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
