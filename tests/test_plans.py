"""Plan shapes: few exchanges, pre-aggregation, no pairwise joins, no Python rows."""

import re

import pytest

import __spark_entry__ as entry
from tidepanel.operators import dedup, features as X
from tidepanel.plans import queries_state
from tidepanel.plans.catalog import QUERIES
from tidepanel.plans.registry import Inputs
from tidepanel.sources import files

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_feature_frame_needs_two_exchanges(static, tmp_path):
    Inputs(static, FOLDER).activity.write.parquet(str(tmp_path / "panel"))
    panel = static.read.parquet(str(tmp_path / "panel"))
    assert _plan(X.feature_frame(panel)).count("Exchange hashpartitioning") == 2


def test_bucketed_panel_needs_no_exchange(static):
    files.save_bucketed_panel(Inputs(static, FOLDER).activity, "panel_by_entity", 4)
    plan = _plan(X.add_demand_rolling(static.table("panel_by_entity")))
    assert "Exchange" not in plan
    static.sql("DROP TABLE panel_by_entity")


def test_dedup_combines_before_the_shuffle(static):
    rows = Inputs(static, FOLDER).table("lineitem").selectExpr("l_partkey AS k", "l_orderkey AS _seq", "l_quantity AS v")
    plan = _plan(dedup.keep_last(rows, ["k"]))
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning")  # printed below, so run before


def test_trailing_history_is_trimmed_before_the_shuffle(static):
    panel = Inputs(static, FOLDER).activity
    dates = panel.select("date").distinct()
    assert "WindowGroupLimit" in _plan(X.trailing_history(panel, dates))


def test_category_filter_reaches_the_scan(static):
    plan = _plan(entry.queries()["b11_category_filter"](static, FOLDER))
    part = next(l for l in plan.splitlines() if "FileScan" in l and "p_type" in l)
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in part.replace("p_brand:string,", "").replace("p_name:string,", "")


@pytest.mark.parametrize("name, most", [
    ("c17_live_frame", 13), ("e10_weekly_by_category", 4), ("e15_scatter", 6), ("e18_trends", 7), ("e21_report", 13)])
def test_exchanges_of_registered_queries(static, name, most):
    assert len(re.findall(r"\bExchange ", _plan(QUERIES[name].run(static, FOLDER)))) <= most


EAGER = {"g7_split_date", "g12_ingest_step", "g13_run_cycle", "h3_gbt_train", "h4_predict", "h14_retrain", "h13_contributions"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    plan = _plan(QUERIES[name].run(spark, FOLDER))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas|FlatMapGroups", plan)


@pytest.mark.parametrize("build", [queries_state.h9_policy, queries_state._feed])
def test_events_become_a_panel_once(spark, build):
    i = Inputs(spark, FOLDER)
    build(i)
    assert "Aggregate" not in _plan(i.activity)
