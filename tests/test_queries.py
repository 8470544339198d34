"""Registered queries against their SQL at the smallest scale, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

QUICK = (
    "p1_parse_log", "p2_rejects", "q1_dedup", "q3_gaps", "q5_cleaning_report", "a1_window_agg", "a3_multi_granularity", "a13_describe", "f4_interpolate",
    "w4_rolling", "w12_streak", "j3_events", "j6_pareto", "t5_kruskal", "m2_seasonal_naive", "m14_metrics", "c6_threshold_rule", "c8_trend_rule", "c12_fixed_report",
    "c24_breach_runs", "r2_list_runs", "g2_live_counts",
)


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in TABLES.split():
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, con, name):
    status, n, note = compare(name, entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])
    assert status == "ok" and n > 0, note


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "requests_per_host" in out.columns


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    from trafficlens.plans import views

    events = views.table(spark, sf, "events").where("event_type = 'view'").select("ts")
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "user_id" not in plan
