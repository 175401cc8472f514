"""Shapes that every plan must have to hold up on large tables."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from gauge_data import raw_rows
from gaugeworks.operators import series
from gaugeworks.operators.records import records, records_via_daily
from gaugeworks.operators.rollup import daily_rollup, rollup_partials
from gaugeworks.plans import registry
from gaugeworks.plans.refresh import merged_with_store, refreshed_daily
from gaugeworks.sinks.store import write_daily, write_raw
from gaugeworks.sources.live import latest_live
from gaugeworks.sources.store import read_daily, read_raw

SF_DIR = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroups", "CollectLimit", "GlobalLimit"]
# These run jobs of their own before they return a scan of their result.
EAGER = ["store", "stream", "ordered", "listing"]


def plan_of(df, adaptive_final=False):
    if adaptive_final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not any(e in n for e in EAGER)))
def test_no_forbidden_nodes(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF_DIR))
    assert [word for word in FORBIDDEN if word in plan] == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    raw = raw_rows(spark, [(f"{y}-{m:02d}-03 10:00", y + m, "x") for y in (2023, 2024) for m in range(1, 13)])
    raw = raw.unionByName(raw_rows(spark, [("2024-05-03 10:00", 1, "x")], 1, "water_temperature_c"))
    write_raw(raw, f"{root}/raw")
    write_daily(daily_rollup(raw), f"{root}/daily")
    return root


def scans(plan):
    return re.findall(r"FileScan parquet .*", plan)


def files_read(df):
    return len(df.inputFiles())


def test_range_prunes_folders_and_pushes_the_rest(spark, stored):
    raw = read_raw(spark, f"{stored}/raw", "water_level_cm", [1], "2024-05-01", "2024-06-30")
    df = series.raw_range(raw, "2024-05-01", "2024-06-30")
    assert df.count() == 2
    scan = df._jdf.queryExecution().executedPlan().toString()
    partition_filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
    assert "parameter" in partition_filters and "year" in partition_filters and "month" in partition_filters
    pushed = re.search(r"PushedFilters: \[(.*)", scan).group(1)
    assert "IsNotNull(value)" in pushed and "GreaterThanOrEqual(ts" in pushed and "EqualTo(station_id,1)" in pushed
    assert re.search(r"ReadSchema: struct<station_id:int,ts:timestamp_ntz,value:double>", scan)


def test_only_matching_folders_are_listed(spark, stored):
    df = read_raw(spark, f"{stored}/raw", "water_level_cm", start="2024-05-01", end="2024-06-30")
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in metrics
    paths = {r[0] for r in df.selectExpr("input_file_name()").distinct().collect()}
    assert len(paths) == 2 and all("year=2024" in p for p in paths)


def test_relative_range_reaches_the_scan(spark, stored):
    from gaugeworks.functions.scalars import relative_range

    start, end = relative_range("month", "2024-06-15")
    plan = plan_of(series.raw_range(read_raw(spark, f"{stored}/raw", start=start, end=end), start, end))
    assert "GreaterThanOrEqual(ts,2024-05-15T00:00)" in plan and "LessThanOrEqual(ts,2024-06-15T00:00)" in plan


def test_daily_range_prunes_years(spark, stored):
    df = read_daily(spark, f"{stored}/daily", start="2024-01-01", end="2024-12-31")
    plan = plan_of(df)
    assert "year" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "GreaterThanOrEqual(date,2024-01-01)" in plan and df.count() == 13


def test_rollup_combines_before_the_shuffle(spark, stored):
    """Fixed-width state keeps the scan in a hash aggregate with a partial step."""
    plan = plan_of(rollup_partials(read_raw(spark, f"{stored}/raw"), 2))
    assert "partial_sum" in plan and plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("build", [records, latest_live, lambda raw: series.since(raw, "2024-01-01")])
def test_extremes_come_from_hash_aggregates(spark, stored, build):
    """The first aggregate over the scan has fixed-width state; a sort sees only the rows it leaves."""
    plan = plan_of(build(read_raw(spark, f"{stored}/raw")))
    below = re.findall(r"(SortAggregate|HashAggregate)\(.*\n(?:.*(?:Project|Filter|ColumnarToRow|WholeStage).*\n)*.*FileScan", plan)
    assert set(below) == {"HashAggregate"} and len(scans(plan)) in (2, 3)  # a third one prunes folders


def test_newest_is_limited_before_the_shuffle(spark, stored):
    plan = plan_of(series.newest(read_raw(spark, f"{stored}/raw"), 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_only_needed_columns_are_read(spark, stored):
    plan = plan_of(series.value_domain(read_raw(spark, f"{stored}/raw")))
    assert "status" not in scans(plan)[0].split("ReadSchema")[1]


def test_resolutions_read_one_table(spark, stored):
    raw, daily = read_raw(spark, f"{stored}/raw"), read_daily(spark, f"{stored}/daily")
    asked = {r: plan_of(series.series(raw, daily, "water_level_cm", "2024-01-01", "2024-12-31", r))
             for r in ("raw", "hourly", "daily")}
    assert "/daily]" in asked["daily"] and "/raw]" not in asked["daily"]
    assert "/raw]" in asked["hourly"] and "/daily]" not in asked["hourly"]
    assert "/raw]" in asked["raw"] and "/daily]" not in asked["raw"]


def test_a_merge_opens_only_the_folders_it_touches(spark, stored):
    new = raw_rows(spark, [("2024-05-03 10:00", 1, "y"), ("2024-06-03 11:00", 1, "y")])
    merged = merged_with_store(spark, new, f"{stored}/raw")
    assert sorted(r.value for r in merged.collect()) == [1.0, 1.0, 2030.0]
    plan = plan_of(merged)
    assert "dynamicpruning" in plan.split("Initial Plan")[0]
    daily = refreshed_daily(spark, new, new, f"{stored}/daily")
    assert daily.count() == 12
    assert "dynamicpruning" in plan_of(daily, True).split("Initial Plan")[0]


def test_records_by_way_of_the_daily_table_open_few_folders(spark, stored):
    raw = spark.read.parquet(f"{stored}/raw")
    found = records_via_daily(raw, read_daily(spark, f"{stored}/daily"))
    assert sorted(map(str, found.collect())) == sorted(map(str, records(raw).collect()))
    assert "dynamicpruning" in plan_of(found).split("Initial Plan")[0]
