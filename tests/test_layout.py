"""Station groups that follow the size of a period, in plain stores and in versions."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from gauge_data import raw_rows
from gaugeworks.operators.rollup import daily_rollup
from gaugeworks.plans import refresh, series_store
from gaugeworks.schema import RAW
from gaugeworks.sinks import store, versions
from gaugeworks.sources.store import normalise_raw, read_daily, read_raw


def readings(spark, stations, day="2025-03-04", hours=6, value=1.0, parameter="water_level_cm"):
    rows = spark.range(stations).crossJoin(spark.range(hours).withColumnRenamed("id", "h"))
    ts = F.make_timestamp_ntz(*[F.lit(int(x)) for x in day.split("-")], F.col("h").cast("int"), F.lit(0), F.lit(0))
    return normalise_raw(rows.select(F.col("id").cast("int").alias("station_id"), F.lit(parameter).alias("parameter"),
                                     ts.alias("ts"), F.lit(value).alias("value"), F.lit("x").alias("status")))


def groups(root, month):
    """Station groups of a month that have files, by the folder above them."""
    return sorted({int(re.search(r"bucket=(\d+)", at).group(1)) for at, _, names in os.walk(root)
                   if f"month={month}/" in at + "/" and any(n.endswith(".parquet") for n in names)})


def rows_of(df):
    return sorted(map(str, df.select(*RAW.names).collect()))


def test_folders_at_a_hundred_times_the_data():
    """Rows of about 8 bytes: files stay between 32 MB and 1 GB from one folder on."""
    for rows in (1 << 24, 10 ** 8, 2_880_000_000, 10 ** 11):
        per_folder = rows / (1 << store.depth_for(rows))
        assert 32e6 <= 8 * per_folder <= 1e9
    assert [store.depth_for(n) for n in (0, 1, 1 << 24, (1 << 24) + 1, (1 << 25) + 1)] == [0, 0, 0, 1, 2]


def test_a_plain_store_has_as_many_groups_as_its_periods_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDER_ROWS", 100)
    path = str(tmp_path / "raw")
    raw = readings(spark, 60).unionByName(readings(spark, 10, "2025-04-04"))
    store.write_raw(raw, path)
    assert groups(path, 3) == [4, 5, 6, 7] and groups(path, 4) == [1]
    assert rows_of(read_raw(spark, path)) == rows_of(raw)
    stored = spark.read.parquet(path)
    assert store.stored_depths(stored, path) == {"water_level_cm/2025/3": 2, "water_level_cm/2025/4": 0}
    assert stored.groupBy("station_id", "month").agg(F.count_distinct("bucket").alias("n")).where("n > 1").isEmpty()
    daily = str(tmp_path / "daily")
    store.write_daily(daily_rollup(raw, 1), daily, depths=store.daily_depths(stored))
    assert read_daily(spark, daily).count() == 70 and max(len(x) for x in [os.listdir(f"{daily}/parameter=water_level_cm/year=2025")]) > 8


def test_a_plain_merge_keeps_the_groups_and_opens_those_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDER_ROWS", 100)
    raw_path, daily_path, copy = (str(tmp_path / n) for n in ("raw", "daily", "copy"))
    raw = readings(spark, 60)
    for path in (raw_path, copy):
        store.write_raw(raw, path)
    store.write_daily(daily_rollup(raw, 1), daily_path)
    new = raw_rows(spark, [("2025-03-04 02:00", 9, "y"), ("2025-05-01 00:00", 3, "y")], 7)
    refresh.merge_into_store(spark, new, raw_path, "run", [copy], daily_path, 1)
    want = rows_of(raw.where("not (station_id = 7 and hour(ts) = 2)").unionByName(new.select(*RAW.names)))
    assert rows_of(read_raw(spark, raw_path)) == want == rows_of(read_raw(spark, copy))
    assert groups(raw_path, 3) == [4, 5, 6, 7] and groups(raw_path, 5) == [1]
    days = read_daily(spark, daily_path).where("station_id = 7").orderBy("date").collect()
    assert [(str(r.date), r.max) for r in days] == [("2025-03-04", 9.0), ("2025-05-01", 3.0)]
    other = str(tmp_path / "other")
    store.write_raw(raw, other, depths={})
    with pytest.raises(ValueError, match="station groups"):
        refresh.merge_into_store(spark, new, raw_path, "next", [other], None, 1)


@pytest.mark.parametrize("first", [True, False])
def test_a_period_that_outgrows_its_folders_is_split_by_compaction(spark, tmp_path, monkeypatch, first):
    monkeypatch.setattr(store, "FOLDER_ROWS", 100)
    root = str(tmp_path / "series")
    early, march = readings(spark, 10, "2025-02-04"), readings(spark, 30)
    if first:
        series_store.load_series(spark, early.unionByName(march), root, 1)
        now = versions.latest(spark, root)
        assert now.depths("raw") == {"water_level_cm/2025/3": 1} and now.depths("partials") == {}
        assert groups(f"{root}/data/raw", 3) == [2, 3] and groups(f"{root}/data/raw", 2) == [1]
    else:
        series_store.merge_series(spark, early.unionByName(march), root, "base", 1, compact_after=1)
        assert versions.latest(spark, root).depths("raw") == {"water_level_cm/2025/3": 1}
    before = series_store.read_series(spark, root)
    old, later = rows_of(before), readings(spark, 150, hours=3, value=2.0)
    series_store.merge_series(spark, later, root, "more", 1)
    want = rows_of(early.unionByName(march.where("hour(ts) >= 3")).unionByName(later))
    assert rows_of(series_store.read_series(spark, root)) == want
    assert versions.latest(spark, root).depths("raw") == {"water_level_cm/2025/3": 1}
    version = versions.compact(spark, root, series_store.tables(1))
    assert version.depths("raw") == {"water_level_cm/2025/3": 3} and version.depths("partials") == {"water_level_cm/2025": 1}
    assert rows_of(series_store.read_series(spark, root)) == want and rows_of(before) == old
    assert versions.latest(spark, root) == version
    held = {f for p in version.of("raw") for f in versions.folders_of(spark, root, "raw", series_store.raw_table(), p)}
    assert {int(f.rpartition("=")[2]) for f in held if "month=3" in f} == set(range(8, 16))
    # Later merges place their rows in the new groups, and find the state of their days.
    fix = raw_rows(spark, [("2025-03-04 01:00", 0.5, "y")], 140)
    series_store.merge_series(spark, fix, root, "fix", 1)
    want = daily_rollup(series_store.read_series(spark, root).select(*RAW.names), 1)
    assert sorted(map(str, series_store.read_days(spark, root, 1).collect())) == sorted(map(str, want.collect()))
    versions.vacuum(spark, root, keep=1)
    again = versions.compact(spark, root, series_store.tables(1))
    assert again.depths("raw") == version.depths("raw")
    assert sorted(map(str, series_store.read_days(spark, root, 1).collect())) == sorted(map(str, want.collect()))


def test_folders_of_the_state_hold_what_raw_folders_hold():
    def of(folder, depth):
        return [int(f.rpartition("=")[2]) for f in series_store.folders_of_years([folder], {"p/2025": depth} if depth else {})]

    raw = "parameter=p/year=2025/month=3/bucket="
    assert of(f"{raw}13", 0) == [1] and of(f"{raw}13", 1) == [3] and of(f"{raw}13", 3) == [13]  # slot 5 of 8
    assert of(f"{raw}13", 4) == [16 + 13, 16 + 5] or of(f"{raw}13", 4) == [16 + 5, 16 + 13]
    assert of(f"{raw}1", 2) == [4, 5, 6, 7]
    odd = series_store.folders_of_years(["parameter=a%2Fb/year=2025/month=3/bucket=1"], {"a/b/2025": 1})
    assert odd == ["parameter=a%2Fb/year=2025/bucket=2", "parameter=a%2Fb/year=2025/bucket=3"]


def test_rows_without_a_parameter_and_tables_without_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLDER_ROWS", 2)
    path = str(tmp_path / "raw")
    store.write_raw(readings(spark, 5, hours=2).withColumn("parameter", F.lit(None).cast("string")), path)
    assert spark.read.parquet(path).count() == 10
    store.write_raw(readings(spark, 0), str(tmp_path / "none"))
    root = str(tmp_path / "series")
    series_store.load_series(spark, readings(spark, 0), root, 1)
    assert versions.latest(spark, root).number == 0
