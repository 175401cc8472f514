"""Versioned tables: what is written, what readers see, and the daily state that merges keep up."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gauge_data import raw_rows
from gaugeworks.operators import merge
from gaugeworks.operators.asof import nearest_observation
from gaugeworks.operators.records import records
from gaugeworks.operators.rollup import daily_rollup
from gaugeworks.plans import series_lookup, series_store
from gaugeworks.schema import RAW
from gaugeworks.sinks import versions

D = "2025-12-26 "


def values(df):
    return {str(r.ts): r.value for r in df.collect()}


def files(root) -> dict[str, bytes]:
    return {os.path.join(at, n): open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "series")
    series_store.load_series(spark, raw_rows(spark, [("2024-05-01 00:00", 1, "x"), (D + "09:00", 2, "x"), (D + "10:00", 5, "x"), ("2025-11-30 10:00", 4, "x")]), path, 1)
    return path


def new_rows(spark):
    return raw_rows(spark, [(D + "10:00", 7, "y"), (D + "11:00", 1, "y")])


def test_a_merge_writes_its_own_rows_and_readers_see_a_version(spark, root):
    before, old = files(root), series_store.read_series(spark, root)
    series_store.merge_series(spark, new_rows(spark), root, "run", 1)
    after = files(root)
    assert all(after[p] == b for p, b in before.items())
    added = [p for p in after if p not in before and "/raw/" in p]
    assert sum(spark.read.parquet(p).count() for p in added) == 2
    want = {"2024-05-01 00:00:00": 1.0, D + "09:00:00": 2.0, D + "10:00:00": 7.0, D + "11:00:00": 1.0, "2025-11-30 10:00:00": 4.0}
    assert values(series_store.read_series(spark, root)) == want
    read_before = series_store.read_series(spark, root)
    series_store.merge_series(spark, raw_rows(spark, [(D + "10:00", 8, "z")]), root, "next", 1)
    versions.compact(spark, root, series_store.tables(1))
    assert values(old) == {"2024-05-01 00:00:00": 1.0, D + "09:00:00": 2.0, D + "10:00:00": 5.0, "2025-11-30 10:00:00": 4.0}
    assert values(read_before) == want
    assert values(series_store.read_series(spark, root)) == want | {D + "10:00:00": 8.0}


def test_a_run_that_dies_is_not_seen_and_a_repeated_one_changes_nothing(spark, root, monkeypatch):
    before = values(series_store.read_series(spark, root))
    with monkeypatch.context() as m:
        m.setattr(versions, "_announce", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            series_store.merge_series(spark, new_rows(spark), root, "run", 1)
    assert values(series_store.read_series(spark, root)) == before
    os.makedirs(f"{root}/versions/number=2/_temporary")  # as a writer leaves it that dies before its file is whole
    assert versions.latest(spark, root).number == 1
    first = series_store.merge_series(spark, new_rows(spark), root, "run", 1)
    again = series_store.merge_series(spark, new_rows(spark), root, "run", 1)
    assert first.number == again.number == 2 and values(series_store.read_series(spark, root))[D + "10:00:00"] == 7.0


def test_stored_rows_are_neither_sorted_nor_shuffled(spark, root, monkeypatch):
    series_store.merge_series(spark, new_rows(spark), root, "run", 1)
    found = series_store.read_series(spark, root)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert re.findall(r"(?<!Broadcast)Exchange", plan) == []
    monkeypatch.setattr(merge, "BROADCAST_CHANGES", 0)
    assert values(series_store.read_series(spark, root)) == values(found)


def test_filters_reach_base_and_changes(spark, root):
    series_store.merge_series(spark, new_rows(spark), root, "run", 1)
    found = series_store.read_series(spark, root).where("parameter = 'water_level_cm' and year = 2024")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], Pushed", plan)
    assert len(filters) >= 2 and all("parameter" in p and "year" in p for p in filters)


def test_compaction_keeps_other_folders_and_vacuum_what_counts(spark, root):
    series_store.merge_series(spark, new_rows(spark), root, "run", 1, compact_after=1)
    known = files(root)
    version = versions.latest(spark, root)
    assert versions.changes_waiting(version) == 0
    assert any(p.part and "month=5" in p.part for p in version.of("raw")) and not any(p.part and "month=12" in p.part for p in version.of("raw"))
    want = values(series_store.read_series(spark, root))
    for run in range(3):
        series_store.merge_series(spark, raw_rows(spark, [(D + "12:00", run, "x")]), root, f"v{run}", 1, compact_after=2)
    gone = versions.vacuum(spark, root, keep=1)
    assert gone and len(files(root)) < len(known) + 30
    assert values(series_store.read_series(spark, root)) == want | {D + "12:00:00": 2.0}
    assert versions.vacuum(spark, root, keep=1) == []


def test_other_months_stay_closed(spark, root):
    for at, _, names in os.walk(f"{root}/data/raw"):
        for n in names:
            if "month=5" in at and n.endswith(".parquet"):
                open(os.path.join(at, n), "w").write("no parquet")
                os.remove(os.path.join(at, f".{n}.crc"))
    # The withdrawn least value makes the day be read again, from its own folder.
    series_store.merge_series(spark, raw_rows(spark, [(D + "09:00", 9, "y")]), root, "run", 1)
    days = {str(r.date): (r["count"], r["mean"], r["min"], r["max"]) for r in series_store.read_days(spark, root, 1).collect()}
    assert days == {"2024-05-01": (1, 1.0, 1.0, 1.0), "2025-11-30": (1, 4.0, 4.0, 4.0), "2025-12-26": (2, 7.0, 5.0, 9.0)}


@pytest.mark.parametrize("seed, scale", [(1, 1), (2, 1), (3, None)])
def test_daily_state_equals_the_rollup_of_the_merged_series(spark, tmp_path, seed, scale):
    rng, path = random.Random(seed), str(tmp_path / "series")

    def readings(n):
        at = {f"2025-{rng.choice([1, 2]):02d}-{rng.randint(1, 3):02d} {rng.randrange(6):02d}:00" for _ in range(n)}
        return [(t, rng.choice([None, 1, 2, 3.5, 9]), rng.choice(["a", "b", None])) for t in sorted(at)]

    series_store.load_series(spark, raw_rows(spark, readings(30)), path, scale)
    for run in range(4):
        rows = raw_rows(spark, readings(8)).unionByName(raw_rows(spark, readings(2), 2))
        series_store.merge_series(spark, rows, path, f"run {run}", scale, compact_after=3)
        want = daily_rollup(series_store.read_series(spark, path).select(*RAW.names), scale)
        assert sorted(map(str, series_store.read_days(spark, path, scale).collect())) == sorted(map(str, want.collect()))


def test_only_withdrawn_extremes_are_read_again(spark, root, monkeypatch):
    reread, real = [], versions.touched
    monkeypatch.setattr(versions, "touched", lambda *a: reread.append(1) or real(*a))
    series_store.merge_series(spark, raw_rows(spark, [(D + "11:00", 9, "x")]), root, "new", 1)
    series_store.merge_series(spark, raw_rows(spark, [(D + "10:00", 4, "x")]), root, "inside", 1)
    assert reread == []
    series_store.merge_series(spark, raw_rows(spark, [(D + "11:00", 3, "x")]), root, "greatest", 1)
    assert reread == [1]


def test_rows_without_a_key_and_odd_parameters(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = raw_rows(spark, [(D + "10:00", 5, "x")], 1, "007").unionByName(raw_rows(spark, [(D + "10:00", 6, "x")], 1, "a b/c:d%e=[f]"))
    bad = raw_rows(spark, [(None, 1, "x")]).unionByName(raw_rows(spark, [(D + "10:00", 2, "x")]).withColumn("parameter", F.lit(None).cast("string")))
    series_store.merge_series(spark, rows.unionByName(bad), path, "run/1", 1)
    series_store.merge_series(spark, rows.withColumn("value", F.col("value") + 1), path, "run/2", 1, compact_after=2)
    assert sorted((r.parameter, r.value) for r in series_store.read_series(spark, path).collect()) == [("007", 6.0), ("a b/c:d%e=[f]", 7.0)]
    assert sorted((r.parameter, r.mean) for r in series_store.read_days(spark, path, 1).collect()) == [("007", 6.0), ("a b/c:d%e=[f]", 7.0)]
    assert sorted(r.value for r in spark.read.json(f"{path}/rejects").collect()) == [1.0, 2.0]
    series_store.merge_series(spark, rows.limit(0), path, "empty", 1)
    assert series_store.read_series(spark, path).count() == 2


def spoil(root, wanted):
    """Makes the raw files of other folders unreadable: whoever opens one fails."""
    for at, _, names in os.walk(f"{root}/data/raw"):
        for n in names:
            if n.endswith(".parquet") and not any(w in at for w in wanted):
                open(os.path.join(at, n), "w").write("no parquet")
                os.remove(os.path.join(at, f".{n}.crc"))


@pytest.fixture
def years(spark, tmp_path):
    """Two series over months with gaps; some readings are changes beside the base."""
    rows = [(f"{y}-{m:02d}-{d:02d} {h:02d}:30", float((7 * m + 3 * d + h + y) % 23) if (d + m) % 4 else None, "x")
            for y in (2023, 2024) for m in (1, 2, 5, 9) for d in (3, 4, 20) for h in (9, 10, 21)]
    raw = raw_rows(spark, rows + [("2024-02-20 12:00", 99, "hi"), ("2024-05-20 12:00", 99, "hi"), ("2023-09-04 01:00", -5, "lo")])
    raw = raw.unionByName(raw_rows(spark, rows[:20], 2))
    path = str(tmp_path / "years")
    series_store.load_series(spark, raw.filter("hour(ts) <> 10"), path, 1)
    series_store.merge_series(spark, raw.filter("hour(ts) = 10"), path, "rest", 1)
    return path, raw


def test_records_open_only_the_folders_that_hold_them(spark, years):
    path, raw = years
    want = sorted(map(str, records(raw).collect()))
    held = {f"year={t.year}/month={t.month}/" for r in records(raw).collect() for t in (r.min_ts, r.max_ts)}
    spoil(path, held)
    assert sorted(map(str, series_lookup.stored_records(spark, path, 1).collect())) == want


def test_probes_open_their_days_and_the_neighbours_only(spark, years):
    path, raw = years
    probes = raw_rows(spark, [("2023-05-20 23:00", 0, "p"), ("2023-07-01 00:00", 0, "p"), ("2023-05-04 09:31", 0, "p")]).select(
        "station_id", "parameter", F.col("ts").alias("probe_ts"))
    want = sorted(map(str, nearest_observation(probes, raw).collect()))
    spoil(path, {"year=2023/month=2/", "year=2023/month=5/", "year=2023/month=9/"})  # 3 May has no value
    assert sorted(map(str, series_lookup.stored_nearest(spark, path, probes, 1).collect())) == want


def test_probes_outside_and_without_a_series(spark, years):
    path, raw = years
    probes = raw_rows(spark, [("2020-01-01 00:00", 0, "p"), ("2030-01-01 00:00", 0, "p"), (None, 0, "p")]).unionByName(
        raw_rows(spark, [("2023-05-04 09:31", 0, "p")], 77)).select("station_id", "parameter", F.col("ts").alias("probe_ts"))
    want = sorted(map(str, nearest_observation(probes, raw).collect()))
    assert sorted(map(str, series_lookup.stored_nearest(spark, path, probes, 1).collect())) == want
