from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gauge_data import raw_rows
from gaugeworks.operators import merge
from gaugeworks.operators.rollup import daily_rollup
from gaugeworks.plans import refresh
from gaugeworks.session import shared_dir
from gaugeworks.sinks.store import write_daily, write_raw
from gaugeworks.sources.store import read_daily, read_raw

D = "2025-12-26 "


def fetched(spark, rows):
    """Readings with their fetch time: (timestamp, value, fetched_at)."""
    parts = [raw_rows(spark, [(t, v, "Rohdaten")]).withColumn("fetched_at", F.lit(f)) for t, v, f in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def values(df):
    return {str(r.ts)[11:16]: r.value for r in df.collect()}


def new_rows(spark):
    return fetched(spark, [(D + "10:00", 6, "a"), (D + "10:00", 7, "b"), (D + "11:00", 1, "a")])


def test_last_wins_and_is_idempotent(spark):
    stored = raw_rows(spark, [(D + "10:00", 5, "Geprueft"), (D + "09:00", 4, "Geprueft")])
    once = merge.merge_last_wins(stored, new_rows(spark))
    assert values(once) == {"09:00": 4.0, "10:00": 7.0, "11:00": 1.0}
    assert sorted(map(tuple, merge.merge_last_wins(once, new_rows(spark)).collect())) == sorted(map(tuple, once.collect()))


def test_a_new_null_replaces_a_stored_value(spark):
    stored = raw_rows(spark, [(D + "10:00", 5, "x")])
    got = merge.merge_last_wins(stored, raw_rows(spark, [(D + "10:00", None, "Rohdaten")])).first()
    assert (got.value, got.status) == (None, "Rohdaten")


def test_report(spark):
    stored = raw_rows(spark, [(D + "10:00", 5, "x"), (D + "09:00", 4, "x")])
    r = merge.merge_report(stored, new_rows(spark)).first()
    assert (r.n_existing, r.n_new, r.n_merged, r.net_new) == (2, 3, 3, 1)


def test_new_readings(spark):
    stored = raw_rows(spark, [(D + "10:00", 5, "x"), (D + "11:00", None, "x")])
    incoming = raw_rows(spark, [(D + "10:00", 5, "y"), (D + "10:00", 6, "y"), (D + "11:00", None, "y"), (D + "12:00", 5, "y")])
    got = merge.new_readings(incoming, stored).collect()
    assert sorted((str(r.ts)[11:16], r.value) for r in got) == [("10:00", 6.0), ("12:00", 5.0)]


def test_live_zero_is_a_value(spark):
    daily = daily_rollup(raw_rows(spark, [(D + "00:00", 8, None)]))
    live = raw_rows(spark, [(D + "10:00", 0, "x")]).select("station_id", "parameter", "ts", "value")
    r = merge.live_or_daily(daily, live).first()
    assert (r.value, r.as_of, r.is_live) == (0.0, D + "10:00:00", True)
    r = merge.live_or_daily(daily, live.filter("false")).first()
    assert (r.value, r.as_of, r.is_live) == (8.0, "2025-12-26", False)
    other = live.withColumn("station_id", F.lit(2))
    assert merge.live_or_daily(daily, other).count() == 2


def files_of(spark, path):
    return {r.path: r.modificationTime for r in
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "modificationTime").collect()}


def test_store_merge_touches_only_its_months(spark, tmp_path):
    raw_path, daily_path, copy = (str(tmp_path / n) for n in ("raw", "daily", "copy"))
    stored = raw_rows(spark, [("2024-05-01 00:00", 1, "x"), ("2025-11-30 10:00", 2, "x"), (D + "10:00", 5, "x"),
                              ("2025-12-01 00:00", 3, "x")])
    write_raw(stored, raw_path)
    write_raw(stored, copy)
    write_daily(daily_rollup(stored), daily_path)
    before = files_of(spark, raw_path)
    refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-1", [copy], daily_path)
    after = files_of(spark, raw_path)
    untouched = {p for p in before if "month=12" not in p}
    assert len(untouched) == 2 and all(after.get(p) == before[p] for p in untouched)
    want = {"2024-05-01 00:00:00": 1.0, "2025-11-30 10:00:00": 2.0, "2025-12-01 00:00:00": 3.0,
            D + "10:00:00": 7.0, D + "11:00:00": 1.0}
    for path in (raw_path, copy):
        assert {str(r.ts): r.value for r in read_raw(spark, path).collect()} == want
    daily = {str(r.date): (r["count"], r["mean"]) for r in read_daily(spark, daily_path).collect()}
    assert daily == {"2024-05-01": (1, 1.0), "2025-11-30": (1, 2.0), "2025-12-01": (1, 3.0), "2025-12-26": (2, 4.0)}
    refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-2", [copy], daily_path)
    assert {str(r.ts): r.value for r in read_raw(spark, raw_path).collect()} == want


def test_merge_creates_a_missing_store(spark, tmp_path):
    raw_path, daily_path = str(tmp_path / "raw"), str(tmp_path / "daily")
    refresh.merge_into_store(spark, new_rows(spark), raw_path, "first", daily_path=daily_path)
    assert values(read_raw(spark, raw_path)) == {"10:00": 7.0, "11:00": 1.0}
    assert read_daily(spark, daily_path).first()["count"] == 2


def test_interrupted_publication_is_finished_by_the_next_run(spark, tmp_path, monkeypatch):
    raw_path = str(tmp_path / "raw")
    write_raw(raw_rows(spark, [(D + "10:00", 5, "x")]), raw_path)

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(refresh, "replace_partitions", lost)
        try:
            refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-1")
        except RuntimeError:
            pass
    assert values(read_raw(spark, raw_path)) == {"10:00": 5.0}
    later = fetched(spark, [("2025-12-27 08:00", 9, "c")])
    refresh.merge_into_store(spark, later, raw_path, "run-2")
    assert values(read_raw(spark, raw_path)) == {"10:00": 7.0, "11:00": 1.0, "08:00": 9.0}


def test_repeated_run_is_skipped(spark, tmp_path):
    raw_path = str(tmp_path / "raw")
    refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-1")
    before = files_of(spark, raw_path)
    refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-1")
    assert files_of(spark, raw_path) == before
    assert shared_dir(spark)


def test_dedup_last_keeps_one_row_per_instant(spark):
    raw = raw_rows(spark, [(D + "10:00", 5, "x"), (D + "10:00", 5, "x"), (D + "11:00", 1, "x")])
    assert values(merge.dedup_last(raw)) == {"10:00": 5.0, "11:00": 1.0}
    assert dt.datetime(2025, 12, 26, 10) in {r.ts for r in merge.dedup_last(raw).collect()}


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    raw_path, daily_path = str(tmp_path / "raw"), str(tmp_path / "daily")
    empty = new_rows(spark).filter("false")
    refresh.merge_into_store(spark, empty, raw_path, "run-0", daily_path=daily_path)
    refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-1", daily_path=daily_path)
    refresh.merge_into_store(spark, empty, raw_path, "run-2", daily_path=daily_path)
    assert values(read_raw(spark, raw_path)) == {"10:00": 7.0, "11:00": 1.0}
    assert read_daily(spark, daily_path).first()["count"] == 2


def test_rows_without_a_key_or_an_instant_go_to_the_rejects(spark, tmp_path):
    raw_path = str(tmp_path / "raw")
    write_raw(raw_rows(spark, [(D + "10:00", 5, "x")]), raw_path)
    bad = raw_rows(spark, [(D + "10:00", 1, "x")]).withColumn("parameter", F.lit(None).cast("string"))
    bad = bad.unionByName(raw_rows(spark, [(None, 2, "x")]))
    refresh.merge_into_store(spark, bad.unionByName(raw_rows(spark, [(D + "11:00", 6, "x")])), raw_path, "run/1")
    assert values(read_raw(spark, raw_path)) == {"10:00": 5.0, "11:00": 6.0}
    assert sorted(r.value for r in spark.read.json(f"{raw_path}_rejects").collect()) == [1.0, 2.0]


def test_parameters_that_look_like_numbers_stay_text(spark, tmp_path):
    raw_path, daily_path = str(tmp_path / "raw"), str(tmp_path / "daily")
    rows = raw_rows(spark, [(D + "10:00", 5, "x")], 1, "007")
    write_raw(rows, raw_path)
    write_daily(daily_rollup(rows), daily_path)
    refresh.merge_into_store(spark, raw_rows(spark, [(D + "10:00", 6, "x")], 1, "007"), raw_path, "r", daily_path=daily_path)
    assert [(r.parameter, r.value) for r in read_raw(spark, raw_path).collect()] == [("007", 6.0)]
    assert [(r.parameter, r.mean) for r in read_daily(spark, daily_path, "007").collect()] == [("007", 6.0)]


def test_a_merge_rewrites_the_groups_of_its_stations_only(spark, tmp_path):
    raw_path = str(tmp_path / "raw")
    stored = raw_rows(spark, [(D + "10:00", 1, "x")], 1)
    for station in range(2, 20):
        stored = stored.unionByName(raw_rows(spark, [(D + "10:00", 1, "x")], station))
    write_raw(stored, raw_path)
    before = files_of(spark, raw_path)
    refresh.merge_into_store(spark, raw_rows(spark, [(D + "11:00", 2, "x")], 1), raw_path, "run")
    after = files_of(spark, raw_path)
    gone = {p.rsplit("/", 1)[0] for p in before if p not in after}
    assert len(gone) == 1 and read_raw(spark, raw_path).count() == 20


def test_an_unreadable_store_is_not_taken_for_an_empty_one(spark, tmp_path):
    (tmp_path / "raw" / "parameter=x").mkdir(parents=True)
    (tmp_path / "raw" / "parameter=x" / "a.parquet").write_text("no parquet")
    try:
        refresh.merge_into_store(spark, new_rows(spark), str(tmp_path / "raw"), "run")
    except Exception:
        pass
    assert (tmp_path / "raw" / "parameter=x" / "a.parquet").read_text() == "no parquet"


def test_stages_of_similar_paths_differ(spark, tmp_path):
    assert refresh.stage_name("merge", "/x/a-b") != refresh.stage_name("merge", "/x/a_b")


def test_a_run_is_published_to_the_targets_it_was_staged_with(spark, tmp_path, monkeypatch):
    raw_path, daily_path = str(tmp_path / "raw"), str(tmp_path / "daily")

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(refresh, "replace_daily", lost)
        try:
            refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-1", daily_path=daily_path)
        except RuntimeError:
            pass
    refresh.merge_into_store(spark, new_rows(spark), raw_path, "run-1")
    assert read_daily(spark, daily_path).first()["count"] == 2


def test_the_export_queried_last_wins(spark):
    old = raw_rows(spark, [(D + "10:00", 90, "x")]).withColumns({"fetched_at": F.lit("2025-12-26 11:50:00"), "source_file": F.lit("b")})
    new = raw_rows(spark, [(D + "10:00", 50, "x")]).withColumns({"fetched_at": F.lit("2026-01-02 08:00:00"), "source_file": F.lit("a")})
    assert values(merge.dedup_last(old.unionByName(new))) == {"10:00": 50.0}
