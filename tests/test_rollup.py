from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gauge_data import raw_rows
from gaugeworks.operators import rollup, series
from gaugeworks.operators.quality import completeness
from gaugeworks.sources.store import normalise_daily, normalise_raw

D = "2025-12-26 "


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_first_row_null_keeps_the_true_minimum(spark):
    r = one(rollup.daily_rollup(raw_rows(spark, [
        (D + "00:00", None, "Rohdaten"), (D + "00:15", 94, "Rohdaten"), (D + "00:30", 96, "Rohdaten")])))
    assert (r["count"], r["mean"], r["min"], r["max"], r["status_mode"]) == (2, 95.0, 94.0, 96.0, "Rohdaten")


def test_mode_tie_goes_to_the_first_seen(spark):
    r = one(rollup.daily_rollup(raw_rows(spark, [(D + "00:00", 1, "Rohdaten"), (D + "00:15", 2, "Geprueft")])))
    assert r["status_mode"] == "Rohdaten"


def test_rows_without_a_value_count_for_the_mode(spark):
    r = one(rollup.daily_rollup(raw_rows(spark, [
        (D + "00:00", 1, "Geprueft"), (D + "00:15", None, "Rohdaten"), (D + "00:30", None, "Rohdaten")])))
    assert (r["count"], r["status_mode"]) == (1, "Rohdaten")


def test_day_without_values_has_no_row(spark):
    raw = raw_rows(spark, [(D + "00:00", None, "Rohdaten")])
    assert rollup.daily_rollup(raw).count() == 0
    assert one(rollup.status_mode(raw)).status_mode == "Rohdaten"


def test_no_status_at_all(spark):
    assert one(rollup.daily_rollup(raw_rows(spark, [(D + "00:00", 1, None)])))["status_mode"] is None


def random_raw(spark, seed, n=4000):
    rnd = random.Random(seed)
    start = dt.datetime(2023, 12, 20)
    rows = [(start + dt.timedelta(minutes=15 * i), rnd.choice([None, rnd.randrange(-500, 2000) / 10]),
             rnd.choice([None, "Geprueft", "Rohdaten"])) for i in range(n)]
    return raw_rows(spark, [(str(t), v, s) for t, v, s in rows])


def brute_force_daily(rows):
    days = {}
    for r in sorted(rows, key=lambda r: r.ts):
        d = days.setdefault(r.ts.date(), {"values": [], "seen": {}})
        if r.value is not None:
            d["values"].append(r.value)
        if r.status is not None:
            d["seen"][r.status] = d["seen"].get(r.status, 0) + 1
    out = {}
    for day, d in days.items():
        if d["values"]:
            mode = max(d["seen"], key=d["seen"].get) if d["seen"] else None
            out[day] = (len(d["values"]), min(d["values"]), max(d["values"]), mode,
                        pytest.approx(sum(d["values"]) / len(d["values"]), abs=1e-9))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_daily_equals_brute_force(spark, seed):
    raw = random_raw(spark, seed)
    got = {r.date: (r["count"], r["min"], r["max"], r["status_mode"], r["mean"])
           for r in rollup.daily_rollup(raw, 1).collect()}
    assert got == brute_force_daily(raw.collect())


def test_result_does_not_depend_on_partitions_or_chunks(spark):
    raw = random_raw(spark, 3)
    whole = sorted(map(tuple, rollup.daily_rollup(raw.coalesce(1), 1).collect()))
    assert sorted(map(tuple, rollup.daily_rollup(raw.repartition(13), 1).collect())) == whole
    chunks = [rollup.rollup_partials(raw.filter(F.minute("ts") == m), 1) for m in (0, 15, 30, 45)]
    merged = rollup.merge_partials(rollup.merge_partials(*chunks[:2]), *chunks[2:])
    assert sorted(map(tuple, rollup.daily_from_partials(merged).collect())) == whole


def test_hourly_weighted_by_count_is_the_daily_mean(spark):
    raw = random_raw(spark, 4)
    n = raw.filter("value is not null").groupBy(F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("x")).agg(
        F.count("*").alias("n"))
    weighted = (rollup.hourly_mean(raw).join(n, "x").groupBy(F.substring("x", 1, 10).alias("date"))
                .agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("m")))
    daily = {str(r.date): r["mean"] for r in rollup.daily_rollup(raw).collect()}
    assert {r.date: r.m for r in weighted.collect()} == pytest.approx(daily)


def test_range_end_is_midnight_unless_inclusive(spark):
    raw = raw_rows(spark, [(D + "00:00", 1, None), (D + "00:15", 2, None), ("2025-12-27 00:00", 3, None)])
    assert [r.y for r in series.raw_range(raw, "2025-12-26", "2025-12-26").collect()] == [1.0]
    got = series.raw_range(raw, "2025-12-26", "2025-12-26", end_inclusive_day=True, ordered=True).collect()
    assert [(r.x, r.y) for r in got] == [("2025-12-26 00:00:00", 1.0), ("2025-12-26 00:15:00", 2.0)]
    daily = rollup.daily_rollup(raw)
    assert [r.x for r in series.daily_range(daily, "2025-12-26", "2025-12-27", ordered=True).collect()] == [
        "2025-12-26", "2025-12-27"]


def test_the_resolution_asked_for_is_kept_however_long_the_range(spark):
    raw = raw_rows(spark, [("1990-01-01 00:00", 1, None), ("1990-01-01 00:15", 2, None), (D + "00:00", 3, None)])
    daily = rollup.daily_rollup(raw)
    got = series.series(raw, daily, "water_level_cm", "1973-01-01", "2026-01-01", "raw")
    assert sorted(r.y for r in got.collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        series.series(raw, daily, "water_level_cm", "1973-01-01", "2026-01-01", "weekly")


def test_days_covered_counts_whole_periods(spark):
    r = one(completeness(raw_rows(spark, [("2025-12-01 23:00", 1, None), ("2025-12-02 01:00", 2, None)])))
    assert (r.days_covered, r.distinct_dates, r.n_rows) == (1, 2, 2)
    assert r.days_covered == 1


def test_domains(spark):
    raw = raw_rows(spark, [(D + "00:00", 10, None), (D + "12:00", 20, None)])
    d = one(series.value_domain(raw))
    assert (d.y_low, d.y_high, d.span_days) == (9.5, 21.0, 0.5)
    assert one(series.visible_domain(raw, D + "00:00", D + "01:00")).y_high == 10.0
    assert one(series.visible_domain(raw, "2024-01-01", "2024-01-02")).y_high == 1.0
    assert one(series.visible_domain(raw)).y_high == 20.0
    zero = raw_rows(spark, [(D + "00:00", 0, None)])
    assert one(series.visible_domain(zero)).y_high == 1.0


def test_since_takes_the_value_at_the_latest_time(spark):
    raw = raw_rows(spark, [(D + "00:00", 9, None), (D + "01:00", 4, None), ("2025-12-25 00:00", 99, None)])
    r = one(series.since(raw, "2025-12-26"))
    assert (r.n_rows, str(r.latest_ts), r.latest_value) == (2, D + "01:00:00", 4.0)


def test_newest_and_latest(spark):
    raw = raw_rows(spark, [(D + f"{h:02d}:00", h, None) for h in range(20)])
    assert [r.value for r in series.newest(raw, 3).orderBy("rank").collect()] == [19.0, 18.0, 17.0]
    same = raw_rows(spark, [(D + "00:00", v, "x") for v in (3, 9, 5)])
    assert [r.value for r in series.newest(same, 2).orderBy("rank").collect()] == [9.0, 5.0]
    days = raw_rows(spark, [(f"2025-12-{d:02d} 00:00", d, None) for d in (1, 9, 4)])
    assert one(series.latest_daily(rollup.daily_rollup(days)))["mean"] == 9.0


def test_text_flavours_are_normalised(spark):
    raw = spark.createDataFrame([(1, "p", "2025-12-26 00:15", 1.0, None)],
                                "station_id int, parameter string, ts string, value double, status string")
    assert str(normalise_raw(raw).first().ts) == "2025-12-26 00:15:00"
    daily = spark.createDataFrame([(1, "p", "2025-12-26", 1, 1.0, 1.0, 1.0, None)],
                                  "station_id int, parameter string, date string, count int, mean double, "
                                  "min double, max double, status_mode string")
    assert normalise_daily(daily).first().date == dt.date(2025, 12, 26)


def test_start_date_cutoff(spark):
    raw = raw_rows(spark, [("1974-12-31 23:45", 1, None), ("1975-01-01 00:00", 2, None)])
    assert [r.value for r in series.since_date(raw, "1975-01-01").collect()] == [2.0]
