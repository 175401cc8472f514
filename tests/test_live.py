from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gauge_data import raw_rows
from gaugeworks.functions import scalars as S
from gaugeworks.operators.merge import merge_last_wins
from gaugeworks.sinks import store as sinks
from gaugeworks.sources import live

DAY = "2026-01-25"


def reading(clock, value, field="value_cm", day=DAY, fetched="f1", **changes):
    out = {"timestamp": f"{day}T{clock}:00", "timestamp_unix": 1, "date": day, "time": f"{clock}:00", field: value,
           "unit": "cm", "station_id": "90001234", "station_name": "Pegel", "source": "s", "fetched_at": fetched}
    out.update(changes)
    return json.dumps({k: v for k, v in out.items() if v != "DROP"})


def write(root, name, lines):
    root.mkdir(parents=True, exist_ok=True)
    (root / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture()
def root(tmp_path):
    root = tmp_path / "live"
    write(root, f"water_level_{DAY}.jsonl", [
        reading("16:00", 87), reading("16:00", 87, fetched="f2"), reading("16:00", 88, fetched="f3"),
        "", '{"timestamp": "2026-01-2', reading("17:00", 0), reading("18:00", "DROP"),
        reading("19:00", 5, station_id="abc"), reading("xx", 5)])
    write(root, f"water_temperature_{DAY}.jsonl", [reading("16:00", 4.1, "value_celsius")])
    write(root, "water_level_2026-01-19.jsonl", [reading("01:00", 70, day="2026-01-19")])
    write(root, "water_level_2026-01-18.jsonl", [reading("01:00", 60, day="2026-01-18")])
    write(root, "water_level_2026-01-26.jsonl", [reading("01:00", 99, day="2026-01-26")])
    return str(root)


def test_last_files_and_rejects(spark, root):
    good, rejects = live.read_live(spark, root, DAY, 7)
    raw = live.live_to_raw(good)
    got = sorted((r.parameter, str(r.ts), r.value, r.status) for r in raw.collect())
    assert got == [
        ("water_level_cm", "2026-01-19 01:00:00", 70.0, "Rohdaten"),
        ("water_level_cm", f"{DAY} 16:00:00", 87.0, "Rohdaten"), ("water_level_cm", f"{DAY} 16:00:00", 87.0, "Rohdaten"),
        ("water_level_cm", f"{DAY} 16:00:00", 88.0, "Rohdaten"), ("water_level_cm", f"{DAY} 17:00:00", 0.0, "Rohdaten"),
        ("water_temperature_c", f"{DAY} 16:00:00", 4.1, "Rohdaten")]
    assert raw.first().station_id == 90001234
    assert sorted(r.reject_reason for r in rejects.collect()) == ["bad_ts", "malformed", "no_station", "no_value"]


def test_revision_wins_the_merge(spark, root):
    raw = live.live_to_raw(live.read_live(spark, root, DAY, days_back=1)[0])
    merged = merge_last_wins(raw_rows(spark, []), raw)
    got = {(r.parameter, str(r.ts)[11:16]): r.value for r in merged.collect()}
    assert got == {("water_level_cm", "16:00"): 88.0, ("water_level_cm", "17:00"): 0.0,
                   ("water_temperature_c", "16:00"): 4.1}


def test_latest_is_by_time_and_fetch(spark, root):
    raw = live.live_to_raw(live.read_live(spark, root, DAY, 7)[0])
    got = {r.parameter: (str(r.ts)[11:16], r.value) for r in live.latest_live(raw).collect()}
    assert got == {"water_level_cm": ("17:00", 0.0), "water_temperature_c": ("16:00", 4.1)}
    early = raw.filter(F.hour("ts") < 17)
    assert {r.parameter: r.value for r in live.latest_live(early).collect()}["water_level_cm"] == 88.0


def test_live_lines_round_trip(spark, tmp_path):
    raw = raw_rows(spark, [("2026-01-25 16:00", 87, "x"), ("2026-01-24 16:00", 86, "x")], station=90001234)
    temperature = raw_rows(spark, [("2026-01-25 16:00", 4.1, "x")], 90001234, "water_temperature_c")
    path = str(tmp_path / "live")
    sinks.append_live(sinks.live_lines(raw.unionByName(temperature), "Pegel", "s", F.lit("f1")), path)
    sinks.append_live(sinks.live_lines(raw.limit(1), "Pegel", "s", F.lit("f2")), path)
    good, rejects = live.read_live(spark, path, "2026-01-25", days_back=1)
    assert rejects.count() == 0
    got = sorted((r.parameter, r.value, r.fetched_at, r.timestamp_unix, r.date, r.unit) for r in good.collect())
    assert got == [("water_level_cm", 87.0, "f1", 1769353200, "2026-01-25", "cm"),
                   ("water_level_cm", 87.0, "f2", 1769353200, "2026-01-25", "cm"),
                   ("water_temperature_c", 4.1, "f1", 1769353200, "2026-01-25", "°C")]
    assert live.read_live(spark, path, "2026-01-25", 7)[0].count() == 4


def test_files_left_out_are_listed(spark, root):
    got = {(r.path.rsplit("/", 1)[1], str(r.date)) for r in live.left_out_files(spark, root, DAY, 7).collect()}
    assert got == {("water_level_2026-01-18.jsonl", "2026-01-18"), ("water_level_2026-01-26.jsonl", "2026-01-26")}


def test_a_reading_from_the_future_is_rejected(spark, tmp_path):
    write(tmp_path / "live", f"water_level_{DAY}.jsonl", [
        reading("16:00", 87, fetched=f"{DAY}T16:05:00"), reading("16:00", 1, fetched="2026-01-23T00:00:00"),
        reading("16:00", 2, timestamp="2099-01-01T00:00:00", fetched=f"{DAY}T16:05:00Z")])
    good, rejects = live.read_live(spark, str(tmp_path / "live"), DAY, 7)
    assert [r.value for r in good.collect()] == [87.0]
    assert [r.reject_reason for r in rejects.collect()] == ["future_ts"] * 2


def files_opened(node):
    metrics, children = node.metrics(), node.children()
    own = metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
    return own + sum(files_opened(children.apply(i)) for i in range(children.size()))


def test_only_the_named_days_are_opened(spark, root):
    good, _ = live.read_live(spark, root, DAY, 7)
    good.collect()
    assert files_opened(good._jdf.queryExecution().executedPlan()) == 3


def test_snapshot_is_newest_first_and_bounded_by_day(spark):
    raw = raw_rows(spark, [("2026-01-25 16:00", 87, "x"), ("2026-01-25 17:00", 88, "x"), ("2026-01-24 16:00", 86, "x")])
    docs = {str(r.window_start)[:10]: [m.value for m in r.measurements] for r in sinks.snapshot(raw).collect()}
    assert docs == {"2026-01-25": [88.0, 87.0], "2026-01-24": [86.0]}
    sent = raw_rows(spark, [("2026-01-25 16:00", v, "x") for v in (1, 2, 3)]).withColumns(
        {"fetched_at": F.col("value").cast("string"), "station_name": F.lit("Pegel")})
    (doc,) = sinks.snapshot(sent).collect()
    assert (doc.station_name, doc.fetched_at) == ("Pegel", "3.0")
    assert [(m.value, m.unit, m.n_sent) for m in doc.measurements] == [(3.0, "cm", 3)]


def test_local_epoch_in_summer_and_winter(spark):
    rows = spark.sql("select timestamp_ntz'2026-01-25 16:00:00' t union all select timestamp_ntz'2026-07-25 16:00:00'")
    got = [r[0] for r in rows.orderBy("t").select(S.local_epoch("t")).collect()]
    assert got == [1769353200, 1784988000]


def scalar(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("text,want", [
    ("94,00", 94.0), ("-3.5", -3.5), ("1e2", 100.0), (".5", 0.5), ("94,0abc", None), ("94,0f", None), ("NaN", None),
    ("1.234,50", None), ("", None), ("Infinity", None), (" 7 ", 7.0)])
def test_decimal_comma(spark, text, want):
    assert scalar(spark, S.decimal_comma(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    ("1328434200000", "2012-02-05 09:30:00"), ("2026-01-25T17:00:00", "2026-01-25 17:00:00"),
    ("2026-01-25 17:00", "2026-01-25 17:00:00"), ("2026-01-25", "2026-01-25 00:00:00"), ("gestern", None),
    ("2026-01-25T17:00:00Z", "2026-01-25 17:00:00"), ("2026-01-25T17:00:00.1234567Z", "2026-01-25 17:00:00.123456"),
    ("2026-01-25T17:00:00+0130", "2026-01-25 15:30:00"), ("2026-01-25 17:00-02:00", "2026-01-25 19:00:00"),
    ("2026-01-25T17:00:00.123456789", "2026-01-25 17:00:00.123456"), ("2026-01-2517", None), ("2026-01-25 17:001", None),
    ("2026-13-25", None), ("99999999999999999999", None)])
def test_mixed_timestamps(spark, text, want):
    got = scalar(spark, S.mixed_ts(F.lit(text)))
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("function,text,want", [
    (S.parse_ts, "2025-12-26 00:15", "2025-12-26 00:15:00"), (S.parse_ts, "2025-12-26 24:15", "None"),
    (S.parse_ts, "garbage", "None"), (S.parse_german_ts, "25.01.2026 16:00", "2026-01-25 16:00:00"),
    (S.parse_german_ts, "31.02.2026 16:00", "None"), (S.fold_status, " Geprueft ", "Geprueft"),
    (S.fold_status, '""', "None"), (S.meta_key, "\ufeffNordwert:", "Nordwert"), (S.int_or_null, "12.5", "None"),
    (S.int_or_null, "99999999999", "None"), (S.fixed, 4.25, "4.3"), (S.fixed, None, "None"), (S.unit_of, "x", "")])
def test_small_scalars(spark, function, text, want):
    value = F.lit(text) if text is not None else F.lit(None).cast("double")
    assert str(scalar(spark, function(value))) == want


@pytest.mark.parametrize("preset,start", [
    ("today", "2026-03-31"), ("week", "2026-03-24"), ("month", "2026-02-28"), ("1y", "2025-03-31"),
    ("5y", "2021-03-31"), ("all", "1973-01-01")])
def test_presets(spark, preset, start):
    a, b = S.relative_range(preset, "2026-03-31")
    assert (str(scalar(spark, a)), str(scalar(spark, b))) == (start, "2026-03-31")


def test_unknown_preset():
    with pytest.raises(ValueError):
        S.relative_range("decade", "2026-03-31")


def test_results_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        gap = "2026-03-29 02:30"
        assert str(scalar(spark, S.parse_ts(F.lit(gap)))) == gap + ":00"
        raw = raw_rows(spark, [(gap, 1, None)])
        assert raw.select(S.hour_label("ts").alias("h")).first().h == "2026-03-29 02:00:00"
        assert str(raw.select(S.hour_of("ts").alias("h")).first().h) == "2026-03-29 02:00:00"
        assert str(scalar(spark, S.mixed_ts(F.lit("2026-03-29T02:30:00")))) == gap + ":00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
