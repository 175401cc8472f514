from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gauge_data import LEVELS, STATION, TENTHS, clock, level_lines, write_exports
from gaugeworks.operators.records import records
from gaugeworks.operators.rollup import daily_rollup, hourly_mean
from gaugeworks.plans import refresh
from gaugeworks.plans.refresh import ingest_exports
from gaugeworks.sources import exports
from gaugeworks.sources.store import read_daily, read_raw
from gaugeworks.streaming import exports as export_streams


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write_exports(tmp_path_factory.mktemp("exports"))


@pytest.fixture(scope="module")
def export(spark, root):
    return exports.read_export(spark, exports.export_paths(root, STATION))


def lines(spark, text, path="f.csv"):
    return spark.createDataFrame([(path, line) for line in text], "file_path string, line string")


def by_parameter(df):
    return {r["parameter"]: r for r in df.collect()}


def brute(values):
    """Readings as (clock, value) of one parameter, from the formula of the fixture."""
    return [(clock(i), v) for i, v in enumerate(values)]


LEVEL, TEMPERATURE = brute([float(v) for v in LEVELS]), brute([v / 10 for v in TENTHS])


def test_row_counts(export):
    got = export.raw.groupBy("parameter").agg(F.count("*").alias("n"), F.count("value").alias("v"),
                                              F.min("ts").cast("string").alias("lo"),
                                              F.max("ts").cast("string").alias("hi"))
    rows = {r["parameter"]: tuple(r)[1:] for r in got.collect()}
    assert rows == {"water_level_cm": (48, 48, "2031-04-03 00:00:00", "2031-04-03 11:45:00"),
                    "water_temperature_c": (52, 51, "2031-04-03 00:00:00", "2031-04-03 12:45:00")}
    assert export.rejects.count() == 0


def test_metadata(export):
    meta = by_parameter(export.meta)
    level, temperature = meta["water_level_cm"], meta["water_temperature_c"]
    assert (level.station_id, level.station_name, level.river, level.time_ref) == (
        STATION, "Beispielstadt", "Musterbach", "MEZ")
    assert (level.easting, level.northing, level.coord_ref) == (400100, 5200200, "Musternetz 1")
    assert (temperature.easting, temperature.northing) == (400300, 5200400)
    assert level.gauge_zero == "123,45 m MH" and temperature.gauge_zero is None
    assert level.raw_meta["Datenbankabfrage"] == "03.04.2031 07:20"
    assert {r.fetched_at for r in export.raw.collect()} == {"2031-04-03 07:20:00"}


def test_daily(export):
    rows = by_parameter(daily_rollup(export.raw, 2))
    for name, readings in (("water_level_cm", LEVEL), ("water_temperature_c", TEMPERATURE)):
        values, row = [v for _, v in readings], rows[name]
        assert (row["count"], row["min"], row["max"], row["status_mode"]) == (len(values), min(values), max(values), "Rohdaten")
        assert row["mean"] == pytest.approx(sum(values) / len(values), abs=1e-9)


def test_hourly(export):
    rows = hourly_mean(export.raw, scale=2).orderBy("parameter", "x").collect()
    for name, readings in (("water_level_cm", LEVEL), ("water_temperature_c", TEMPERATURE)):
        hours: dict[str, list[float]] = {}
        for at, v in readings:
            hours.setdefault(at[:13] + ":00:00", []).append(v)
        got = [(r.x, r.y) for r in rows if r.parameter == name]
        assert got == [(x, pytest.approx(sum(v) / len(v), abs=1e-9)) for x, v in sorted(hours.items())]


def test_records(export):
    rows = by_parameter(records(export.raw))
    for name, readings in (("water_level_cm", LEVEL), ("water_temperature_c", TEMPERATURE)):
        low, high = min(readings, key=lambda r: (r[1], r[0])), min(readings, key=lambda r: (-r[1], r[0]))
        row = rows[name]
        assert (str(row.min_ts)[:16], row.min_value, str(row.max_ts)[:16], row.max_value) == (*low, *high)


@pytest.mark.parametrize("row", ['"2024-01-01 00:";2,0;R', '2024-01-01 00:;2,0;R', '"Messung:";3,0;R', '12:;4;R', 'x', ';;', '"a:b";1;R'])
def test_every_line_is_accounted_for(spark, row):
    text = lines(spark, [*level_lines(), row, ""])
    export = exports.parse_export(text)
    (n,) = exports.line_balance(text).collect()
    assert n.n_lines == n.n_meta + n.n_header + n.n_rows + n.n_blank == len(level_lines()) + 2
    assert n.n_rows == 49 and export.raw.count() == 48
    (reject,) = export.rejects.collect()
    assert reject.reject_reason == ("bad_preamble" if row.startswith('"Mess') else "short_row" if row == "x" else "bad_ts")
    assert exports.file_meta(text).first().raw_meta.keys() == exports.file_meta(lines(spark, level_lines())).first().raw_meta.keys()


def test_identity_from_path_equals_header(spark, root, export):
    by_path = exports.read_export(spark, exports.export_paths(root, STATION), identity="path").raw
    assert {r.fetched_at for r in by_path.collect()} == {"2031-04-03 00:00:00"}
    by_path, raw = by_path.drop("fetched_at"), export.raw.drop("fetched_at")
    assert by_path.exceptAll(raw).count() == 0 and raw.exceptAll(by_path).count() == 0


def test_missing_station_is_an_error(spark, root):
    with pytest.raises(AnalysisException):
        exports.read_export(spark, exports.export_paths(root, 7)).raw.count()


def test_bad_rows_are_kept_apart(spark):
    text = level_lines()[:10] + [
        "garbage;1;Rohdaten", '"2025-12-26 00:00";94,0abc;Rohdaten', '"2025-12-26 00:15";94,0f;Rohdaten',
        '"2025-12-26 00:30";NaN;Rohdaten', '"2025-12-26 00:45";1.234,50;Rohdaten', '"2025-12-26 01:00";5',
        '"2025-12-26 01:15";-3,5;Geprüft', '2025-12-26 01:30;7; Geprueft ', '"2025-12-26 01:45";8;""']
    export = exports.parse_export(lines(spark, text))
    reasons = {(r.reject_reason, r.line.split(";")[0].strip('"')) for r in export.rejects.collect()}
    assert reasons == {("bad_ts", "garbage"), ("bad_value", "2025-12-26 00:00"), ("bad_value", "2025-12-26 00:15"),
                       ("bad_value", "2025-12-26 00:30"), ("bad_value", "2025-12-26 00:45"),
                       ("short_row", "2025-12-26 01:00")}
    rows = {str(r.ts)[11:16]: (r.value, r.status) for r in export.raw.collect()}
    assert rows == {"00:00": (None, "Rohdaten"), "00:15": (None, "Rohdaten"), "00:30": (None, "Rohdaten"),
                    "00:45": (None, "Rohdaten"), "01:15": (-3.5, "Geprueft"), "01:30": (7.0, "Geprueft"),
                    "01:45": (8.0, None)}


def test_files_without_header_or_station(spark):
    no_header = lines(spark, level_lines()[:8] + ['"2025-12-26 00:00";1;x'], "a.csv")
    no_station = lines(spark, ["Zeitbezug:;MEZ", 'Datum;"Abfluss";x', '"2025-12-26 00:00";1;x'], "b.csv")
    both = no_header.unionByName(no_station)
    assert [r.file_path for r in exports.files_without_header(both).collect()] == ["a.csv"]
    export = exports.parse_export(both)
    assert {(r.file_path, r.reject_reason) for r in export.rejects.collect()} == {
        ("a.csv", "no_header"), ("b.csv", "no_station")}
    assert export.raw.count() == 0


def test_unknown_parameter(spark):
    text = ["Messstellen-Nr.:;5", 'Datum;"Abfluss [m³/s]";Prüfstatus', '"2025-12-26 00:00";1;x']
    row = exports.parse_export(lines(spark, text)).raw.first()
    assert (row.station_id, row.parameter) == (5, "unknown")


def test_canonical_metadata_is_the_first_file(spark):
    def file(name, river):
        return lines(spark, ["Messstellen-Nr.:;5", f"Gewässer:;{river}", 'Datum;"Wasserstand";x'], name)

    meta = exports.parse_export(file("b.csv", "second").unionByName(file("a.csv", "first"))).meta
    assert exports.canonical_meta(meta).first().river == "first"


def test_ingest_job(spark, root, tmp_path):
    out = ingest_exports(spark, exports.export_paths(root, STATION), str(tmp_path / "out"), scale=2)
    raw = read_raw(spark, out.raw, parameter="water_level_cm", start="2031-04-03 06:00:00", end="2031-04-03 07:00:00")
    assert raw.count() == 5
    assert read_daily(spark, out.daily, start="2031-04-03", end="2031-04-03").count() == 2
    assert read_daily(spark, out.daily, start="2031-04-04").count() == 0
    doc = spark.read.json(out.meta).first()
    assert len(doc.water_level_files) == 1 and len(doc.water_temperature_files) == 1
    assert doc.station.station_name == "Beispielstadt" and doc.station.gauge_zero.startswith("123,45")


def test_overlapping_exports_count_twice_unless_deduplicated(spark, root, tmp_path):
    paths = exports.export_paths(root, STATION) * 2
    twice = ingest_exports(spark, paths, str(tmp_path / "twice"))
    once = ingest_exports(spark, paths, str(tmp_path / "once"), dedup=True)
    counts = {r.parameter: r["count"] for r in read_daily(spark, twice.daily).collect()}
    assert counts == {"water_level_cm": 96, "water_temperature_c": 102}
    counts = {r.parameter: r["count"] for r in read_daily(spark, once.daily).collect()}
    assert counts == {"water_level_cm": 48, "water_temperature_c": 51}


def counting(spark, read):
    """Lines that pass are counted each time they are read."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def counted(*args):
        found = read(*args)
        return found.mapInArrow(passing, found.schema)

    return counted, seen


def test_the_text_of_an_ingest_is_read_once(spark, root, tmp_path, monkeypatch):
    paths = exports.export_paths(root, STATION)
    n_lines = exports.read_lines(spark, paths).count()
    counted, seen = counting(spark, exports.read_lines)
    monkeypatch.setattr(refresh, "read_lines", counted)
    out = ingest_exports(spark, paths, str(tmp_path / "out"), scale=2)
    assert seen.value == n_lines and read_raw(spark, out.raw).count() == len(LEVELS) + len(TENTHS) + 1


def test_the_text_of_a_batch_of_files_is_read_once(spark, root, tmp_path, monkeypatch):
    n_lines = exports.read_lines(spark, exports.export_paths(root, STATION)).count()
    counted, seen = counting(spark, lambda batch: batch)
    real = export_streams.stage_export
    monkeypatch.setattr(export_streams, "stage_export", lambda batch, *a: real(counted(batch), *a))
    lines = export_streams.export_stream(spark, root)
    query = export_streams.start_ingest(lines, str(tmp_path / "raw"), str(tmp_path / "c"), rejects_path=str(tmp_path / "rejects"), available_now=True)
    query.awaitTermination()
    assert seen.value == n_lines and read_raw(spark, str(tmp_path / "raw")).count() == len(LEVELS) + len(TENTHS) + 1


def test_staged_parse_equals_the_parse_of_lines(spark, tmp_path):
    text = ["Messstellen-Nr.:;7", "Datum;Wasserstand [cm];x", '"2031-04-03 00:00";1,5;Geprüft', '"2031-04-03 00:15";x;y', "kaputt", '"2031-04-03";1', "", '"Quelle:";a']
    both = lines(spark, text, "a/7_b.csv").unionByName(lines(spark, text[2:4], "a/8_no_head.csv"))
    for identity in ("header", "path"):
        plain, staged = exports.parse_export(both, identity=identity), exports.stage_export(both, str(tmp_path / identity), identity)
        for one, two in zip(plain, staged):
            assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect())) != []
