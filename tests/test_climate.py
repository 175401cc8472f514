from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from gaugeworks.operators import climate, records
from gaugeworks.schema import DAILY

DAYS = dt.timedelta(days=1)


def daily(spark, rows, station=1):
    return spark.createDataFrame(
        [(station, "p", d, 1, float(m), float(m), float(m), None) for d, m in rows], DAILY)


def band(row):
    return [row[c] for c in climate.LEVELS]


def test_interpolated_percentiles(spark):
    rows = [(dt.date(2020, 7, 1 + i), m) for i, m in enumerate([1, 2, 4, 10])]
    r = climate.seasonal_band(daily(spark, rows), "2021-07-02").first()
    assert r.p05 == pytest.approx(1.15) and r.p25 == pytest.approx(1.75) and r.p50 == pytest.approx(3.0)


def test_season_edge(spark):
    days = [dt.date(2021, 12, 28), dt.date(2021, 12, 30), dt.date(2022, 1, 5), dt.date(2022, 1, 9),
            dt.date(2022, 1, 10)]
    frame = daily(spark, [(d, i) for i, d in enumerate(days)])
    plain = climate.seasonal_band(frame, "2023-01-02").first()
    wrapped = climate.seasonal_band(frame, "2023-01-02", wrap=True).first()
    assert band(plain) == pytest.approx(list(np.percentile([2, 3], [5, 25, 50, 75, 95])))
    assert band(wrapped) == pytest.approx(list(np.percentile([0, 1, 2, 3], [5, 25, 50, 75, 95])))


def test_series_outside_the_window_gets_nulls(spark):
    frame = daily(spark, [(dt.date(2020, 1, 15), 1)])
    assert band(climate.seasonal_band(frame, "2020-07-01").first()) == [None] * 5


def test_default_day_is_the_latest_of_each_series(spark):
    a = daily(spark, [(dt.date(2020, 7, 1), 1), (dt.date(2021, 7, 3), 3)], 1)
    b = daily(spark, [(dt.date(2020, 1, 1), 5), (dt.date(2021, 1, 4), 7)], 2)
    got = {r.station_id: r.p50 for r in climate.seasonal_band(a.unionByName(b)).collect()}
    assert got == {1: 2.0, 2: 6.0}


@pytest.mark.parametrize("wrap", [False, True])
def test_all_days_equal_single_days(spark, wrap):
    rnd = random.Random(5)
    rows = [(dt.date(2019, 1, 1) + i * DAYS, rnd.randrange(1000) / 10) for i in range(0, 1500, 1)]
    frame = daily(spark, rows).cache()
    every = {r.target_doy: band(r) for r in climate.seasonal_band_all(frame, wrap=wrap).collect()}
    assert set(every) == set(range(1, 367))
    for day in (dt.date(2021, 1, 1), dt.date(2021, 1, 5), dt.date(2021, 7, 2), dt.date(2021, 12, 27),
                dt.date(2021, 12, 31), dt.date(2020, 12, 31)):
        single = band(climate.seasonal_band(frame, day, wrap=wrap).first())
        assert single == pytest.approx(every[day.timetuple().tm_yday]), day


def test_approximate_option(spark):
    frame = daily(spark, [(dt.date(2020, 7, 1), i) for i in range(101)])
    r = climate.seasonal_band(frame, "2020-07-01", accuracy=10000).first()
    assert r.p50 == 50.0


def test_context_is_thirty_days_each_way(spark):
    rows = [(dt.date(2020, 1, 1) + i * DAYS, 100 - abs(i - 100)) for i in range(200)]
    frame = daily(spark, rows)
    found = spark.createDataFrame([(1, "p", "max", dt.datetime(2020, 4, 10, 7), 100.0, ""), (1, "p", "min", None, 0.0, "")],
                                  "station_id int, parameter string, kind string, ts timestamp_ntz, value double, status string")
    got = records.record_context(found, frame, as_of="2020-03-01").collect()
    near = sorted(r.date for r in got if r.kind == "max")
    assert (near[0], near[-1], len(near)) == (dt.date(2020, 3, 11), dt.date(2020, 5, 10), 61)
    fallback = sorted(r.date for r in got if r.kind == "min")
    assert (fallback[0], fallback[-1], len(fallback)) == (dt.date(2020, 1, 1), dt.date(2020, 3, 1), 61)
