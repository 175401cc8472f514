from __future__ import annotations

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gauge_data import raw_rows, ts
from gaugeworks.operators.asof import nearest_observation

D = "2025-12-26 "


def probes(spark, times, station=1):
    return spark.createDataFrame([(station, "water_level_cm", ts(t), i) for i, t in enumerate(times)],
                                 "station_id int, parameter string, probe_ts timestamp_ntz, id int")


def answers(df):
    return {r.id: None if r.obs_ts is None else str(r.obs_ts)[11:16] for r in df.collect()}


def test_ties_edges_and_exact_matches(spark):
    obs = raw_rows(spark, [(D + "00:00", 1, None), (D + "01:00", 2, None)])
    times = ["2025-12-20 00:00", D + "00:30", D + "00:31", D + "01:00", "2026-01-05 00:00"]
    got = answers(nearest_observation(probes(spark, times), obs))
    assert got == {0: "00:00", 1: "00:00", 2: "01:00", 3: "01:00", 4: "01:00"}


def test_null_values_are_no_observations_and_probes_are_kept(spark):
    obs = raw_rows(spark, [(D + "00:00", 1, None), (D + "00:10", None, None)])
    twice = probes(spark, [D + "00:10", D + "00:10"])
    missing = probes(spark, [D + "00:10"], station=9).withColumn("id", F.lit(7))
    no_time = probes(spark, [None]).withColumn("id", F.lit(8))
    got = answers(nearest_observation(twice.unionByName(missing).unionByName(no_time), obs))
    assert got == {0: "00:00", 1: "00:00", 7: None, 8: None}


def test_equal_timestamps_take_the_highest_value(spark):
    obs = raw_rows(spark, [(D + "00:00", 1, None), (D + "00:00", 3, None)])
    assert nearest_observation(probes(spark, [D + "05:00"]), obs).first().value == 3.0


def test_unique_probes_need_no_join_back(spark):
    obs = raw_rows(spark, [(D + "00:00", 1, None)])
    out = nearest_observation(probes(spark, [D + "05:00"]), obs, unique_probes=True)
    assert out.columns == ["station_id", "parameter", "probe_ts", "obs_ts", "value"] and out.first().value == 1.0


def nearest(times, t):
    i = bisect.bisect_right(times, t)
    before, after = (times[i - 1] if i else None), (times[i] if i < len(times) else None)
    if before is None or (after is not None and after - t < t - before):
        return after
    return before


@pytest.mark.parametrize("slot", ["1 day", "1 hour", "1 minute"])
def test_equals_brute_force_for_any_slot(spark, slot):
    rnd = random.Random(11)
    start = dt.datetime(2025, 1, 1)
    gaps = [0, 60, 900, 900, 3600, 86400, 400000]
    t, times = start, []
    for _ in range(300):
        t += dt.timedelta(seconds=rnd.choice(gaps) + rnd.randrange(50))
        times.append(t)
    times = sorted(set(times))
    obs = raw_rows(spark, [(str(x), i, None) for i, x in enumerate(times)])
    span = int((times[-1] - start).total_seconds())
    asked = [start + dt.timedelta(seconds=rnd.randrange(-100000, span + 100000)) for _ in range(400)]
    asked += times[::7] + [a + (b - a) / 2 for a, b in zip(times, times[1:])][::5]
    got = nearest_observation(probes(spark, [str(a) for a in asked]), obs, slot).collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.obs_ts == nearest(times, asked[r.id]), asked[r.id]
