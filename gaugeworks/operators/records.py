"""Extreme values and their surroundings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import day_of
from gaugeworks.operators.ranges import in_folders
from gaugeworks.schema import HISTORY_START, KEYS


def _side(name: str) -> list[Column]:
    r = F.col(name)
    return [r["ts"].alias(f"{name}_ts"), r["value"].alias(f"{name}_value"),
            F.coalesce(r["status"], F.lit("")).alias(f"{name}_status")]


def records(raw: DataFrame) -> DataFrame:
    """A5: lowest and highest reading of each series, the earliest on ties.

    The extremes come from a fixed-width hash aggregate, which needs no sort; the tie
    rule looks only at the rows that hold one.
    """
    valued = raw.filter(F.col("value").isNotNull())
    ends = valued.groupBy(*KEYS).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    at_ends = (valued.select(*KEYS, "ts", "value", "status").join(ends, KEYS)
               .filter((F.col("value") == F.col("low")) | (F.col("value") == F.col("high"))))
    row = F.struct("ts", "value", "status")

    def earliest(end: str) -> Column:
        return F.min_by(row, F.when(F.col("value") == F.col(end), F.struct("ts", "status")))

    return (at_ends.groupBy(*KEYS).agg(earliest("low").alias("min"), earliest("high").alias("max"))
            .select(*KEYS, *_side("min"), *_side("max")))


def records_via_daily(raw: DataFrame, daily: DataFrame) -> DataFrame:
    """A5 with the daily table as an index.

    The earliest day whose ``min`` (``max``) equals the record holds the record
    reading, so only the folders of those days are read. Equal to ``records`` when
    ``daily`` is the rollup of ``raw``. It pays for a handful of series; the record
    days of very many series lie in all folders, and ``records`` needs one pass.
    """
    days = daily.groupBy(*KEYS).agg(
        F.min_by("date", F.struct("min", "date")).alias("low_day"),
        F.min_by("date", F.struct(-F.col("max"), "date")).alias("high_day"))
    wanted = days.select(*KEYS, F.explode(F.array_distinct(F.array("low_day", "high_day"))).alias("day"))
    if {"year", "month"} <= set(raw.columns):
        folders = ["parameter", "year", "month"]  # the days of many stations, so no bucket
        touched = wanted.select("parameter", F.year("day").alias("year"), F.month("day").alias("month"))
        raw = in_folders(raw, touched.distinct(), folders)
    return records(raw.withColumn("day", day_of("ts")).join(wanted, [*KEYS, "day"], "left_semi"))


def record_rows(found: DataFrame) -> DataFrame:
    """One row per series and extreme (``kind`` is ``min`` or ``max``)."""
    sides = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"{k}_ts").alias("ts"),
                 F.col(f"{k}_value").alias("value"), F.col(f"{k}_status").alias("status"))
        for k in ("min", "max")])
    return found.select(*KEYS, F.inline(sides))


def record_context(found: DataFrame, daily: DataFrame, days: int = 30,
                   as_of: dt.date | str | None = None) -> DataFrame:
    """Daily means from ``days`` before to ``days`` after each record.

    A record without a usable timestamp gets the whole history up to ``as_of``, by default
    the latest date of its series.
    ``found`` has two rows per series, so the interval is a residual of the key
    join and a series is never multiplied by more than two.
    """
    day = day_of("ts")
    if as_of is None:
        found = found.join(daily.groupBy(*KEYS).agg(F.max("date").alias("as_of")), KEYS, "left")
    last = F.col("as_of") if as_of is None else F.lit(str(as_of)).cast("date")
    ranges = found.select(
        *KEYS, "kind", F.col("ts").alias("record_ts"),
        F.coalesce(F.date_sub(day, days), F.lit(HISTORY_START).cast("date")).alias("start"),
        F.coalesce(F.date_add(day, days), last).alias("end"))
    means = daily.filter(F.col("mean").isNotNull()).select(*KEYS, "date", "mean")
    return (
        means.join(ranges, KEYS)
        .filter(F.col("date").between(F.col("start"), F.col("end")))
        .select(*KEYS, "kind", "record_ts", "date", "mean")
    )
