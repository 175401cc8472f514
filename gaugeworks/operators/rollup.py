"""Daily and hourly aggregates (A1, A2, A3, A10).

The daily rollup goes through one intermediate grain, ``(station, parameter,
date, status)``. Its measures are all fixed-width, so the scan feeds a hash
aggregate that combines map-side: a series, or a day, that holds most of the
rows still sends one row per task to the shuffle. The same grain is what an
incremental refresh stores and merges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import day_of, hour_label, hour_of
from gaugeworks.operators.ranges import ts_between
from gaugeworks.schema import KEYS

PARTIAL_KEYS = [*KEYS, "date", "status"]


def summand(value: Column, scale: int | None) -> Column:
    """The value to be summed.

    A double sum depends on the order of the tasks. Readings have a fixed number
    of decimals; naming it in ``scale`` makes the sum exact and repeatable.
    """
    return value if scale is None else value.cast(f"decimal(18,{scale})")


def rollup_partials(raw: DataFrame, scale: int | None = None) -> DataFrame:
    """A10: mergeable state per (station, parameter, date, status)."""
    return (
        raw.groupBy(*KEYS, day_of("ts").alias("date"), "status")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("value").alias("n_values"),
            F.sum(summand(F.col("value"), scale)).alias("total"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.min("ts").alias("first_ts"),
        )
    )


def merge_partials(*partials: DataFrame) -> DataFrame:
    """A10: fold any number of partial tables into one."""
    total_type = partials[0].schema["total"].dataType
    return (
        reduce(DataFrame.unionByName, partials)
        .groupBy(*PARTIAL_KEYS)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.sum("total").cast(total_type).alias("total"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.min("first_ts").alias("first_ts"),
        )
    )


def daily_from_partials(partials: DataFrame) -> DataFrame:
    """A1 and A2 from partial state; days without a value are left out.

    The mode counts every row of the day that has a status, and a tie goes to the
    status seen first.
    """
    rank = F.when(F.col("status").isNotNull(), F.struct(-F.col("n_rows"), "first_ts", "status"))
    return (
        partials.groupBy(*KEYS, "date")
        .agg(
            F.sum("n_values").alias("count"),
            F.sum("total").cast("double").alias("total"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.min_by("status", rank).alias("status_mode"),
        )
        .filter(F.col("count") > 0)
        .select(*KEYS, "date", "count", (F.col("total") / F.col("count")).alias("mean"),
                "min", "max", "status_mode")
    )


def daily_rollup(raw: DataFrame, scale: int | None = None) -> DataFrame:
    """A1: count, mean, min, max and status mode per (station, parameter, date)."""
    return daily_from_partials(rollup_partials(raw, scale))


def status_mode(raw: DataFrame) -> DataFrame:
    """A2 on its own: most frequent status per day, also for days without values."""
    counts = (
        raw.filter(F.col("status").isNotNull())
        .groupBy(*KEYS, day_of("ts").alias("date"), "status")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    )
    return counts.groupBy(*KEYS, "date").agg(
        F.min_by("status", F.struct(-F.col("n"), "first_ts", "status")).alias("status_mode"))


def hourly_mean(raw: DataFrame, start=None, end=None, end_inclusive_day: bool = False,
                scale: int | None = None) -> DataFrame:
    """A3: mean value per hour, labelled ``yyyy-MM-dd HH:00:00``."""
    return (
        ts_between(raw, start, end, end_inclusive_day)
        .filter(F.col("value").isNotNull())
        .groupBy(*KEYS, hour_of("ts").alias("hour"))
        .agg(F.count("value").alias("n"),
             F.sum(summand(F.col("value"), scale)).cast("double").alias("total"))
        .select(*KEYS, hour_label("hour").alias("x"), (F.col("total") / F.col("n")).alias("y"))
    )
