"""Records and nearest observations of a stored series, by way of its daily state.

The state has the extremes of every series and day and knows which days have readings.
It names the days that can hold an answer, for any number of series, and only the
folders of those days are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.operators.asof import nearest_observation
from gaugeworks.operators.records import records
from gaugeworks.plans.series_store import raw_table, read_partials
from gaugeworks.schema import KEYS
from gaugeworks.sinks import versions
from gaugeworks.sinks.versions import Version

DAY = [*KEYS, "date"]


def days_of(spark: SparkSession, root: str, days: DataFrame, version: Version) -> DataFrame:
    """Stored readings of the series and days in ``days``; a name per folder of them reaches the driver."""
    folders = versions.touched(days.withColumn("ts", F.col("date").cast("timestamp_ntz")), raw_table(), version.depths("raw"))
    rows = versions.read(spark, root, "raw", raw_table(), version, folders)
    return rows.withColumn("date", F.to_date("ts")).join(days, DAY, "left_semi").drop("date")


def record_days(partials: DataFrame) -> DataFrame:
    """The first day of each series that holds its lowest, and the first that holds its highest value."""
    ends = partials.groupBy(*KEYS).agg(F.min("min").alias("low"), F.max("max").alias("high"))
    at = partials.join(ends, KEYS).filter((F.col("min") == F.col("low")) | (F.col("max") == F.col("high")))
    first = at.groupBy(*KEYS).agg(F.min(F.when(F.col("min") == F.col("low"), F.col("date"))).alias("low_day"),
                                  F.min(F.when(F.col("max") == F.col("high"), F.col("date"))).alias("high_day"))
    return first.select(*KEYS, F.explode(F.array_distinct(F.array("low_day", "high_day"))).alias("date"))


def stored_records(spark: SparkSession, root: str, scale: int | None = None, version: Version | None = None) -> DataFrame:
    """A5 of a stored series; equal to ``records`` of all its readings."""
    version = version or versions.latest(spark, root)
    return records(days_of(spark, root, record_days(read_partials(spark, root, scale, version)), version))


def neighbour_days(asked: DataFrame, partials: DataFrame) -> DataFrame:
    """For each asked day of a series: itself, and the nearest days before and after it that have a value.

    One row per series and day goes through the windows.
    """
    has = partials.filter("n_values > 0").select(*DAY, F.lit(1).alias("has"), F.lit(0).alias("asked"))
    both = has.unionByName(asked.select(*DAY, F.lit(0).alias("has"), F.lit(1).alias("asked"))).groupBy(*DAY).agg(
        F.max("has").alias("has"), F.max("asked").alias("asked"))
    own = F.when(F.col("has") == 1, F.col("date"))
    by_day = Window.partitionBy(*KEYS).orderBy("date")
    placed = both.select(*DAY, "asked", own.alias("own"),
                         F.max(own).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                         F.min(own).over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    return (placed.filter("asked = 1").select(*KEYS, F.explode(F.array_compact(F.array("own", "before", "after"))).alias("date")).distinct())


def stored_nearest(spark: SparkSession, root: str, probes: DataFrame, scale: int | None = None, slot: str = "1 hour",
                   version: Version | None = None) -> DataFrame:
    """J2 against a stored series; equal to ``nearest_observation`` against all its readings."""
    version = version or versions.latest(spark, root)
    asked = probes.select(*KEYS, F.to_date("probe_ts").alias("date")).filter("date is not null")
    days = neighbour_days(asked, read_partials(spark, root, scale, version))
    return nearest_observation(probes, days_of(spark, root, days, version), slot)
