"""Completeness of stored series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import day_of
from gaugeworks.schema import KEYS


def completeness(raw: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """Rows, extent and days covered per series, with the extent of the daily table.

    ``days_covered`` counts whole 24-hour periods between the first and the last
    reading, plus one; ``distinct_dates`` counts calendar days with a row. Days are
    aggregated first, so no distinct aggregate is needed.
    """
    per_day = raw.groupBy(*KEYS, day_of("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    micros = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    out = (
        per_day.groupBy(*KEYS)
        .agg(F.sum("n").alias("n_rows"), F.min("lo").alias("first_ts"),
             F.max("hi").alias("last_ts"), F.count("date").alias("distinct_dates"))
        .withColumn("days_covered", F.lit(1) + F.floor(micros / F.lit(86_400_000_000)))
    )
    out = out.withColumn("days_covered", F.col("days_covered").cast("bigint"))
    if daily is None:
        return out
    by_day = daily.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"))
    return out.join(by_day, KEYS, "full_outer")
