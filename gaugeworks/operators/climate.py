"""Seasonal percentile bands of daily means.

The input has one row per series and day, so a group holds at most
``(2 * half_width + 1) * years`` values and exact percentiles stay small
however many rows lie behind the daily table.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import doy
from gaugeworks.schema import KEYS

# Fixed percentile levels of the band.
LEVELS = {"p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}
LONGEST_YEAR = 366


def _year_length(date: Column) -> Column:
    return doy(F.make_date(F.year(date), F.lit(12), F.lit(31)))


def _distance(date: Column, target: Column, target_year_length: Column, wrap: bool) -> Column:
    """Days between two days of the year; with ``wrap`` also across New Year."""
    direct = F.abs(doy(date) - target)
    if not wrap:
        return direct
    before_new_year = _year_length(date) - doy(date) + target
    after_new_year = target_year_length - target + doy(date)
    return F.least(direct, before_new_year, after_new_year)


def _band(values: Column, accuracy: int | None) -> Column:
    levels = list(LEVELS.values())
    if accuracy is not None:
        return F.percentile_approx(values, levels, accuracy)
    return F.percentile(values, levels)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col("band")[i].alias(name) for i, name in enumerate(LEVELS)])


def seasonal_band(daily: DataFrame, as_of: dt.date | str | None = None, half_width: int = 7,
                  wrap: bool = False, accuracy: int | None = None) -> DataFrame:
    """A4: percentiles of the daily means around one day of the year, per series.

    ``as_of`` defaults to the latest date of each series (J1). A series without a
    day in the window gets nulls.
    """
    daily = daily.filter(F.col("mean").isNotNull())
    if as_of is None:
        last = daily.groupBy(*KEYS).agg(F.max("date").alias("as_of"))
        daily = daily.join(last, KEYS)
        target, length = doy("as_of"), _year_length(F.col("as_of"))
    else:
        day = dt.date.fromisoformat(str(as_of)[:10])
        target = F.lit(day.timetuple().tm_yday)
        length = F.lit(366 if calendar.isleap(day.year) else 365)
    near = _distance(F.col("date"), target, length, wrap) <= half_width
    bands = daily.groupBy(*KEYS).agg(_band(F.when(near, F.col("mean")), accuracy).alias("band"))
    return _spread(bands, *KEYS)


def seasonal_band_all(daily: DataFrame, half_width: int = 7, wrap: bool = False,
                      accuracy: int | None = None) -> DataFrame:
    """The band of every day of the year in one pass.

    Each daily row is sent to the target days it belongs to, at most
    ``2 * half_width + 1`` of them and a leap day more when wrapping.
    """
    day = doy("date")
    targets = F.sequence(F.greatest(F.lit(1), day - half_width),
                         F.least(F.lit(LONGEST_YEAR), day + half_width))
    if wrap:
        none = F.array().cast("array<int>")
        reach = F.lit(half_width) - (_year_length(F.col("date")) - day)
        next_year = F.when(reach >= 1, F.sequence(F.lit(1), reach)).otherwise(none)
        last_year = (F.when(day <= half_width,
                            F.sequence(F.lit(LONGEST_YEAR - 1 - half_width) + day, F.lit(LONGEST_YEAR)))
                     .otherwise(none))
        targets = F.array_union(targets, F.array_union(next_year, last_year))
    bands = (
        daily.filter(F.col("mean").isNotNull())
        .select(*KEYS, "mean", F.explode(targets).alias("target_doy"))
        .groupBy(*KEYS, "target_doy")
        .agg(_band(F.col("mean"), accuracy).alias("band"))
    )
    return _spread(bands, *KEYS, "target_doy")
