"""Filters, ranges, latest rows and extents of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.operators.ranges import as_date, as_ts, ts_between
from gaugeworks.operators.rollup import hourly_mean
from gaugeworks.schema import KEYS

RESOLUTIONS = ["raw", "hourly", "daily"]


def split_rejects(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable timestamp, and all rows that carry a reject reason.

    A row with a bad value but a good timestamp is in both: it stays in the
    series with a null value because its status still counts.
    """
    good = df.filter(F.col("ts").isNotNull())
    rejects = df.filter(F.col(reason).isNotNull())
    return good, rejects


def with_value(df: DataFrame) -> DataFrame:
    """P2."""
    return df.filter(F.col("value").isNotNull())


def since_date(df: DataFrame, start: str) -> DataFrame:
    """Rows dated ``start`` or later, stated on ``ts`` so that it reaches the scan."""
    return ts_between(df, start=as_date(start))


def raw_range(raw: DataFrame, start, end, end_inclusive_day: bool = False,
              ordered: bool = False) -> DataFrame:
    """Points of the raw series in a range; T1 when ``ordered``."""
    rows = with_value(ts_between(raw, start, end, end_inclusive_day))
    if ordered:
        rows = rows.orderBy(*KEYS, "ts")
    return rows.select(*KEYS, F.col("ts").cast("string").alias("x"), F.col("value").alias("y"))


def daily_range(daily: DataFrame, start, end, ordered: bool = False) -> DataFrame:
    """P5: points of the daily mean series, both ends included; T1 when ``ordered``."""
    rows = daily.filter((F.col("date") >= as_date(start)) & (F.col("date") <= as_date(end))
                        & F.col("mean").isNotNull())
    if ordered:
        rows = rows.orderBy(*KEYS, "date")
    return rows.select(*KEYS, F.col("date").cast("string").alias("x"), F.col("mean").alias("y"))


def series(raw: DataFrame, daily: DataFrame, parameter: str, start, end,
           resolution: str = "daily", end_inclusive_day: bool = False, scale: int | None = None,
           ordered: bool = False) -> DataFrame:
    """One parameter in a range at the resolution asked for, from the smallest table that has it.

    However long the range, the resolution is never replaced by a coarser one.
    """
    if resolution not in RESOLUTIONS:
        raise ValueError(f"resolution must be one of {RESOLUTIONS}, not {resolution!r}")
    if resolution == "daily":
        return daily_range(daily.filter(F.col("parameter") == parameter), start, end, ordered)
    raw = raw.filter(F.col("parameter") == parameter)
    if resolution == "raw":
        return raw_range(raw, start, end, end_inclusive_day, ordered)
    points = hourly_mean(raw, start, end, end_inclusive_day, scale)
    return points.orderBy(*KEYS, "x") if ordered else points


def visible(points: DataFrame, x0, x1, x: str = "ts") -> DataFrame:
    """Points inside a selected interval."""
    return points.filter((F.col(x) >= as_ts(x0)) & (F.col(x) <= as_ts(x1)))


def value_domain(points: DataFrame, x: str = "ts", y: str = "value") -> DataFrame:
    """Padded value domain, time extent and span in days per series."""
    span = F.unix_micros(F.col("x_max").cast("timestamp")) - F.unix_micros(F.col("x_min").cast("timestamp"))
    return (
        points.filter(F.col(y).isNotNull())
        .groupBy(*KEYS)
        .agg((F.min(y) * 0.95).alias("y_low"), (F.max(y) * 1.05).alias("y_high"),
             F.min(x).alias("x_min"), F.max(x).alias("x_max"))
        .withColumn("span_days", span / F.lit(86_400_000_000.0))
    )


def visible_domain(points: DataFrame, x0=None, x1=None, x: str = "ts", y: str = "value") -> DataFrame:
    """Value domain ``0 .. max`` of the selected interval per series.

    A series with nothing to show, or a maximum of 0, gets 1. Without an interval
    the whole series counts. The interval is applied inside the aggregate so that
    every series of the input has a row.
    """
    inside = F.lit(True)
    if x0 is not None:
        inside = inside & (F.col(x) >= as_ts(x0))
    if x1 is not None:
        inside = inside & (F.col(x) <= as_ts(x1))
    top = F.max(F.when(inside, F.col(y)))
    return points.groupBy(*KEYS).agg(
        F.lit(0.0).alias("y_low"),
        F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0)).alias("y_high"))


def latest_daily(daily: DataFrame) -> DataFrame:
    """Last daily row with a mean, per series."""
    row = F.struct("date", "mean", "min", "max", "count", "status_mode")
    return (
        daily.filter(F.col("mean").isNotNull())
        .groupBy(*KEYS).agg(F.max_by(row, "date").alias("r"))
        .select(*KEYS, "r.*")
    )


def newest(live: DataFrame, n: int = 10, ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """T4: the ``n`` newest readings per series, ranked from 1.

    Among equal instants the larger ``tie`` columns come first, by default all other
    columns in their order, so the result does not depend on how rows are dealt out.

    Spark limits each group before the shuffle, so a large series sends at most
    ``n`` rows per task.
    """
    order = [F.col(ts).desc(), *[F.col(c).desc() for c in (tie if tie is not None else [c for c in live.columns if c not in (*KEYS, ts)])]]
    ranked = live.withColumn("rank", F.row_number().over(W.partitionBy(*KEYS).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def since(raw: DataFrame, threshold) -> DataFrame:
    """Rows from ``threshold`` on and the value at the latest timestamp, per series.

    The latest instant comes from a fixed-width hash aggregate; only its rows are looked at
    again, of which the largest value counts.
    """
    rows = ts_between(raw, start=threshold)
    last = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("latest_ts"))
    at_last = rows.select(*KEYS, F.col("ts").alias("latest_ts"), "value")
    return (
        at_last.join(last, [*KEYS, "latest_ts"])
        .groupBy(*KEYS, "n_rows", "latest_ts").agg(F.max("value").alias("latest_value"))
        .select(*KEYS, "n_rows", "latest_ts", "latest_value")
    )
