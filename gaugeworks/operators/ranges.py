"""Time bounds that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_ts(bound) -> Column:
    """A bound given as text, date, datetime or column, as a naive timestamp.

    Literals fold to constants and are pushed to the scan.
    """
    return (bound if isinstance(bound, Column) else F.lit(str(bound))).cast("timestamp_ntz")


def as_date(bound) -> Column:
    return (bound if isinstance(bound, Column) else F.lit(str(bound))).cast("date")


def _periods_between(df: DataFrame, start, end) -> DataFrame:
    """Prune the year and month folders of a stored raw series."""
    if not {"year", "month"} <= set(df.columns):
        return df
    period = F.col("year") * 100 + F.col("month")
    if start is not None:
        first = as_ts(start)
        df = df.filter(period >= F.year(first) * 100 + F.month(first))
    if end is not None:
        last = as_ts(end)
        df = df.filter(period <= F.year(last) * 100 + F.month(last))
    return df


def ts_between(df: DataFrame, start=None, end=None, end_inclusive_day: bool = False) -> DataFrame:
    """Rows with ``start <= ts <= end``.

    A bare end date means its midnight; ``end_inclusive_day`` keeps the whole day.
    """
    df = _periods_between(df, start, end)
    if start is not None:
        df = df.filter(F.col("ts") >= as_ts(start))
    if end is not None and end_inclusive_day:
        df = df.filter(F.col("ts") < F.date_add(as_date(end), 1).cast("timestamp_ntz"))
    elif end is not None:
        df = df.filter(F.col("ts") <= as_ts(end))
    return df


def in_folders(stored: DataFrame, touched: DataFrame, folders: list[str]) -> DataFrame:
    """Rows of the stored folders that ``touched`` names; no other folder is opened.

    ``touched`` has one row per folder, so its size is bounded by the folders of the
    table and it may be broadcast. Catalyst prunes at run time only by a side that it
    takes for selective; the comparison with 0 marks it as such.
    """
    return stored.join(F.broadcast(touched.filter(F.col("year") > 0)), folders, "left_semi")
