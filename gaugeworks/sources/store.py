"""Parquet scans of raw and daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.scalars import mixed_ts
from gaugeworks.operators.ranges import as_date, ts_between
from gaugeworks.schema import DAILY, RAW


def normalise_raw(df: DataFrame) -> DataFrame:
    """One schema for raw series, whether ``ts`` is stored as a timestamp or as text."""
    if isinstance(df.schema["ts"].dataType, T.StringType):
        df = df.withColumn("ts", mixed_ts("ts"))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields])


def normalise_daily(df: DataFrame) -> DataFrame:
    """One schema for daily series; text dates become dates and the count a long."""
    if isinstance(df.schema["date"].dataType, T.StringType):
        df = df.withColumn("date", F.col("date").try_cast("date"))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DAILY.fields])


def stored_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A stored series; folder names of parameters are text even where they look like numbers."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    if isinstance(df.schema["parameter"].dataType, T.StringType):
        return df
    text = [T.StructField(f.name, T.StringType()) if f.name == "parameter" else f for f in df.schema.fields]
    return spark.read.schema(T.StructType(text)).parquet(*paths)


def _series_filter(df: DataFrame, parameter, stations) -> DataFrame:
    if parameter is not None:
        df = df.filter(F.col("parameter") == parameter)
    if stations is not None:
        df = df.filter(F.col("station_id").isin(list(stations)))
    return df


def read_raw(spark: SparkSession, path: str | list[str], parameter: str | None = None,
             stations: list[int] | None = None, start=None, end=None,
             end_inclusive_day: bool = False) -> DataFrame:
    """Raw series; parameter and range prune folders, all predicates reach the files."""
    df = _series_filter(stored_table(spark, path), parameter, stations)
    if isinstance(df.schema["ts"].dataType, T.StringType):
        return ts_between(normalise_raw(df), start, end, end_inclusive_day)
    return normalise_raw(ts_between(df, start, end, end_inclusive_day))


def read_daily(spark: SparkSession, path: str | list[str], parameter: str | None = None,
               stations: list[int] | None = None, start=None, end=None) -> DataFrame:
    """Daily series."""
    df = _series_filter(stored_table(spark, path), parameter, stations)
    stored_by_year = "year" in df.columns
    if start is not None:
        first = as_date(start)
        df = df.filter(F.col("year") >= F.year(first)) if stored_by_year else df
        df = df.filter(F.col("date").try_cast("date") >= first)
    if end is not None:
        last = as_date(end)
        df = df.filter(F.col("year") <= F.year(last)) if stored_by_year else df
        df = df.filter(F.col("date").try_cast("date") <= last)
    return normalise_daily(df)
