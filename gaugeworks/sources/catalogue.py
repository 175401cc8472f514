"""Station catalogues as nested JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.schema import CATALOGUE

NOT_AVAILABLE = "N/A"


def read_catalogue(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Catalogue entries, one JSON object per line."""
    return spark.read.schema(CATALOGUE).json(path)


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NOT_AVAILABLE))


def station_info(stations: DataFrame) -> DataFrame:
    """Station attributes as text, ``N/A`` where absent."""
    flat = ["number", "shortname", "longname", "agency", "km", "latitude", "longitude"]
    return stations.select("uuid", *[_text(c).alias(c) for c in flat], _text("water.longname").alias("water"))


def flatten_catalogue(stations: DataFrame) -> DataFrame:
    """One row per station, series and characteristic value.

    Stations without series and series without values keep one row.
    """
    series = stations.select(
        "uuid", _text("longname").alias("station"), _text("water.longname").alias("water"),
        F.posexplode_outer("timeseries").alias("series_no", "s"))
    values = series.select(
        "uuid", "station", "water", "series_no", _text("s.longname").alias("series"),
        _text("s.shortname").alias("series_short"), _text("s.unit").alias("unit"),
        _text("s.equidistance").alias("interval_minutes"),
        F.posexplode_outer("s.characteristicValues").alias("value_no", "v"))
    has_value = F.col("value_no").isNotNull()
    return values.select(
        "uuid", "station", "water", "series_no", "series", "series_short", "unit", "interval_minutes",
        "value_no",
        *[F.when(has_value, _text(f"v.{c}")).alias(f"value_{c}") for c in ("shortname", "value", "unit")])


def union_catalogues(*searches: DataFrame) -> DataFrame:
    """Results of several searches, one entry per ``uuid``; the last search wins."""
    names = [c for c in searches[0].columns if c != "uuid"]
    numbered = [s.select("uuid", F.struct(*names).alias("entry"), F.lit(i).alias("search_no"))
                for i, s in enumerate(searches)]
    return (reduce(DataFrame.unionByName, numbered)
            .groupBy("uuid").agg(F.max_by("entry", "search_no").alias("entry"))
            .select("uuid", "entry.*"))
