"""Schemas and fixed domain values shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["station_id", "parameter"]

# Fixed values of the export and live formats.
WATER_LEVEL = "water_level_cm"
WATER_TEMPERATURE = "water_temperature_c"
UNKNOWN_PARAMETER = "unknown"
UNITS = {WATER_LEVEL: "cm", WATER_TEMPERATURE: "°C"}
STATUS_CHECKED = "Geprueft"
STATUS_RAW = "Rohdaten"
MISSING_TOKENS = ["--", "", "n/a", "N/A"]
HISTORY_START = "1973-01-01"
LOCAL_ZONE = "Europe/Berlin"

RAW = T.StructType([
    T.StructField("station_id", T.IntegerType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

DAILY = T.StructType([
    T.StructField("station_id", T.IntegerType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("count", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("status_mode", T.StringType()),
])

STATION_META = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("station_id", T.IntegerType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("river", T.StringType()),
    T.StructField("time_ref", T.StringType()),
    T.StructField("easting", T.IntegerType()),
    T.StructField("northing", T.IntegerType()),
    T.StructField("coord_ref", T.StringType()),
    T.StructField("gauge_zero", T.StringType()),
    T.StructField("raw_meta", T.MapType(T.StringType(), T.StringType())),
])

# Level values arrive as JSON integers and temperatures as floats; both are
# read as double because that is the type of the raw series.
LIVE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("timestamp_unix", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()),
    T.StructField("value_cm", T.DoubleType()),
    T.StructField("value_celsius", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
])

CHARACTERISTIC_VALUE = T.StructType([
    T.StructField("shortname", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
])

CATALOGUE = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("number", T.StringType()),
    T.StructField("shortname", T.StringType()),
    T.StructField("longname", T.StringType()),
    T.StructField("agency", T.StringType()),
    T.StructField("km", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("water", T.StructType([T.StructField("longname", T.StringType())])),
    T.StructField("timeseries", T.ArrayType(T.StructType([
        T.StructField("longname", T.StringType()),
        T.StructField("shortname", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("equidistance", T.IntegerType()),
        T.StructField("characteristicValues", T.ArrayType(CHARACTERISTIC_VALUE)),
    ]))),
])
