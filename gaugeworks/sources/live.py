"""Live readings as JSON lines (S7, S8, P6, ST1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.plans import evaluated_once
from gaugeworks.functions.scalars import int_or_null, mixed_ts
from gaugeworks.schema import KEYS, LIVE, STATUS_RAW, WATER_LEVEL, WATER_TEMPERATURE

# Fixed names of the live files: <kind>_<date>.jsonl, or folders kind=<kind>/day=<date>.
LEVEL_KIND = "water_level"
TEMPERATURE_KIND = "water_temperature"
DATE_IN_PATH = r"(\d{4}-\d{2}-\d{2})(\.jsonl?|/[^/]*)$"
KIND_IN_PATH = r"(water_level|water_temperature)(_\d{4}-\d{2}-\d{2}\.jsonl?|/day=[^/]*/[^/]*)$"

# How far a reading may lie ahead of its fetch; clocks of both sides may be in other zones.
AHEAD = "1 DAY"

CORRUPT = "_corrupt_record"
LIVE_WITH_CORRUPT = T.StructType([*LIVE.fields, T.StructField(CORRUPT, T.StringType())])


def kind_of_path(path: Column) -> Column:
    return F.regexp_extract(path, KIND_IN_PATH, 1)


def json_reader_options() -> dict[str, str]:
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "recursiveFileLookup": "true"}


def type_live(lines: DataFrame) -> DataFrame:
    """Typed columns of live readings with ``kind``, and a reject reason where one applies.

    The file's kind names the parameter and the value field; without a kind the
    field that is present does. A reading from the future is a wrong clock and would
    hold back every other station of a stream, so it is rejected.
    """
    kind = F.nullif("kind", F.lit(""))
    is_level = F.coalesce(kind == LEVEL_KIND, F.col("value_cm").isNotNull())
    parameter = F.when(is_level, WATER_LEVEL).otherwise(WATER_TEMPERATURE)
    value = F.when(is_level, F.col("value_cm")).otherwise(F.col("value_celsius"))
    typed = lines.withColumns({
        "station_key": int_or_null("station_id"),
        "parameter": parameter,
        "ts": mixed_ts("timestamp"),
        "value": value,
        "fetched_ts": mixed_ts("fetched_at"),
    }).withColumn(
        "reject_reason",
        F.when(F.col(CORRUPT).isNotNull(), "malformed")
        .when(F.col("station_key").isNull(), "no_station")
        .when(F.col("ts").isNull(), "bad_ts")
        .when(F.col("ts") > F.col("fetched_ts") + F.expr(f"INTERVAL {AHEAD}"), "future_ts")
        .when(F.col("value").isNull(), "no_value"))
    return evaluated_once(typed.drop("fetched_ts"))


def left_out_files(spark: SparkSession, path: str | list[str], as_of: dt.date | str, days_back: int) -> DataFrame:
    """Files that ``read_live`` leaves out, with their date; only their names are read."""
    last = F.lit(str(as_of)).cast("date")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    date = F.regexp_extract("path", DATE_IN_PATH, 1).try_cast("date")
    return files.select("path", date.alias("date")).filter(
        F.col("date").isNull() | (F.col("date") <= F.date_sub(last, days_back)) | (F.col("date") > last))


def read_live(spark: SparkSession, path: str | list[str], as_of: dt.date | str,
              days_back: int) -> tuple[DataFrame, DataFrame]:
    """Readings of the last ``days_back`` daily files, ``as_of`` included, and the rejects.

    The date is taken from the file name, so older files are not opened;
    ``left_out_files`` lists them.
    """
    last = F.lit(str(as_of)).cast("date")
    file_path = F.col("_metadata.file_path")
    file_date = F.regexp_extract(file_path, DATE_IN_PATH, 1).try_cast("date")
    lines = (
        spark.read.schema(LIVE_WITH_CORRUPT).options(**json_reader_options()).json(path)
        .filter((file_date > F.date_sub(last, days_back)) & (file_date <= last))
        .withColumns({"source_file": F.col("_metadata.file_name"), "kind": kind_of_path(file_path)})
    )
    typed = type_live(lines)
    good = typed.filter(F.col("reject_reason").isNull())
    rejects = typed.filter(F.col("reject_reason").isNotNull())
    return good, rejects.select("source_file", CORRUPT, "timestamp", "station_id", "reject_reason")


def live_to_raw(live: DataFrame) -> DataFrame:
    """Live readings in the raw schema, with the columns that order them for a merge."""
    extra = [c for c in ("fetched_at", "source_file") if c in live.columns]
    return live.select(F.col("station_key").alias("station_id"), "parameter", "ts",
                       F.col("value").cast("double").alias("value"),
                       F.lit(STATUS_RAW).alias("status"), *extra)


def latest_live(readings: DataFrame) -> DataFrame:
    """The latest reading per series by (ts, fetched_at).

    The latest instant comes from a fixed-width hash aggregate; the order among the
    readings of one instant looks at those only.
    """
    last = readings.groupBy(*KEYS).agg(F.max("ts").alias("ts"))
    order = [*[c for c in ("fetched_at",) if c in readings.columns], "value", "status"]
    return (readings.join(last, [*KEYS, "ts"]).groupBy(*KEYS, "ts")
            .agg(F.max_by(F.struct("value", "status"), F.struct(*order)).alias("r"))
            .select(*KEYS, "ts", "r.*"))
