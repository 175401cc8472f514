"""Scalar column expressions.

Timestamps are naive (``TIMESTAMP_NTZ``). Where a function exists in a form
that does not consult the session time zone, that form is used.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.schema import (
    HISTORY_START, LOCAL_ZONE, UNITS, UNKNOWN_PARAMETER, WATER_LEVEL, WATER_TEMPERATURE,
)

ColumnLike = Column | str

# Fixed formats of the inputs.
MINUTE_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"
GERMAN_TEXT = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}) (\d{1,2}):(\d{1,2})$"
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_TEXT = r"^[+-]?\d+$"
EPOCH_MILLIS_TEXT = r"^\d{1,15}$"
CALENDAR_TEXT = r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?)\d*$"
ZONED_TEXT = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)\d*(Z|[+-]\d{2}:?\d{2})$"
PRESETS = ["today", "week", "month", "1y", "5y", "all"]


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c: ColumnLike) -> Column:
    """``yyyy-MM-dd HH:mm`` to a naive timestamp, null when invalid."""
    c = _col(c)
    return F.when(c.rlike(MINUTE_TEXT), F.concat(c, F.lit(":00")).try_cast("timestamp_ntz"))


def parse_german_ts(c: ColumnLike) -> Column:
    """``dd.MM.yyyy HH:mm`` to a naive timestamp, null when invalid."""
    c = F.trim(_col(c))
    iso = F.regexp_replace(c, GERMAN_TEXT, r"$3-$2-$1 $4:$5:00")
    return F.when(c.rlike(GERMAN_TEXT), iso.try_cast("timestamp_ntz"))


def decimal_comma(c: ColumnLike) -> Column:
    """number with decimal comma or point to double, null when not a plain number."""
    text = F.replace(F.trim(_col(c)), F.lit(","), F.lit("."))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def clean_text(c: ColumnLike) -> Column:
    """trim, drop the enclosing quotes, empty text to null."""
    bare = F.trim(F.regexp_replace(F.trim(_col(c)), '^"|"$', ""))
    return F.nullif(bare, F.lit(""))


def fold_status(c: ColumnLike) -> Column:
    """one spelling per quality status."""
    return F.replace(clean_text(c), F.lit("Geprüft"), F.lit("Geprueft"))


def meta_key(c: ColumnLike) -> Column:
    """preamble key without byte order mark, colons and outer blanks."""
    bare = F.trim(F.replace(_col(c), F.lit("﻿"), F.lit("")))
    return F.trim(F.regexp_replace(bare, "^:+|:+$", ""))


def int_or_null(c: ColumnLike) -> Column:
    """F7."""
    text = F.trim(_col(c))
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("int"))


def day_of(c: ColumnLike) -> Column:
    """F8."""
    return F.to_date(_col(c))


def hour_label(c: ColumnLike) -> Column:
    """``yyyy-MM-dd HH:00:00``."""
    return F.concat(F.substring(_col(c).cast("string"), 1, 13), F.lit(":00:00"))


def hour_of(c: ColumnLike) -> Column:
    """Start of the hour as a naive timestamp."""
    return F.window(_col(c), "1 hour").getField("start")


def doy(c: ColumnLike) -> Column:
    """F10."""
    return F.dayofyear(_col(c))


def live_time_parts(c: ColumnLike) -> dict[str, Column]:
    """ISO text, date text and time text of a live reading."""
    text = _col(c).cast("string")
    day, clock = F.substring(text, 1, 10), F.substring(text, 12, 8)
    return {"timestamp": F.concat(day, F.lit("T"), clock), "date": day, "time": clock}


def local_epoch(c: ColumnLike, zone: str = LOCAL_ZONE) -> Column:
    """Unix seconds of a naive wall-clock time in ``zone``."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(c))
    return F.unix_seconds(utc.cast("timestamp"))


def fixed(c: ColumnLike, digits: int = 1) -> Column:
    """F16: text with a fixed number of decimals, null for null."""
    c = _col(c)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def mixed_ts(c: ColumnLike) -> Column:
    """epoch milliseconds, ISO, minute, second or day text to one type.

    Text with ``Z`` or an offset is an instant and becomes wall-clock time in the session
    zone, as epochs do. Digits beyond microseconds are dropped. Null marks text in none
    of these forms; keep the text beside the result.
    """
    c = F.trim(_col(c))
    zone = F.regexp_replace(F.regexp_extract(c, ZONED_TEXT, 4), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    seconds = F.when(F.regexp_extract(c, ZONED_TEXT, 2) == "", ":00").otherwise("")
    zoned = F.when(c.rlike(ZONED_TEXT), F.concat(F.regexp_extract(c, ZONED_TEXT, 1), seconds, zone)).try_cast("timestamp")
    millis = F.timestamp_millis(F.when(c.rlike(EPOCH_MILLIS_TEXT), c).try_cast("bigint"))
    fine = c.rlike(CALENDAR_TEXT) & ~c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?\d+$")
    calendar = F.when(fine, F.regexp_extract(c, CALENDAR_TEXT, 1)).try_cast("timestamp_ntz")
    return F.coalesce(millis.cast("timestamp_ntz"), calendar, zoned.cast("timestamp_ntz"))


def relative_range(preset: str, as_of: dt.date | str | Column) -> tuple[Column, Column]:
    """start and end date of a preset, ending at ``as_of``.

    Literal dates fold to constants, so the bounds reach the scan.
    """
    end = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    starts = {
        "today": lambda: end,
        "week": lambda: F.date_sub(end, 7),
        "month": lambda: F.add_months(end, -1),
        "1y": lambda: F.add_months(end, -12),
        "5y": lambda: F.add_months(end, -60),
        "all": lambda: F.lit(HISTORY_START).cast("date"),
    }
    if preset not in starts:
        raise ValueError(f"preset must be one of {PRESETS}, not {preset!r}")
    return starts[preset](), end


def unit_of(c: ColumnLike) -> Column:
    """unit of a parameter key, empty when unknown."""
    c = _col(c)
    return (F.when(c == WATER_LEVEL, UNITS[WATER_LEVEL])
            .when(c == WATER_TEMPERATURE, UNITS[WATER_TEMPERATURE])
            .otherwise(""))


def with_unit(df: DataFrame) -> DataFrame:
    """F19 as a column of a frame with ``parameter``."""
    return df.withColumn("unit", unit_of("parameter"))


def parameter_of_header(c: ColumnLike) -> Column:
    """Parameter key from the value cell of a table header."""
    c = _col(c)
    return (F.when(c.contains("Wasserstand"), WATER_LEVEL)
            .when(c.contains("Wassertemperatur"), WATER_TEMPERATURE)
            .otherwise(UNKNOWN_PARAMETER))
