"""Station exports: semicolon text with a free-length preamble.

No rule depends on a line's position, so files stay splittable:

* a line that starts with a digit, quoted or not, is a table row;
* preamble lines have an unquoted first field that ends with a colon;
* the table header starts with ``Datum;``;
* every other non-blank line is a table row, good or not.

So lines = preamble + header + rows + blank ones, and a row is in the series, among
the rejects, or both.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.plans import evaluated_once
from gaugeworks.functions.scalars import (
    clean_text, decimal_comma, fold_status, int_or_null, meta_key, parameter_of_header, parse_german_ts, parse_ts,
)
from gaugeworks.operators.series import split_rejects
from gaugeworks.schema import RAW, STATION_META

# Fixed words of the export format.
TABLE_HEADER = r"^Datum;"
PREAMBLE_LINE = r'^[^;"0-9][^;"]*:\s*(;|$)'
QUOTED_KEY = r'^"[^;"]*:"?\s*(;|$)'
KEY_STATION_ID = "Messstellen-Nr."
KEY_STATION_NAME = "Messstellen-Name"
KEY_RIVER = "Gewässer"
KEY_TIME_REF = "Zeitbezug"
KEY_EASTING = "Ostwert"
KEY_NORTHING = "Nordwert"
KEY_GAUGE_ZERO = "Pegelnullpunktshöhe"
KEY_QUERIED = "Datenbankabfrage"
DATE_IN_NAME = r"_(\d{2}\.\d{2}\.\d{4})_[^/]*$"
STATION_IN_PATH = r"/(\d+)_[^/]*$"
FOLDER_IN_PATH = r"([^/]+)/[^/]*$"


class Export(NamedTuple):
    raw: DataFrame
    rejects: DataFrame
    meta: DataFrame


def export_paths(root: str, station: str | int = "*") -> list[str]:
    """Globs of a station's exports, one folder per parameter.

    Reading a glob that matches nothing is an error in Spark, as it should be.
    """
    return [f"{root.rstrip('/')}/*/{station}_*.csv"]


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of the exports with the file each came from."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"),
                                         line_text().alias("line"))


def line_text() -> Column:
    """A line without byte order mark and outer blanks."""
    return F.trim(F.replace("value", F.lit("﻿"), F.lit("")))


def _is_header() -> Column:
    return F.col("line").rlike(TABLE_HEADER)


def _is_meta() -> Column:
    return F.col("line").rlike(PREAMBLE_LINE) & ~_is_header()


def split_preamble(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: preamble lines, table header lines and table rows."""
    rows = lines.filter(~_is_meta() & ~_is_header() & (F.col("line") != ""))
    return lines.filter(_is_meta()), lines.filter(_is_header()), rows


def files_without_header(lines: DataFrame) -> DataFrame:
    """S3: files that have lines but no table header."""
    _, header, _ = split_preamble(lines)
    return lines.select("file_path").distinct().join(header.select("file_path"), "file_path", "left_anti")


def _header_parameter() -> Column:
    return parameter_of_header(F.get(F.split("line", ";"), 1))


def detect_parameter(header: DataFrame) -> DataFrame:
    """One parameter per file, from the second header cell."""
    return header.groupBy("file_path").agg(F.min(_header_parameter()).alias("parameter"))


def station_meta(head: DataFrame) -> DataFrame:
    """One metadata row per file from its preamble and header lines.

    The preamble has about ten lines, so the map stays small; of a repeated key
    the largest value counts. Without a header the parameter is null, without a
    station number the station.
    """
    parts = F.split("line", ";")
    key = meta_key(F.get(parts, 0))
    fields = (
        head.select("file_path", F.when(~_is_header() & (key != ""), key).alias("k"),
                    F.coalesce(clean_text(F.get(parts, 1)), F.lit("")).alias("v"),
                    meta_key(F.get(parts, 2)).alias("k2"),
                    clean_text(F.get(parts, 3)).alias("v2"),
                    clean_text(F.get(parts, 4)).alias("v3"),
                    F.when(_is_header(), _header_parameter()).alias("parameter"))
        .groupBy("file_path", "k")
        .agg(F.max(F.struct("v", "k2", "v2", "v3")).alias("f"), F.min("parameter").alias("parameter"))
    )

    def field(key: str, name: str = "v") -> Column:
        return F.max(F.when(F.col("k") == key, F.nullif(F.col(f"f.{name}"), F.lit(""))))

    easting_line = (F.col("k") == KEY_EASTING) & (F.col("f.k2") == KEY_NORTHING)
    entry = F.when(F.col("k").isNotNull(), F.struct("k", "f.v"))
    return fields.groupBy("file_path").agg(
        F.min("parameter").alias("parameter"),
        int_or_null(field(KEY_STATION_ID)).alias("station_id"),
        field(KEY_STATION_NAME).alias("station_name"),
        field(KEY_RIVER).alias("river"),
        field(KEY_TIME_REF).alias("time_ref"),
        int_or_null(field(KEY_EASTING)).alias("easting"),
        int_or_null(F.max(F.when(easting_line, F.col("f.v2")))).alias("northing"),
        field(KEY_EASTING, "v3").alias("coord_ref"),
        field(KEY_GAUGE_ZERO).alias("gauge_zero"),
        F.map_from_entries(F.collect_list(entry)).alias("raw_meta"),
    ).withColumns({
        "station_id": F.nullif("station_id", F.lit(0)),
        "station_name": F.coalesce("station_name", F.col("station_id").cast("string")),
        "river": F.coalesce("river", F.lit("")),
        "time_ref": F.coalesce("time_ref", F.lit("")),
    }).select(*STATION_META.names)


def file_meta(lines: DataFrame) -> DataFrame:
    """S4 and S5 for all lines, in one pass."""
    return station_meta(lines.filter(_is_meta() | _is_header()))


def canonical_meta(meta: DataFrame) -> DataFrame:
    """The metadata row of the first file by name, per (station, parameter)."""
    row = F.struct(*[c for c in STATION_META.names if c not in ("station_id", "parameter")])
    return (meta.filter(F.col("station_id").isNotNull())
            .groupBy("station_id", "parameter")
            .agg(F.min_by(row, "file_path").alias("m"))
            .select("station_id", "parameter", "m.*"))


def identity_from_path(lines: DataFrame) -> DataFrame:
    """Station and parameter from ``<folder>/<station>_*.csv`` instead of the file's text.

    The folder's name holds the word for the parameter. Needs no second pass and no
    join; use it where the folder layout is trusted.
    """
    path = F.col("file_path")
    folder = F.initcap(F.regexp_replace(F.regexp_extract(path, FOLDER_IN_PATH, 1), "[^A-Za-z]+", " "))
    return lines.withColumns({
        "station_id": int_or_null(F.regexp_extract(path, STATION_IN_PATH, 1)),
        "parameter": parameter_of_header(folder),
    })


def parse_rows(rows: DataFrame) -> DataFrame:
    """Typed columns of table rows, with a reject reason where one applies.

    ``rows`` has ``line``, ``station_id`` and ``parameter``; a row without a station
    is rejected too, so nothing is lost unseen.
    """
    return evaluated_once(_judged(_cells(rows)))


def _cells(rows: DataFrame) -> DataFrame:
    """What the text of a row says, whatever file it is in."""
    return rows.withColumn("parts", F.split("line", ";")).withColumns({
        "n_fields": F.size("parts"),
        "ts": parse_ts(clean_text(F.get("parts", 0))),
        "value": decimal_comma(clean_text(F.get("parts", 1))),
        "has_value": clean_text(F.get("parts", 1)).isNotNull(),
        "status": fold_status(F.get("parts", 2)),
        "is_key": F.col("line").rlike(QUOTED_KEY) & ~F.col("line").rlike(r'^"\d'),
    }).drop("parts")


def _judged(cells: DataFrame) -> DataFrame:
    """Cells of rows whose station and parameter are known, or not, with the reason to reject them."""
    usable = F.col("station_id").isNotNull() & F.col("parameter").isNotNull() & (F.col("n_fields") >= 3)
    return cells.withColumn("ts", F.when(usable, F.col("ts"))).withColumn(
        "reject_reason",
        F.when(F.col("is_key"), "bad_preamble")
        .when(F.col("parameter").isNull(), "no_header")
        .when(F.col("station_id").isNull(), "no_station")
        .when(F.col("n_fields") < 3, "short_row")
        .when(F.col("ts").isNull(), "bad_ts")
        .when(F.col("value").isNull() & F.col("has_value"), "bad_value"))


STAGED = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("line", T.StringType()), T.StructField("n_fields", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType()), T.StructField("has_value", T.BooleanType()),
    T.StructField("status", T.StringType()), T.StructField("is_key", T.BooleanType()), T.StructField("kind", T.StringType())])


def stage_export(lines: DataFrame, path: str, identity: str = "header") -> Export:
    """``parse_export`` with the text read and parsed once.

    Lines go to ``path`` in two folders, head lines and parsed rows; metadata, series and
    rejects are all made from there. Rows meet their file's metadata when they are read
    back, with its stored size known.
    """
    kind = F.when(_is_meta() | _is_header(), "head").otherwise("row")
    cells = _cells(lines.filter(F.col("line") != "").select("file_path", "line").withColumn("kind", kind))
    cells.select(*STAGED.names).write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/lines")
    staged = lines.sparkSession.read.schema(STAGED).parquet(f"{path}/lines")
    station_meta(staged.filter("kind = 'head'").select("file_path", "line")).write.mode("overwrite").parquet(f"{path}/meta")
    meta = lines.sparkSession.read.schema(STATION_META).parquet(f"{path}/meta")
    return _export_of(staged.filter("kind = 'row'"), meta, identity, _judged)


def name_date(path: str) -> Column:
    """The date in a file's name as midnight of that day."""
    return parse_german_ts(F.concat(F.regexp_extract(path, DATE_IN_NAME, 1), F.lit(" 00:00")))


def queried_at() -> Column:
    """When a file was queried, as sortable text: from its preamble, otherwise the date in its name."""
    said = parse_german_ts(F.element_at("raw_meta", KEY_QUERIED))
    return F.coalesce(said, name_date("file_path")).cast("string")


def line_balance(lines: DataFrame) -> DataFrame:
    """Lines per file by kind; the kinds add up to ``n_lines``."""
    row = ~_is_meta() & ~_is_header() & (F.col("line") != "")
    return lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(_is_meta()).alias("n_meta"), F.count_if(_is_header()).alias("n_header"),
        F.count_if(row).alias("n_rows"), F.count_if(F.col("line") == "").alias("n_blank"))


def store_meta(lines: DataFrame, path: str) -> DataFrame:
    """Write the per-file metadata of ``lines`` to ``path`` and read it back.

    A join with the stored table is planned with its real size: broadcast while it
    is small, and otherwise by shuffle.
    """
    file_meta(lines).write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.schema(STATION_META).parquet(path)


def parse_export(lines: DataFrame, meta: DataFrame | None = None, identity: str = "header") -> Export:
    """Raw series, rejected rows and file metadata of export lines.

    With ``identity="header"`` rows get station and parameter by a join with the
    per-file metadata. The join is not forced to broadcast; pass ``meta`` from
    ``store_meta`` and its size is known before the rows are read, otherwise the
    rows may be shuffled by file first. ``identity="path"`` avoids the join.
    """
    _, _, rows = split_preamble(lines)
    return _export_of(rows, file_meta(lines) if meta is None else meta, identity, parse_rows)


def _export_of(rows: DataFrame, meta: DataFrame, identity: str, parse: Callable[[DataFrame], DataFrame]) -> Export:
    """Rows that get station and parameter from their file, split into series and rejects."""
    if identity == "path":
        rows = identity_from_path(rows).withColumn("fetched_at", name_date("file_path").cast("string"))
    elif identity == "header":
        rows = rows.join(meta.select("file_path", "station_id", "parameter", queried_at().alias("fetched_at")), "file_path", "left")
    else:
        raise ValueError("identity must be 'header' or 'path'")
    good, rejects = split_rejects(parse(rows))
    raw = good.select(*RAW.names, F.col("file_path").alias("source_file"), "fetched_at")
    return Export(raw, rejects.select("file_path", "line", "reject_reason"), meta)


def read_export(spark: SparkSession, paths: str | list[str], meta: DataFrame | None = None,
                identity: str = "header") -> Export:
    """``parse_export`` on files; rows keep the file and the time of its query, which order overlapping exports."""
    return parse_export(read_lines(spark, paths), meta, identity)
