"""Parquet and JSON sinks (K1-K6, T5)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import live_time_parts, local_epoch, unit_of
from gaugeworks.schema import DAILY, KEYS, RAW, UNITS, WATER_LEVEL, WATER_TEMPERATURE
from gaugeworks.sources.live import LEVEL_KIND, TEMPERATURE_KIND

RAW_FOLDERS = ["parameter", "year", "month", "bucket"]
DAILY_FOLDERS = ["parameter", "year", "bucket"]
FOLDER_ROWS = 1 << 24
"""Rows of a folder beyond which its stations are dealt over two; so many readings are about 100 to 200 MB."""


def with_period(raw: DataFrame) -> DataFrame:
    """The period of a stored raw series, without its station group."""
    return raw.withColumns({"year": F.year("ts"), "month": F.month("ts")})


def period_of(folders: list[str]) -> list[str]:
    return [c for c in folders if c != "bucket"]


def period_key(folder: str) -> str:
    """The period in the path of a folder (``parameter=x/year=2024/bucket=5``), as ``grouped`` writes it."""
    levels = [level.partition("=") for level in folder.split("/")]
    return "/".join(unquote(value) for name, _, value in levels if name != "bucket")


def depth_for(n_rows: int) -> int:
    """How often the stations of a period are halved, so that a folder has ``FOLDER_ROWS`` or less on average."""
    return (-(-n_rows // FOLDER_ROWS) - 1).bit_length() if n_rows else 0


def _key(period: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in period])


def counted_depths(placed: DataFrame, folders: list[str]) -> dict[str, int]:
    """Depth of the periods that need more than one folder: a row for each of them reaches the driver."""
    period = period_of(folders)
    counts = placed.groupBy(_key(period).alias("period")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDER_ROWS)
    return {r["period"]: depth_for(r["n"]) for r in counts.collect()}


def grouped(placed: DataFrame, folders: list[str], depths: dict[str, int]) -> DataFrame:
    """Adds the station group where ``folders`` has one; a period that ``depths`` does not name has a single one.

    A group is numbered by a 1 and then ``depth`` bits of the hash of the station, so a
    number tells its depth, and groups of different depths never share a folder. ``depths``
    has an entry per ``FOLDER_ROWS`` stored rows at most.
    """
    if "bucket" not in folders:
        return placed
    if not depths:
        return placed.withColumn("bucket", F.lit(1))
    known = placed.sparkSession.createDataFrame(list(depths.items()), "_period string, _depth int")
    deep = placed.withColumn("_period", _key(period_of(folders))).join(F.broadcast(known), "_period", "left")
    size = "shiftleft(1, coalesce(_depth, 0))"
    return deep.withColumn("bucket", F.expr(f"{size} + (hash(station_id) & ({size} - 1))")).drop("_period", "_depth")


def depth_of(folder: str) -> int:
    return int(folder.rpartition("bucket=")[2]).bit_length() - 1


def stored_depths(stored: DataFrame, path: str) -> dict[str, int]:
    """Depth of every period of a plain store, from the names of its folders."""
    mark = f"{path.rstrip('/')}/"
    folders = {unquote(f).rpartition(mark)[2].rpartition("/")[0] for f in stored.inputFiles()}
    return {period_key(f): depth_of(f) for f in folders}


def laid_out(df: DataFrame, folders: list[str], order: list[str]) -> DataFrame:
    """Rows gathered by folder and sorted for the writer (T5).

    ``rebalance`` lets AQE split a folder that holds most of the rows over many
    tasks and join small ones, so neither the number of files nor the size of a
    task depends on the skew of the folders. The sort gives narrow row-group
    ranges of station and time.
    """
    return df.hint("rebalance", *folders).sortWithinPartitions(*folders, *order)


def _write(df: DataFrame, path: str, folders: list[str], mode: str, **options: str) -> None:
    writer = df.write.mode(mode).option("compression", "zstd").options(**options)
    writer.partitionBy(*folders).parquet(path)


def write_raw(raw: DataFrame, path: str, mode: str = "overwrite", depths: dict[str, int] | None = None) -> None:
    """K1. Without ``depths`` the rows of each period are counted first, which reads parameter and time of ``raw`` once more."""
    rows = with_period(raw.select(*RAW.names))
    rows = grouped(rows, RAW_FOLDERS, counted_depths(rows, RAW_FOLDERS) if depths is None else depths)
    _write(laid_out(rows, RAW_FOLDERS, ["station_id", "ts"]), path, RAW_FOLDERS, mode)


def write_daily(daily: DataFrame, path: str, mode: str = "overwrite", depths: dict[str, int] | None = None) -> None:
    """K2: the count is stored as a 32-bit integer. ``depths`` as in ``write_raw``; ``daily_depths`` spares a second rollup."""
    rows = daily.select(*DAILY.names).withColumns({"count": F.col("count").cast("int"), "year": F.year("date")})
    rows = grouped(rows, DAILY_FOLDERS, counted_depths(rows, DAILY_FOLDERS) if depths is None else depths)
    _write(laid_out(rows, DAILY_FOLDERS, ["station_id", "date"]), path, DAILY_FOLDERS, mode)


def daily_depths(stored: DataFrame) -> dict[str, int]:
    """Depths of the daily rows of a stored raw series: a row per station and day of the year at most.

    Stations are counted approximately, since depths only decide how large folders are.
    """
    stations = stored.groupBy(_key(period_of(DAILY_FOLDERS)).alias("period")).agg((366 * F.approx_count_distinct("station_id")).alias("n"))
    return {r["period"]: depth_for(r["n"]) for r in stations.where(F.col("n") > FOLDER_ROWS).collect()}


def replace_partitions(merged: DataFrame, paths: list[str]) -> None:
    """K5: publish merged raw rows, staged in their folders, to each of ``paths``, touched folders only.

    ``merged`` has the folder columns it was staged by and must not read one of ``paths``;
    ``plans.refresh`` has the staged form. The rows already lie in the files they belong
    to, so nothing is shuffled again.
    """
    rows = merged.select(*RAW.names, *RAW_FOLDERS[1:]).sortWithinPartitions(*RAW_FOLDERS, "station_id", "ts")
    for path in paths:
        _write(rows, path, RAW_FOLDERS, "overwrite", partitionOverwriteMode="dynamic")


def replace_daily(daily: DataFrame, path: str) -> None:
    """K5 for daily rows, staged in their folders: the folders that occur in ``daily`` are replaced."""
    rows = daily.select(*DAILY.names, *DAILY_FOLDERS[1:]).withColumn("count", F.col("count").cast("int"))
    rows = rows.sortWithinPartitions(*DAILY_FOLDERS, "station_id", "date")
    _write(rows, path, DAILY_FOLDERS, "overwrite", partitionOverwriteMode="dynamic")


def station_document(meta: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """K3: one document per station with its files by parameter and its attributes.

    Of several files the first by name describes the station, level before
    temperature. A list has one entry per export file of a station; the rows of the
    files table hold the same without nesting.
    """
    def files(parameter: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("parameter") == parameter, F.col("file_path"))))

    attributes = ["station_id", "station_name", "river", "time_ref", "easting", "northing",
                  "coord_ref", "gauge_zero", "raw_meta"]
    first = F.struct((F.col("parameter") != WATER_LEVEL).alias("later"), "file_path")
    return (
        meta.filter(F.col("station_id").isNotNull())
        .groupBy("station_id")
        .agg(files(WATER_LEVEL).alias("water_level_files"),
             files(WATER_TEMPERATURE).alias("water_temperature_files"),
             F.min_by(F.struct(*attributes), first).alias("station"))
        .select((generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
                "water_level_files", "water_temperature_files", "station")
    )


def write_meta(meta: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3."""
    station_document(meta).write.mode(mode).json(path)


def live_lines(readings: DataFrame, station_name: str | Column = "", source: str | Column = "",
               fetched_at: Column | None = None) -> DataFrame:
    """Readings (``station_id, parameter, ts, value``) in the layout of the live files."""
    is_level = F.col("parameter") == WATER_LEVEL
    parts = live_time_parts("ts")
    fetched = fetched_at if fetched_at is not None else (
        F.col("fetched_at") if "fetched_at" in readings.columns
        else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))

    def text(v: str | Column) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    return readings.select(
        F.when(is_level, LEVEL_KIND).otherwise(TEMPERATURE_KIND).alias("kind"),
        parts["date"].alias("day"),
        parts["timestamp"].alias("timestamp"), local_epoch("ts").alias("timestamp_unix"),
        parts["date"].alias("date"), parts["time"].alias("time"),
        F.when(is_level, F.col("value")).alias("value_cm"),
        F.when(~is_level, F.col("value")).alias("value_celsius"),
        F.when(is_level, UNITS[WATER_LEVEL]).otherwise(UNITS[WATER_TEMPERATURE]).alias("unit"),
        F.col("station_id").cast("string").alias("station_id"),
        text(station_name).alias("station_name"), text(source).alias("source"),
        fetched.alias("fetched_at"))


def append_live(lines: DataFrame, path: str) -> None:
    """K4: append live lines below one folder per kind and measurement date."""
    lines.hint("rebalance", "kind", "day").write.mode("append").partitionBy("kind", "day").json(path)


def snapshot(live: DataFrame, window: str = "1 day") -> DataFrame:
    """K6: one document per station, parameter and time window with its readings, newest first.

    Equal instants are folded first (the largest fetch time, then value counts), so a list
    is bounded by the clock of the sensor and by the window, however often a reading was
    sent. Where ``live`` has the station's name, source or fetch time, the document has
    them too (the largest name and source, the latest fetch), and a measurement its unit.
    """
    known = [c for c in ("station_name", "source", "fetched_at") if c in live.columns]
    order = F.struct(*[c for c in ("fetched_at",) if c in known], "value")
    instants = live.groupBy(*KEYS, "ts").agg(F.max_by("value", order).alias("value"), F.count(F.lit(1)).alias("n_sent"),
                                             *[F.max(c).alias(c) for c in known])
    item = F.struct("ts", "value", unit_of("parameter").alias("unit"), "n_sent")
    return (
        instants.groupBy(*KEYS, F.window("ts", window).getField("start").alias("window_start"))
        .agg(*[F.max(c).alias(c) for c in known], F.sort_array(F.collect_list(item), asc=False).alias("measurements"))
    )
