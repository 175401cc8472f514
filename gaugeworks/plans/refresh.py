"""Batch jobs: exports to Parquet, and new readings into the stored series.

A job that replaces folders of the table it reads writes its result to the shared
folder first, notes the run as staged, publishes, and notes the run as published.
A run that died while publishing is finished from the staged rows when the next
one starts, and a run that is repeated changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.operators.merge import dedup_last, merge_last_wins
from gaugeworks.operators.ranges import in_folders
from gaugeworks.operators.rollup import daily_rollup
from gaugeworks.schema import DAILY, KEYS, RAW
from gaugeworks.session import shared_dir
from gaugeworks.sinks.store import (
    DAILY_FOLDERS, RAW_FOLDERS, counted_depths, daily_depths, grouped, replace_daily, replace_partitions, stored_depths, with_period,
    write_daily, write_meta, write_raw,
)
from gaugeworks.sources.exports import read_lines, stage_export
from gaugeworks.sources.store import normalise_daily, normalise_raw


RAW_STAGED = T.StructType([*RAW.fields, *[T.StructField(c, T.IntegerType()) for c in RAW_FOLDERS[1:]]])
DAILY_STAGED = T.StructType([*DAILY.fields, *[T.StructField(c, T.IntegerType()) for c in DAILY_FOLDERS[1:]]])


class Layout(NamedTuple):
    """Folders of one dataset."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def daily(self) -> str:
        return f"{self.root}/daily"

    @property
    def meta(self) -> str:
        return f"{self.root}/station_meta"

    @property
    def files(self) -> str:
        return f"{self.root}/files"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"


def ingest_exports(spark: SparkSession, paths: str | list[str], root: str, dedup: bool = False,
                   scale: int | None = None, identity: str = "header") -> Layout:
    """Exports to raw, daily, metadata and rejects below ``root``.

    The text is read and parsed once, into the shared folder; metadata, series and rejects
    come from there, and the daily rollup from the stored series. Overlapping exports count twice unless ``dedup``, which keeps
    the row of the file that was queried last.
    """
    out = Layout(root.rstrip("/"))
    export = stage_export(read_lines(spark, paths), f"{shared_dir(spark).rstrip('/')}/{stage_name('ingest', out.root)}", identity)
    export.meta.write.mode("overwrite").parquet(out.files)
    depths = counted_depths(with_period(export.raw), RAW_FOLDERS)
    write_raw(dedup_last(export.raw) if dedup else export.raw, out.raw, depths=depths)
    export.rejects.write.mode("overwrite").json(out.rejects)
    stored = spark.read.parquet(out.raw)
    write_daily(daily_rollup(normalise_raw(stored), scale), out.daily, depths=daily_depths(stored))
    write_meta(export.meta, out.meta)
    return out


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table in a declared schema; only a folder that is not there counts as empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


NOTE = "run_id string, copies array<string>, daily_path string"


def _noted(spark: SparkSession, note: str) -> Row | None:
    try:
        return spark.read.schema(NOTE).json(note).head()
    except AnalysisException as error:
        if not _missing(error):
            raise
        return None


def _note(spark: SparkSession, note: str, run_id: str, copies: list[str], daily_path: str | None) -> None:
    spark.createDataFrame([(run_id, copies, daily_path)], NOTE).write.mode("overwrite").json(note)


def stage_name(job: str, path: str) -> str:
    """One folder name per job and table."""
    return f"{job}_{re.sub(r'[^A-Za-z0-9]+', '_', path)}_{hashlib.sha1(path.encode()).hexdigest()[:12]}"


def usable_key() -> Column:
    """Whether a row has a station, a parameter and an instant that a stored series can hold."""
    usable = F.col("station_id").isNotNull() & F.col("parameter").isNotNull() & (F.year("ts") > 0)
    return F.coalesce(usable, F.lit(False))


def keyed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that a stored series can hold, and those without station, parameter or a usable instant."""
    return rows.filter(usable_key()), rows.filter(~usable_key())


def plain_depths(spark: SparkSession, path: str, staged: T.StructType) -> dict[str, int]:
    """Depth of each period of a plain store; a store that is not there has none. A merge keeps them."""
    return stored_depths(parquet_or_empty(spark, path, staged), path)


def merged_with_store(spark: SparkSession, new: DataFrame, raw_path: str) -> DataFrame:
    """U1 and U2 against the stored folders that ``new`` touches, and no others."""
    depths = plain_depths(spark, raw_path, RAW_STAGED)
    touched = grouped(with_period(new), RAW_FOLDERS, depths).select(*RAW_FOLDERS).distinct()
    stored = in_folders(parquet_or_empty(spark, raw_path, RAW_STAGED), touched, RAW_FOLDERS)
    return merge_last_wins(stored.select(*RAW.names), new)


def refreshed_daily(spark: SparkSession, rows: DataFrame, new: DataFrame, daily_path: str,
                    scale: int | None = None) -> DataFrame:
    """Daily rows of the folders that ``new`` touches, with its days rolled up again.

    ``rows`` holds all raw rows of each day of a series that ``new`` has a reading of.
    """
    days = new.select(*KEYS, F.to_date("ts").alias("date")).distinct()
    placed = grouped(days.withColumn("year", F.year("date")), DAILY_FOLDERS, plain_depths(spark, daily_path, DAILY_STAGED))
    folders = placed.select(*DAILY_FOLDERS).distinct()
    stored = parquet_or_empty(spark, daily_path, DAILY_STAGED)
    kept = in_folders(stored, folders, DAILY_FOLDERS).join(days, [*KEYS, "date"], "left_anti")
    again = rows.withColumn("date", F.to_date("ts")).join(days, [*KEYS, "date"], "left_semi").drop("date")
    return normalise_daily(kept).unionByName(daily_rollup(again, scale))


def merge_into_store(spark: SparkSession, new: DataFrame, raw_path: str, run_id: str,
                     copies: list[str] | None = None, daily_path: str | None = None,
                     scale: int | None = None, rejects_path: str | None = None) -> None:
    """Last-wins merge of ``new`` into the stored raw series and its copies (K5).

    With ``daily_path`` the touched days are rolled up again; without it the daily table
    stays as it is. Rows without station, parameter or instant go to ``rejects_path`` (by
    default beside the series). Where a run is published to is noted with the run, so an
    interrupted one is finished as it was begun. Runs on one store follow one another.
    Copies must have the station groups of the series (``ValueError`` otherwise).
    """
    stage = f"{shared_dir(spark).rstrip('/')}/{stage_name('merge', raw_path)}"
    staged_note, published_note = f"{stage}/staged", f"{stage}/published"
    new_rows, raw_rows, daily_rows = f"{stage}/new", f"{stage}/raw", f"{stage}/daily"

    def publish(run: Row) -> None:
        replace_partitions(parquet_or_empty(spark, raw_rows, RAW_STAGED), [raw_path, *(run["copies"] or [])])
        if run["daily_path"] is not None:
            replace_daily(parquet_or_empty(spark, daily_rows, DAILY_STAGED), run["daily_path"])
        _note(spark, published_note, run["run_id"], run["copies"], run["daily_path"])

    staged, published = _noted(spark, staged_note), _noted(spark, published_note)
    if staged is not None and (published is None or staged["run_id"] != published["run_id"]):
        publish(staged)
        published = staged
    if published is not None and published["run_id"] == run_id:
        return
    depths = plain_depths(spark, raw_path, RAW_STAGED)
    for copy in copies or []:
        other = [p for p, d in plain_depths(spark, copy, RAW_STAGED).items() if depths.get(p, d) != d]
        if other:
            raise ValueError(f"{copy} has other station groups than {raw_path}: {sorted(other)[:5]}")
    usable, unusable = keyed(new)
    unusable.write.mode("overwrite").json(f"{rejects_path or raw_path.rstrip('/') + '_rejects'}/run={quote(run_id, safe='')}")
    usable.write.mode("overwrite").parquet(new_rows)
    fresh = spark.read.schema(usable.schema).parquet(new_rows)
    write_raw(merged_with_store(spark, fresh, raw_path), raw_rows, depths=depths)
    if daily_path is not None:
        rows = parquet_or_empty(spark, raw_rows, RAW_STAGED).select(*RAW.names)
        write_daily(refreshed_daily(spark, rows, fresh, daily_path, scale), daily_rows, depths=plain_depths(spark, daily_path, DAILY_STAGED))
    _note(spark, staged_note, run_id, copies or [], daily_path)
    publish(_noted(spark, staged_note))
