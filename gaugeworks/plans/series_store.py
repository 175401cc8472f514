"""A raw series with the state of its daily rollup, kept in versions.

A merge writes the folded new readings and the changed rollup state, nothing else. The
state of a day is counts, sums and extremes per status. What a revision replaces is
subtracted; only where it takes away the least or greatest value, or the first instant
of a status, is that day read again.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.plans import observed
from gaugeworks.operators.merge import BROADCAST_CHANGES, fold_new, lay_over, replaced_rows
from gaugeworks.operators.rollup import daily_from_partials, rollup_partials
from gaugeworks.plans.refresh import keyed, stage_name, usable_key
from gaugeworks.schema import KEYS, RAW
from gaugeworks.session import shared_dir
from gaugeworks.sinks import versions
from gaugeworks.sinks.store import DAILY_FOLDERS, RAW_FOLDERS, depth_of, period_key, with_period
from gaugeworks.sinks.versions import Part, Table, Version

SUMS = ["n_rows", "n_values", "total"]


def partial_schema(scale: int | None) -> T.StructType:
    total = T.DoubleType() if scale is None else T.DecimalType(28, scale)
    return T.StructType([
        *RAW.fields[:2], T.StructField("date", T.DateType()), RAW["status"], T.StructField("n_rows", T.LongType()),
        T.StructField("n_values", T.LongType()), T.StructField("total", total), T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()), T.StructField("first_ts", T.TimestampNTZType())])


def raw_table() -> Table:
    return Table(RAW, [*KEYS, "ts"], RAW_FOLDERS, with_period, ["station_id", "ts"])


def partial_table(scale: int | None) -> Table:
    """State of days; a status that a day no longer has stays with zero rows, and null is a status of its own."""
    schema = T.StructType([*partial_schema(scale).fields, T.StructField("status_key", T.StringType())])

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("year", F.year("date"))

    return Table(schema, [*KEYS, "date", "status_key"], DAILY_FOLDERS, place, ["station_id", "date"])


def tables(scale: int | None) -> dict[str, Table]:
    return {"raw": raw_table(), "partials": partial_table(scale)}


def _with_key(partials: DataFrame) -> DataFrame:
    """Keys of changes must not be null."""
    return partials.withColumn("status_key", F.coalesce(F.concat(F.lit("="), "status"), F.lit("")))


def _partials(raw: DataFrame, scale: int | None) -> DataFrame:
    typed = rollup_partials(raw, scale)
    return typed.withColumn("total", F.col("total").cast(partial_schema(scale)["total"].dataType))


def load_series(spark: SparkSession, raw: DataFrame, root: str, scale: int | None = None, days: bool = True, run_id: str = "load") -> Version:
    """First load. ``raw`` holds an instant of a series once (``dedup_last`` otherwise); it becomes the base.

    With ``days`` the state of the daily rollup is kept beside it.
    """
    now, found = versions.latest(spark, root), tables(scale)
    if run_id in now.runs:
        return now
    written = [versions.write(spark, root, "raw", found["raw"], raw, now, is_base=True)]
    if days:
        stored = versions.read(spark, root, "raw", found["raw"], Version(now.number + 1, [], written))
        written.append(versions.write(spark, root, "partials", found["partials"], _with_key(_partials(stored, scale)), now, is_base=True))
    return versions.announce(spark, root, now, written, run_id)


def read_series(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame:
    """The raw series with its folder columns, changes laid over the base."""
    return versions.read(spark, root, "raw", raw_table(), version)


def read_partials(spark: SparkSession, root: str, scale: int | None = None, version: Version | None = None) -> DataFrame:
    return versions.read(spark, root, "partials", partial_table(scale), version).where("n_rows > 0")


def read_days(spark: SparkSession, root: str, scale: int | None = None, version: Version | None = None) -> DataFrame:
    """A1 and A2 of the stored series from its state; the series is not read."""
    return daily_from_partials(read_partials(spark, root, scale, version))


def _withdrawn(kind: str, out: Column, old: Column, new: Column) -> Column:
    """Whether a replaced reading held the extreme and no new one reaches it."""
    held = out <= old if kind == "min" else out >= old
    reached = new <= old if kind == "min" else new >= old
    return F.coalesce(held, F.lit(False)) & ~F.coalesce(reached, F.lit(False))


def revised_partials(old: DataFrame, out: DataFrame, new: DataFrame, exact: bool) -> DataFrame:
    """State after a revision, per (series, day, status), with ``again``: whether the day must be read again.

    ``old`` is stored state, ``out`` and ``new`` the state of the replaced and the new readings.
    Sums are differences; extremes can only widen unless ``again``. Differences of doubles are
    not ``exact``, so without decimals each day that loses a reading is read again.
    """
    keys = [*KEYS, "date", "status_key"]

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("status", *SUMS, "min", "max", "first_ts")])

    both = named(out, "o").join(named(new, "n"), keys, "full_outer").join(named(old, "s"), keys, "left")
    zero = F.lit(0)
    state = {c: F.coalesce(f"s_{c}", zero) - F.coalesce(f"o_{c}", zero) + F.coalesce(f"n_{c}", zero) for c in SUMS}
    again = (_withdrawn("min", F.col("o_min"), F.col("s_min"), F.col("n_min")) | _withdrawn("max", F.col("o_max"), F.col("s_max"), F.col("n_max"))
             | _withdrawn("min", F.col("o_first_ts"), F.col("s_first_ts"), F.col("n_first_ts")))
    again = again if exact else again | F.col("o_n_rows").isNotNull()
    total = old.schema["total"].dataType
    return both.select(
        *keys, F.coalesce("n_status", "o_status").alias("status"), state["n_rows"].alias("n_rows"), state["n_values"].alias("n_values"),
        state["total"].cast(total).alias("total"), F.least("s_min", "n_min").alias("min"), F.greatest("s_max", "n_max").alias("max"),
        F.least("s_first_ts", "n_first_ts").alias("first_ts"), again.alias("again"))


def merge_series(spark: SparkSession, new: DataFrame, root: str, run_id: str, scale: int | None = None, days: bool = True,
                 rejects_path: str | None = None, compact_after: int | None = None) -> Version:
    """Last-wins merge of new readings into a stored series and, with ``days``, its daily state, in one version.

    Written are the new readings (one per instant) and the state of their days. Stored rows
    are read in touched folders only, to find what is replaced; without ``days`` none are.
    Rows without station, parameter or instant go to ``rejects_path``. With ``compact_after``,
    changes of that many runs are laid over the base for good. A repeated run changes nothing.
    """
    now, found = versions.latest(spark, root), tables(scale)
    if run_id in now.runs:
        return now
    seen = Observation()
    counted = new.observe(seen, F.count_if(~usable_key()).alias("unusable"))
    written = [versions.write(spark, root, "raw", found["raw"], fold_new(counted.filter(usable_key())), now)]
    if observed(seen, "unusable") != 0:
        keyed(new)[1].write.mode("overwrite").json(f"{rejects_path or root.rstrip('/') + '/rejects'}/run={quote(run_id, safe='')}")
    if days and written[0].n_rows:
        stage = f"{shared_dir(spark).rstrip('/')}/{stage_name('series', root)}"
        written.append(versions.write(spark, root, "partials", found["partials"],
                                      _changed_state(spark, root, now, found, written[0], scale, stage), now))
    version = versions.announce(spark, root, now, written, run_id)
    if compact_after is not None and versions.changes_waiting(version) >= compact_after:
        version = versions.compact(spark, root, found)
    return version


def folders_of_years(folders: list[str], depths: dict[str, int]) -> list[str]:
    """Folders of the state that can hold the stations and days of raw folders.

    Both number their station groups by low bits of one hash: a deeper raw group has one
    group of the state above it, a shallower one has several below.
    """
    found = set()
    for folder in folders:
        parameter, year, _, bucket = folder.split("/")
        raw_depth, depth = depth_of(folder), depths.get(period_key(f"{parameter}/{year}"), 0)
        slot = int(bucket.partition("=")[2]) - (1 << raw_depth)
        step = 1 << min(raw_depth, depth)
        found |= {f"{parameter}/{year}/bucket={(1 << depth) + s}" for s in range(slot % step, 1 << depth, step)}
    return sorted(found)


def _changed_state(spark: SparkSession, root: str, now: Version, found: dict[str, Table], written: Part, scale: int | None,
                   stage: str) -> DataFrame:
    """State of the days that the written readings touch, after them."""
    raw, partials, n = found["raw"], found["partials"], written.n_rows
    changes = versions.read(spark, root, "raw", raw, Version(written.gen, [], [written._replace(is_base=True)]))
    folders = versions.folders_of(spark, root, "raw", raw, written)
    in_years = folders_of_years(folders, now.depths("partials"))
    out = replaced_rows(versions.read(spark, root, "raw", raw, now, folders), changes, raw.keys, n)
    old = versions.read(spark, root, "partials", partials, now, in_years)
    seen = Observation()
    revised = revised_partials(old, _with_key(_partials(out, scale)), _with_key(_partials(changes, scale)), scale is not None)
    revised.observe(seen, F.count_if("again").alias("again")).write.mode("overwrite").parquet(f"{stage}/state")
    state, columns, day = spark.read.schema(revised.schema).parquet(f"{stage}/state"), partials.schema.fieldNames(), [*KEYS, "date"]
    n_again = observed(seen, "again")
    if not n_again:
        return state.select(columns)
    again = state.where("again").select(*day).distinct()
    reread = versions.touched(again.withColumn("ts", F.col("date").cast("timestamp_ntz")), raw, now.depths("raw"))
    rows = lay_over(versions.read(spark, root, "raw", raw, now, reread), changes, raw.keys, n)
    few = F.broadcast(again) if n_again <= BROADCAST_CHANGES else again
    fresh = _with_key(_partials(rows.withColumn("date", F.to_date("ts")).join(few, day, "left_semi").drop("date"), scale))
    # A status that lost all its rows keeps its line, with none.
    empty = {c: F.lit(0).cast(partials.schema[c].dataType) for c in SUMS} | {c: F.lit(None).cast(partials.schema[c].dataType) for c in ("min", "max", "first_ts")}
    lost = state.join(few, day, "left_semi").join(fresh.select(*partials.keys), partials.keys, "left_anti").withColumns(empty)
    return (state.join(few, day, "left_anti").select(columns)
            .unionByName(fresh.select(columns)).unionByName(lost.select(columns)))
