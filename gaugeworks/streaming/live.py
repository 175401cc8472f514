"""Streams of live readings (ST1-ST6).

Watermarks need ``TIMESTAMP``, so ``ts`` is cast when a stream gets one and cast
back in the sink; keep the session time zone at UTC. Lateness is measured in
event time. Merges need no watermark and lose nothing. ``streaming.arrivals`` tells on-time,
repeated and late readings apart and keeps all three; ``dedup_stream`` and the rollups of
ST5 work on the first kind and leave out what is behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from gaugeworks.functions.plans import observed
from gaugeworks.functions.scalars import hour_label
from gaugeworks.operators.rollup import summand
from gaugeworks.plans.refresh import merge_into_store, stage_name
from gaugeworks.plans.series_store import merge_series
from gaugeworks.schema import KEYS, RAW
from gaugeworks.session import shared_dir
from gaugeworks.sinks.versions import Table, changes_waiting, compact, publish, read
from gaugeworks.sources.live import (
    CORRUPT, LIVE_WITH_CORRUPT, json_reader_options, kind_of_path, live_to_raw, type_live,
)

DELAY = "7 days"
COMPACT_AFTER = 16
"""Batches whose changes lie beside the base before they are laid over it."""


def live_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: good readings of JSON files that arrive in a folder, in the raw schema.

    ``start_live`` on ``live_lines`` stores the rejected ones as well.
    """
    return live_to_raw(live_lines(spark, path, max_files_per_trigger).filter(F.col("reject_reason").isNull()))


def live_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: every line of JSON files that arrive in a folder, typed, with a reject reason where one applies."""
    reader = spark.readStream.schema(LIVE_WITH_CORRUPT).options(**json_reader_options())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.json(path).withColumns({
        "source_file": F.col("_metadata.file_name"), "kind": kind_of_path(F.col("_metadata.file_path"))})
    return type_live(lines)


def with_event_time(readings: DataFrame, delay: str = DELAY) -> DataFrame:
    """ST4: readings with an event-time watermark."""
    return readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def dedup_stream(readings: DataFrame, delay: str = DELAY) -> DataFrame:
    """ST2: drop readings fetched again with the same timestamp and value."""
    return with_event_time(readings, delay).dropDuplicatesWithinWatermark([*KEYS, "ts", "value"])


def naive(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time back to the type of the stored series."""
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def start_merge(readings: DataFrame, raw_path: str, checkpoint: str, daily_path: str | None = None,
                copies: list[str] | None = None, scale: int | None = None,
                available_now: bool = False) -> StreamingQuery:
    """ST3: merge each micro-batch into the stored series, last wins.

    The merge takes late and repeated readings as it finds them, so ``readings`` needs no
    watermark (feed it from ``live_stream``) and nothing is lost for being late. A batch
    that is run again after a failure is recognised by its run id.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_into_store(batch.sparkSession, naive(batch), raw_path, f"{checkpoint}#{batch_id}",
                         copies, daily_path, scale)

    writer = readings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_series(readings: DataFrame, root: str, checkpoint: str, scale: int | None = None, days: bool = True,
                 rejects_path: str | None = None, compact_after: int = COMPACT_AFTER, available_now: bool = False) -> StreamingQuery:
    """ST3: merge each micro-batch into a versioned series, last wins.

    A batch writes its own readings and the state of their days only; every
    ``compact_after`` batches the changes are laid over the base for good.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_series(batch.sparkSession, naive(batch), root, f"{checkpoint}#{batch_id}", scale, days, rejects_path, compact_after)

    return _started(readings.writeStream.foreachBatch(merge), checkpoint, available_now)


def start_live(lines: DataFrame, root: str, checkpoint: str, rejects_path: str, scale: int | None = None, days: bool = True,
               compact_after: int = COMPACT_AFTER, available_now: bool = False) -> StreamingQuery:
    """ST1 and ST3: good lines of ``live_lines`` into a versioned series, rejected ones with their reason into JSON.

    A micro-batch is read and parsed once: it is written in two folders, one per outcome. Rejects
    lie in a folder per batch, and the series knows its runs, so a batch that is repeated
    changes neither.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{shared_dir(spark).rstrip('/')}/{stage_name('lines', root)}"
        seen, rejected = Observation(), F.col("reject_reason").isNotNull()
        typed = batch.withColumn("rejected", rejected).observe(seen, F.count_if("rejected").alias("rejects"))
        typed.write.mode("overwrite").partitionBy("rejected").parquet(stage)
        both = spark.read.schema(typed.schema).parquet(stage)
        if observed(seen, "rejects") != 0:
            (both.where("rejected").select("source_file", F.col(CORRUPT).alias("line"), "kind", "timestamp", "station_id", "value", "fetched_at", "reject_reason")
             .write.mode("overwrite").json(f"{rejects_path}/batch={batch_id}"))
        merge_series(spark, live_to_raw(both.where("not rejected")), root, f"{checkpoint}#{batch_id}", scale, days,
                     f"{rejects_path}_keys", compact_after)

    return _started(lines.writeStream.foreachBatch(store), checkpoint, available_now)


def rollup_stream(readings: DataFrame, width: str = "1 day", scale: int | None = None) -> DataFrame:
    """ST5: running partial state per (station, parameter, window, status).

    ``readings`` carries a watermark. In update mode each emission holds the full
    state of a changed window; ``latest_emission`` keeps the last one.
    """
    window = F.window("ts", width)
    return (
        readings.groupBy(*KEYS, window.alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"),
             F.sum(summand(F.col("value"), scale)).alias("total"),
             F.min("value").alias("min"), F.max("value").alias("max"), F.min("ts").alias("first_ts"))
        .select(*KEYS, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.start").cast("date").alias("date"), "status", "n_rows", "n_values", "total",
                "min", "max", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"))
    )


def window_table(scale: int | None) -> Table:
    """Rollup state of windows, by their date."""
    total = T.DoubleType() if scale is None else T.DecimalType(28, scale)
    schema = T.StructType([
        *RAW.fields[:2], T.StructField("window_start", T.TimestampNTZType()), T.StructField("date", T.DateType()), RAW["status"],
        T.StructField("n_rows", T.LongType()), T.StructField("n_values", T.LongType()), T.StructField("total", total),
        T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("first_ts", T.TimestampNTZType()),
        T.StructField("status_key", T.StringType())])
    return Table(schema, [*KEYS, "window_start", "status_key"], ["date"], lambda df: df, ["station_id", "window_start"])


def start_rollup(partials: DataFrame, root: str, checkpoint: str, scale: int | None = None,
                 compact_after: int = COMPACT_AFTER, available_now: bool = False) -> StreamingQuery:
    """ST5: keep the last emitted state of every window in a versioned table (``window_state`` reads it).

    A batch writes the windows it changes. It counts from the moment its version does: one
    that dies before leaves nothing behind that is read, and one that is repeated changes
    nothing. Rows of one batch are whole states, so the last one wins.
    """
    known = {"windows": window_table(scale)}

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("status_key", F.coalesce(F.concat(F.lit("="), "status"), F.lit("")))
        version = publish(spark, root, known, {"windows": rows}, f"{checkpoint}#{batch_id}")
        if changes_waiting(version) >= compact_after:
            compact(spark, root, known)

    return _started(partials.writeStream.outputMode("update").foreachBatch(store), checkpoint, available_now)


def window_state(spark: SparkSession, root: str, scale: int | None = None) -> DataFrame:
    """ST5: stored state of all windows; feeds ``daily_from_partials`` and ``hourly_from_partials``."""
    return read(spark, root, "windows", window_table(scale)).drop("status_key")


def latest_emission(emitted: DataFrame, keep_emission: bool = False) -> DataFrame:
    """ST5: last emitted state of every window; feeds ``merge_partials`` and ``daily_from_partials``."""
    keys = [*KEYS, "window_start", "date", "status"]
    state = ["n_rows", "n_values", "total", "min", "max", "first_ts"]
    return (emitted.groupBy(*keys)
            .agg(F.max_by(F.struct(*state, F.col("emission").cast("bigint").alias("emission")),
                          F.col("emission").cast("bigint")).alias("s"))
            .select(*keys, *[f"s.{c}" for c in state], *(["s.emission"] if keep_emission else [])))


def hourly_from_partials(partials: DataFrame) -> DataFrame:
    """A3 from hourly partial state."""
    return (
        partials.groupBy(*KEYS, "window_start")
        .agg(F.sum("n_values").alias("n"), F.sum("total").cast("double").alias("total"))
        .filter(F.col("n") > 0)
        .select(*KEYS, hour_label("window_start").alias("x"), (F.col("total") / F.col("n")).alias("y"))
    )


def current_values(readings: DataFrame) -> DataFrame:
    """ST6: running latest reading per series; the state holds one row per series."""
    order = ["ts", *[c for c in ("fetched_at",) if c in readings.columns], "value", "status"]
    return (readings.groupBy(*KEYS)
            .agg(F.max_by(F.struct("ts", "value", "status"), F.struct(*order)).alias("r"))
            .select(*KEYS, "r.*"))


def current_table() -> Table:
    schema = T.StructType([*RAW.fields[:2], RAW["ts"], RAW["value"], RAW["status"]])
    return Table(schema, KEYS, ["bucket"], lambda df: df, ["station_id"])


def start_current(current: DataFrame, root: str, checkpoint: str, compact_after: int = COMPACT_AFTER,
                  available_now: bool = False) -> StreamingQuery:
    """ST6: keep the current value of every series in a versioned table (``read_current`` reads it).

    A batch writes the series that changed; the table is never missing, and groups of
    stations without a change are not rewritten.
    """
    known = {"current": current_table()}

    def store(batch: DataFrame, batch_id: int) -> None:
        version = publish(batch.sparkSession, root, known, {"current": batch}, f"{checkpoint}#{batch_id}")
        if changes_waiting(version) >= compact_after:
            compact(batch.sparkSession, root, known)

    return _started(current.writeStream.outputMode("update").foreachBatch(store), checkpoint, available_now)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """ST6: the current value of every series."""
    return read(spark, root, "current", current_table()).drop("bucket")
