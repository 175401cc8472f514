"""On-time, repeated and late readings of a stream, each kept (ST2, ST4).

A reading is late if the watermark has passed it when it arrives, repeated if its series
had the same instant with the same value before, and on time otherwise. What has been
seen is held per series and day, so a station that sends most readings is spread over
its days, and is given up by a timer once the watermark has passed the day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeworks.schema import KEYS, RAW

ON_TIME, REPEATED, LATE = "on_time", "repeated", "late"
DAY_MS = 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType()))])
OUTPUT = T.StructType([*RAW.fields, T.StructField("outcome", T.StringType())])


class Arrivals(StatefulProcessor):
    """Sorts the readings of one series and day; holds the instants and values that were on time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, day = timerValues.getCurrentWatermarkInMs(), key[2]
        held = self.seen.get() if self.seen.exists() else None
        # None stands for a missing value, since NaN equals nothing.
        known = set(zip(held[0], held[1])) if held else set()
        before = len(known)
        for frame in rows:
            micros = frame["micros"].tolist()
            values = [None if pd.isna(v) else v for v in frame["value"]]
            outcome = []
            for at, value in zip(micros, values):
                if at // 1000 < watermark:
                    outcome.append(LATE)
                elif (at, value) in known:
                    outcome.append(REPEATED)
                else:
                    known.add((at, value))
                    outcome.append(ON_TIME)
            yield frame.assign(outcome=outcome)[OUTPUT.fieldNames()]
        if len(known) > before:
            if not before:
                self.handle.registerTimer((day + 1) * DAY_MS)
            self.seen.update(([k[0] for k in known], [k[1] for k in known]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def arrivals(readings: DataFrame, delay: str = "7 days") -> DataFrame:
    """``readings`` (raw schema) with ``outcome``: every row comes out once, in append mode.

    The watermark is that of all series: the newest reading of the batches before, less
    ``delay``. Rows without an instant are late. The watermark column itself is dropped before the
    stateful step, which would otherwise never see late rows.
    """
    marked = readings.withColumn("_event", F.col("ts").cast("timestamp")).withWatermark("_event", delay)
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62)))
    keyed = marked.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields], micros.alias("micros")).withColumn(
        "day", F.floor(F.col("micros") / F.lit(DAY_MS * 1000)).cast("long"))
    return keyed.groupBy(*KEYS, "day").transformWithStateInPandas(Arrivals(), OUTPUT, "Append", "EventTime")


def start_arrivals(readings: DataFrame, path: str, checkpoint: str, delay: str = "7 days", available_now: bool = False) -> StreamingQuery:
    """Stores what ``arrivals`` finds below ``path``, a folder per batch and outcome.

    One write serves the three outputs; a repeated batch replaces its own folders. State
    lies in RocksDB, which spills to disk.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={batch_id}")

    spark = readings.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        writer = arrivals(readings, delay).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def read_arrivals(spark, path: str) -> DataFrame:
    """All stored readings with ``outcome``."""
    schema = T.StructType([*OUTPUT.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(path).drop("batch")
