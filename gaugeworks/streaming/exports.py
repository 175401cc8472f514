"""Stream of export files (ST7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.plans.refresh import merge_into_store, stage_name
from gaugeworks.session import shared_dir
from gaugeworks.sources.exports import line_text, stage_export


def export_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """ST7: lines of new export files; with a checkpoint each file is read once."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        line_text().alias("line"))


def start_ingest(lines: DataFrame, raw_path: str, checkpoint: str, daily_path: str | None = None,
                 rejects_path: str | None = None, scale: int | None = None, identity: str = "header",
                 available_now: bool = False) -> StreamingQuery:
    """ST7: parse the files of each micro-batch and merge them into the stored series.

    A file is never split over micro-batches, so its preamble meets its rows; its text is
    parsed once.
    """
    def ingest(batch: DataFrame, batch_id: int) -> None:
        stage = f"{shared_dir(batch.sparkSession).rstrip('/')}/{stage_name('files', raw_path)}"
        export = stage_export(batch, stage, identity)
        if rejects_path is not None:
            export.rejects.write.mode("overwrite").json(f"{rejects_path}/batch={batch_id}")
        merge_into_store(batch.sparkSession, export.raw, raw_path, f"{checkpoint}#{batch_id}",
                         daily_path=daily_path, scale=scale)

    writer = lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
