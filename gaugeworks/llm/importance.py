"""Importance resampling of documents towards a target.

Two bags of hashed uni- and bigrams are estimated, one of the target texts and one of
all texts. A document's log weight is its log likelihood ratio under the two. Adding
Gumbel noise and keeping the largest keys draws a sample without replacement in
proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import positions, row_key, stage
from gaugeworks.llm.links import small_keys
from gaugeworks.llm.shingles import text_words

BUCKETS = 10_000
SMOOTHING = 1.0


def buckets_of(text: str, buckets: int) -> np.ndarray:
    """Hashed buckets of the words and of the pairs of neighbouring words of the whole text."""
    words = text_words(text)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    grams = np.concatenate([words, pairs])
    grams ^= grams >> np.uint64(32)
    return (grams * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(buckets)


def bucket_counts(texts: DataFrame, target: Column, buckets: int = BUCKETS, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all texts and over the target ones, of every row of the table.

    Tasks add up what they read; at most ``buckets`` rows reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, is_target in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    found = np.bincount(buckets_of(text.as_py(), buckets).astype(np.int64), minlength=buckets)
                    total[0] += found
                    if is_target.as_py():
                        total[1] += found
        at = np.nonzero(total[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[0][at]), pa.array(total[1][at])],
                                         ["bucket", "raw", "target"])

    raw, goal = np.zeros(buckets), np.zeros(buckets)
    counted = texts.select(text_col, target).mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    for row in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row["bucket"]], goal[row["bucket"]] = row["raw"], row["target"]
    return raw, goal


def log_ratio(raw: np.ndarray, goal: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    p = (goal + smoothing) / (goal.sum() + smoothing * len(goal))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def resample(docs: DataFrame, targets: DataFrame, fraction: float, seed: int = 0, buckets: int = BUCKETS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, ``n_grams``, ``log_weight``, ``key``, ``position`` (0: largest key) and ``selected``.

    ``targets`` holds the ids of the target documents. ``round(fraction * rows)`` rows are
    selected, exactly. Log weights are sums over the whole text. A null or empty text,
    or one without words, has weight 1 (log weight 0). Noise depends on seed, id and
    text, so a run repeated gives the same sample; rows equal in both share their key
    and take neighbouring places. Null ids match no target. Other columns are ignored.
    """
    marks = small_keys(stage(targets.select(F.col(id_col).alias("_target")).where("_target is not null").distinct(), "targets"))
    rows = docs.select(F.col(id_col), F.col(text_col))
    joined = rows.join(marks, F.col(id_col) == F.col("_target"), "left")
    raw, goal = bucket_counts(joined, F.col("_target").isNotNull(), buckets, text_col)
    ratio = log_ratio(raw, goal)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("k1", T.LongType()),
                           T.StructField("k2", T.LongType()), T.StructField("n_grams", T.LongType()),
                           T.StructField("log_weight", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            for text in batch.column(3):
                found = buckets_of(text.as_py(), buckets) if text.is_valid else ()
                sizes.append(len(found))
                weights.append(float(ratio[np.asarray(found, np.int64)].sum()) if len(found) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2),
                                              pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())],
                                             schema.fieldNames())

    scored = docs.select(id_col, *row_key(id_col, text_col), text_col).mapInArrow(score, schema)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k1", "k2"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = stage(scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
                  .withColumn("_last_first", -F.col("key")).withColumn("_id", F.monotonically_increasing_id()), "weights")
    wanted = round(fraction * keyed.count())
    return (positions(keyed, ["_last_first", "k1", "_id"], "sample")
            .withColumn("selected", F.col("position") < wanted)
            .select(id_col, "n_grams", "log_weight", "key", "position", "selected"))
