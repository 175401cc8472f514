"""Export files waiting to be taken over."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What to do with a file that is already there in another size.
CONFLICT_POLICIES = ["skip", "overwrite", "backup"]


def list_exports(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Files below ``path`` with their ``folder`` (below it) and ``name``; their content is not read."""
    root = re.escape(urlparse(path).path.rstrip("/"))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", "modificationTime", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                F.regexp_extract("path", root + r"/(?:(.*)/)?[^/]+$", 1).alias("folder"))
    )


def plan_updates(updates: DataFrame, target: DataFrame, on_conflict: str = "skip") -> DataFrame:
    """The action for each update file, by ``folder``, ``name`` and ``length``.

    Files of the same name in two folders have nothing to do with each other; of several
    targets one of equal length is enough.

    ``applied`` is true where the target holds the update once the action is done.
    """
    if on_conflict not in CONFLICT_POLICIES:
        raise ValueError(f"on_conflict must be one of {CONFLICT_POLICIES}, not {on_conflict!r}")
    place = ["folder", "name"]
    have = target.groupBy(*place).agg(F.max("length").alias("target_length"))
    same = target.select(*place, "length", F.lit(True).alias("same")).distinct()
    action = (F.when(F.col("target_length").isNull(), "copy")
              .when(F.col("same"), "already_applied")
              .otherwise(on_conflict))
    return (updates.join(have, place, "left").join(same, [*place, "length"], "left")
            .withColumn("action", action).drop("same")
            .withColumn("applied", F.col("action") != "skip"))
