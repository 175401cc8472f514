"""Merging new readings into a stored series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.schema import KEYS

# Columns that order the new readings among themselves, where present.
SEQUENCE = ["fetched_at", "source_file"]
BROADCAST_CHANGES = 1_000_000
"""Most keys of changes that go to every task."""


def _tagged(df: DataFrame, origin: int, with_sequence: bool) -> DataFrame:
    extra: list[Column] = []
    for name in SEQUENCE:
        known = with_sequence and name in df.columns
        extra.append((F.col(name) if known else F.lit(None)).cast("string").alias(name))
    return df.select(*KEYS, "ts", "value", "status", F.lit(origin).alias("origin"), *extra)


def lay_over(stored: DataFrame, changes: DataFrame, keys: list[str], n_changes: int) -> DataFrame:
    """U2 as a change set: stored rows whose key does not change, and the changes.

    Both sides hold a key once. Up to ``BROADCAST_CHANGES`` counted changes their keys go to
    the stored rows, which are neither sorted nor shuffled; beyond, the same join shuffles.
    """
    changed = changes.select(*keys)
    kept = stored.join(F.broadcast(changed) if n_changes <= BROADCAST_CHANGES else changed, keys, "left_anti")
    return kept.unionByName(changes)


def replaced_rows(stored: DataFrame, changes: DataFrame, keys: list[str], n_changes: int) -> DataFrame:
    """Stored rows that ``lay_over`` leaves out."""
    changed = changes.select(*keys)
    return stored.join(F.broadcast(changed) if n_changes <= BROADCAST_CHANGES else changed, keys, "left_semi")


def fold_new(new: DataFrame) -> DataFrame:
    """One row per (station, parameter, ts) of new readings: the last by ``fetched_at``, then ``source_file``."""
    return merge_last_wins(new.limit(0).select(*KEYS, "ts", "value", "status"), new)


def merge_last_wins(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Concatenate and keep the last row per (station, parameter, ts).

    New beats stored, and among new rows the later ``fetched_at`` (then
    ``source_file``) wins. Copies are folded map-side, so an instant that was sent
    a million times costs one row per task. ``existing`` may repeat instants; where it
    is known not to, as in a store, ``lay_over`` leaves its rows where they are.
    """
    rows = _tagged(existing, 0, False).unionByName(_tagged(new, 1, True))
    order = F.struct("origin", *SEQUENCE, "value", "status")
    return (
        rows.groupBy(*KEYS, "ts")
        .agg(F.max_by(F.struct("value", "status"), order).alias("r"))
        .select(*KEYS, "ts", "r.value", "r.status")
    )


def dedup_last(raw: DataFrame) -> DataFrame:
    """U2 on one frame, for exports that overlap."""
    return merge_last_wins(raw.limit(0), raw)


def merge_report(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Stored, new and merged row counts per series, and the net gain."""
    rows = (existing.select(*KEYS, "ts", F.lit(1).alias("old"), F.lit(0).alias("new"))
            .unionByName(new.select(*KEYS, "ts", F.lit(0).alias("old"), F.lit(1).alias("new"))))
    per_ts = rows.groupBy(*KEYS, "ts").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    return (
        per_ts.groupBy(*KEYS)
        .agg(F.sum("old").alias("n_existing"), F.sum("new").alias("n_new"),
             F.count(F.lit(1)).alias("n_merged"))
        .withColumn("net_new", F.col("n_merged") - F.col("n_existing"))
    )


def new_readings(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming readings that are not stored with the same timestamp and value.

    The same timestamp with another value is a revision and passes.
    """
    i, s = incoming.alias("i"), stored.select(*KEYS, "ts", "value").alias("s")
    same = [F.col(f"i.{c}") == F.col(f"s.{c}") for c in [*KEYS, "ts"]]
    same.append(F.col("i.value").eqNullSafe(F.col("s.value")))
    return i.join(s, same, "left_anti")


def live_or_daily(latest_daily: DataFrame, latest_live: DataFrame) -> DataFrame:
    """The live value where there is one, otherwise the latest daily mean.

    Only a missing live value falls back; a live 0 is a value.
    """
    day = latest_daily.select(*KEYS, F.col("mean").alias("daily_mean"),
                              F.col("date").cast("string").alias("daily_date"))
    now = latest_live.select(*KEYS, F.col("value").alias("live_value"),
                             F.col("ts").cast("string").alias("live_ts"))
    return day.join(now, KEYS, "full_outer").select(
        *KEYS,
        F.coalesce("live_value", "daily_mean").alias("value"),
        F.when(F.col("live_value").isNotNull(), F.col("live_ts"))
        .otherwise(F.col("daily_date")).alias("as_of"),
        F.col("live_value").isNotNull().alias("is_live"))
