"""Nearest observation to a point in time.

Spark has no public as-of join. A window over a whole series would put a long
series into one task, so time is cut into slots and every slot is answered on
its own, after it has been given the nearest observation on either side of it:

* observations and probes are folded to one row per (series, instant), which
  also answers exact matches and makes copies harmless;
* slots are summarised to their first and last observation (hash aggregate);
* a window per (series, day) over slots and one per series over days carry the
  edges. They see at most one row per slot of a day and one per calendar day;
* instants and carried edges meet in one window per (series, slot).

Choose ``slot`` so that it holds few readings. The number of rows in a slot is
bounded by the clock of the sensor and not by the number of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.functions.plans import evaluated_once
from gaugeworks.functions.scalars import day_of
from gaugeworks.schema import KEYS


def _instants(probes: DataFrame, obs: DataFrame, slot: str) -> DataFrame:
    """One row per (series, instant): the observed value, if any, and whether it is probed."""
    observed = obs.select(*KEYS, "ts", "value", F.lit(0).alias("probe")).filter(F.col("value").isNotNull())
    asked = probes.select(*KEYS, F.col("probe_ts").alias("ts"), F.lit(None).cast("double").alias("value"),
                          F.lit(1).alias("probe"))
    folded = (
        observed.unionByName(asked).filter(F.col("ts").isNotNull())
        .groupBy(*KEYS, "ts").agg(F.max("value").alias("value"), F.max("probe").alias("probe"))
        .withColumn("slot", F.window("ts", slot).getField("start"))
        .withColumn("day", day_of("slot"))
    )
    # All later steps read this one shuffle; the boundary keeps their filters out of it.
    return evaluated_once(folded)


def _carry(df: DataFrame, keys: list[str], order: str, prefix: str) -> DataFrame:
    """The last observation before and the first one after each row's own slot."""
    by_time = W.partitionBy(*keys).orderBy(order)
    against_time = W.partitionBy(*keys).orderBy(F.col(order).desc())
    earlier = by_time.rowsBetween(W.unboundedPreceding, -1)
    later = against_time.rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({
        f"{prefix}_before": F.last("last_obs", ignorenulls=True).over(earlier),
        f"{prefix}_after": F.last("first_obs", ignorenulls=True).over(later),
    })


def _observation(ts: str, value: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")))


def _edges(instants: DataFrame) -> DataFrame:
    """Per slot with a probe: the nearest observation outside of it on either side."""
    seen_at = F.when(F.col("value").isNotNull(), F.col("ts"))
    extremes = {"first_ts": F.min(seen_at), "first_value": F.min_by("value", seen_at),
                "last_ts": F.max(seen_at), "last_value": F.max_by("value", seen_at)}
    # Days and slots read the same shuffle; without the boundary each would prune its own columns.
    slots = evaluated_once(instants.groupBy(*KEYS, "day", "slot").agg(
        *[c.alias(name) for name, c in extremes.items()], F.max("probe").alias("probe")))
    days = slots.groupBy(*KEYS, "day").agg(
        F.min("first_ts").alias("first_ts"), F.min_by("first_value", "first_ts").alias("first_value"),
        F.max("last_ts").alias("last_ts"), F.max_by("last_value", "last_ts").alias("last_value"))

    def sides(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, _observation("first_ts", "first_value").alias("first_obs"),
                         _observation("last_ts", "last_value").alias("last_obs"))

    within_day = _carry(sides(slots, *KEYS, "day", "slot", "probe"), [*KEYS, "day"], "slot", "slot")
    across_days = _carry(sides(days, *KEYS, "day"), KEYS, "day", "day")
    return (
        within_day.filter(F.col("probe") == 1)
        .join(across_days.select(*KEYS, "day", "day_before", "day_after"), [*KEYS, "day"])
        .select(*KEYS, "slot", F.explode(F.array(F.coalesce("slot_before", "day_before"),
                                                 F.coalesce("slot_after", "day_after"))).alias("obs"))
        .filter(F.col("obs").isNotNull())
        .select(*KEYS, "slot", "obs.ts", "obs.value", F.lit(0).alias("probe"))
    )


def nearest_observation(probes: DataFrame, obs: DataFrame, slot: str = "1 hour",
                        unique_probes: bool = False) -> DataFrame:
    """For each probe the observation nearest in time, of the same series.

    An exact match wins, a tie goes to the earlier observation, and a probe
    outside the data gets the first or the last observation. ``probes`` has
    ``station_id, parameter, probe_ts`` and any other columns; ``obs`` has
    ``station_id, parameter, ts, value``. Of equal timestamps the highest value
    counts. ``unique_probes`` saves the join back to the probes when no instant
    occurs twice and no other columns are to be kept. ``slot`` must divide a day.
    """
    instants = _instants(probes, obs, slot)
    events = (
        instants.select(*KEYS, "slot", "ts", "value", "probe").unionByName(_edges(instants))
        .withColumn("o", _observation("ts", "value"))
    )
    over_slot = "OVER (PARTITION BY station_id, parameter, slot ORDER BY ts)"
    answered = (
        events.withColumns({
            "before": F.expr(f"lag(o, 1) IGNORE NULLS {over_slot}"),
            "after": F.expr(f"lead(o, 1) IGNORE NULLS {over_slot}"),
        })
        .filter(F.col("probe") == 1)
    )

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    nearer_after = (micros("after.ts") - micros("ts")) < (micros("ts") - micros("before.ts"))
    neighbour = F.when(F.col("before").isNull() | nearer_after, F.col("after")).otherwise(F.col("before"))
    result = answered.withColumn("n", F.coalesce("o", neighbour)).select(
        *KEYS, F.col("ts").alias("probe_ts"), F.col("n.ts").alias("obs_ts"), F.col("n.value").alias("value"))
    if unique_probes:
        return result
    return probes.join(result, [*KEYS, "probe_ts"], "left")
