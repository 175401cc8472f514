"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, exactly as a
uniform permutation of all rows would distribute them (multivariate hypergeometric).
Partitions permute their rows locally, cut them by their row of the matrix, exchange
once and permute again inside the shard: a second draw orders its rows, and the number of
rows per range of that draw, counted before, gives each range its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import ROW_BITS, stage

SPREAD = 12.0
"""Standard deviations on either side of the mode that a draw looks at; what lies beyond weighs under 1e-30."""

BROADCAST_CELLS = 4_000_000
"""Most cells of the matrix that go to every task; beyond, its join shuffles."""
RANGE_ROWS, RANGES = 4096, 1 << 20
"""Rows planned for a range of a shard, which is sorted in one piece, and most ranges of all shards."""


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows out of ``total`` are among the ``good`` ones, by inversion with ``u`` in [0, 1).

    Weights start at 1 at the lower end and follow from their neighbours' ratio, so no
    factorial is needed; the work grows with the standard deviation.
    """
    n, share = total.cast("double"), good / F.greatest(total, F.lit(1))
    spread = F.sqrt(draws * share * (1 - share) * (n - draws) / F.greatest(n - 1, F.lit(1.0)))
    mode = F.floor((draws + 1.0) * (good + 1.0) / (n + 2.0))
    half = F.ceil(F.lit(SPREAD) * spread).cast("long") + 20
    low = F.greatest(F.lit(0).cast("long"), draws + good - total, mode - half)
    high = F.least(draws, good, mode + half)
    ratio = lambda k: ((good - k) * 1.0) * (draws - k) / ((k + 1.0) * (total - good - draws + k + 1))
    steps = F.sequence(low, high)
    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    mass = F.aggregate(steps, zero, lambda s, k: F.struct((s["w"] * F.when(k < high, ratio(k)).otherwise(0.0)).alias("w"),
                                                          (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
    start = F.struct(F.lit(1.0).alias("w"), (u * mass).alias("left"), low.alias("at"))
    return F.aggregate(steps, start,
                       lambda s, k: F.struct((s["w"] * F.when(k < high, ratio(k)).otherwise(0.0)).alias("w"),
                                             (s["left"] - s["w"]).alias("left"),
                                             F.when(s["left"] > 0, k).otherwise(s["at"]).alias("at")),
                       lambda s: s["at"])


def _split(caps: Column, rows: Column, draws: Column, seed: int, node: Column, shards: int) -> Column:
    """How many of ``draws`` rows fall into each shard when the node's ``rows`` rows fill ``caps``."""
    def step(state: Column, s: Column) -> Column:
        cap = F.element_at(caps, s + 1)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, s), 11) / F.lit(float(1 << 53))
        taken = _hypergeometric(state["rest"], cap, state["draws"], u)
        return F.struct((state["rest"] - cap).alias("rest"), (state["draws"] - taken).alias("draws"),
                        F.concat(state["out"], F.array(taken)).alias("out"))

    zero = F.struct(rows.alias("rest"), draws.alias("draws"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), zero, step, lambda s: s["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``part`` and ``ends`` (running totals by shard) for partitions of ``sizes`` (``part``, ``n``).

    Partitions are halved again and again; each half draws its share of its node's
    shard capacities. The table has one row per partition at any time.
    """
    order = Window.orderBy("part")
    sizes = stage(sizes.select("part", "n", (F.row_number().over(order) - 1).cast("long").alias("at"),
                               (F.sum("n").over(order) - F.col("n")).alias("before")), "matrix")
    count, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    width = 1 << max(count - 1, 0).bit_length()
    nodes = sizes.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"), F.lit(total).cast("long").alias("n"),
        F.array(*[F.lit(c).cast("long") for c in caps]).alias("caps"))
    starts = sizes.select(F.col("at").alias("mid"), F.col("before").alias("mid_before"))
    while width > 1:
        width //= 2
        halves = (nodes.withColumn("mid", F.col("at") + width).join(starts, "mid", "left")
                  .withColumn("mid_before", F.coalesce("mid_before", F.col("before") + F.col("n")))
                  .withColumn("draws", F.col("mid_before") - F.col("before")))
        halves = halves.withColumn("left", _split(F.col("caps"), F.col("n"), F.col("draws"), seed,
                                                  F.col("mid"), shards))
        rest = F.zip_with("caps", "left", lambda a, b: a - b)
        nodes = halves.select(F.explode(F.array(
            F.struct("at", "before", F.col("draws").alias("n"), F.col("left").alias("caps")),
            F.struct(F.col("mid").alias("at"), F.col("mid_before").alias("before"),
                     (F.col("n") - F.col("draws")).alias("n"), rest.alias("caps")))).alias("h")).select("h.*")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)),
                       lambda s: F.aggregate(F.slice("caps", 1, s), F.lit(0).cast("long"), lambda a, b: a + b))
    return nodes.join(sizes.select("at", "part"), "at").select("part", ends.alias("ends"))


def _range_bits(total: int, shards: int) -> int:
    """Leading bits of the second draw that name a range: ranges of some thousand rows, ``RANGES`` in all at most."""
    wanted = min(-(-total // (shards * RANGE_ROWS)), max(RANGES // shards, 1))
    return max(wanted, 1).bit_length() - 1


def shard(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (place in the shard, from 0, gapless).

    Shard sizes differ by at most one row (the first shards take the rest) and every
    assignment of rows to places is equally likely. Values are never looked at: null
    fields, empty or very long texts and repeated rows are rows like any other, so no
    value can make a shard or a task hot. Columns named ``shard``, ``slot`` or with a
    leading ``_`` are rejected; an empty table gives an empty one. Same seed and same
    input partitions give the same result.
    """
    clash = [c for c in df.columns if c.lower() in ("shard", "slot") or c.startswith("_")]
    if clash:
        raise ValueError(f"column names are taken: {clash}")
    local = (df.select("*", F.rand(seed).alias("_draw")).sortWithinPartitions("_draw")
             .withColumn("_id", F.monotonically_increasing_id()).drop("_draw"))
    part = F.shiftright("_id", ROW_BITS)
    local = stage(local, "permuted").withColumn("_part", part)
    sizes = stage(local.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n")), "part-sizes")
    matrix = stage(communication_matrix(sizes, shards, seed), "matrix")
    count, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    matrix = F.broadcast(matrix) if count * shards <= BROADCAST_CELLS else matrix
    bits = _range_bits(total, shards)
    rank = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    draw = F.xxhash64(F.lit(seed + 1), "_id")
    dealt = (local.join(matrix, F.col("_part") == F.col("part"))
             .withColumn("shard", F.size(F.filter("ends", lambda e: e <= rank))).withColumn("_draw", draw)
             .withColumn("_range", F.shiftrightunsigned("_draw", 64 - bits) if bits else F.lit(0).cast("long"))
             .drop("part", "ends", "_part"))
    # Where each range of draws starts in its shard is counted without the rows' other columns.
    by_range = Window.partitionBy("shard").orderBy("_range")
    first = stage(dealt.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
                  .select("shard", "_range", (F.sum("_n").over(by_range) - F.col("_n")).alias("_first")), "range-starts")
    within = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_draw", "_id")) - 1
    return (dealt.withColumn("_within", within).join(F.broadcast(first), ["shard", "_range"])  # at most RANGES rows
            .withColumn("slot", F.col("_first") + F.col("_within")).select(*df.columns, "shard", "slot"))
