"""Prefix trie of conversations by whole-sequence collapse.

Equal conversations become one weighted sequence with the list of those that end in
it. A node is a prefix of a sequence, known by its depth and 128 bits that the turns
above it add up to, so that it is found without walking the trie. Sums over subtrees
need no walk either: a node belongs to the sequence of its smallest member, the nodes
of one sequence are a chain down to its end, and what hangs below a node is the rest
of its own chain and the whole chains of the other sequences through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.llm.common import finished, stage
from gaugeworks.llm.links import small_keys

NODE = ["depth", "n1", "n2"]
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 16
"""Ids that are joined to one text before they are hashed; bounds the memory, not the list."""


class Trie(NamedTuple):
    """Tables of a trie.

    ``nodes``: ``depth, n1, n2`` (the node), ``conv_id`` (smallest member), ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. ``sequences``:
    ``conv_id`` (smallest of the equal conversations), ``weight``, ``length, h1, h2`` (its end node) and
    ``leaf``. ``ends``: ``conv_id`` of every conversation with the end node of its sequence.
    """

    nodes: DataFrame
    sequences: DataFrame
    ends: DataFrame


def running(rows: DataFrame, order: list[str], columns: dict[str, str], name: str) -> DataFrame:
    """``rows`` with ``<column>_run``: the sum or xor of the column over the rows of a ``conv_id`` up to this one.

    Rows are dealt out by range and sorted there, so a conversation that holds most of
    them lies in many tasks. What a conversation brings along from the tasks before is
    a table of at most two rows per task.
    """
    act = {"sum": (np.add, np.subtract), "xor": (np.bitwise_xor, np.bitwise_xor)}
    made = [f"{c}_run" for c in columns]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in made], T.StructField("_part", T.IntegerType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, totals = TaskContext.get().partitionId(), None, dict.fromkeys(columns, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            first = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
            starts = np.nonzero(first)[0]
            sizes = np.diff(np.concatenate([[0], starts, [len(ids)]]))
            out = []
            for column, kind in columns.items():
                ahead, back = act[kind]
                added = ahead.accumulate(batch.column(column).to_numpy(zero_copy_only=False))
                bases = np.concatenate([[0], np.where(starts > 0, added[starts - 1], 0)]).astype(np.int64)
                total = back(added, np.repeat(bases, sizes))
                total[:sizes[0]] = ahead(total[:sizes[0]], np.int64(totals[column]))
                totals[column] = total[-1]
                out.append(pa.array(total))
            last = ids[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(len(ids), part, np.int32))], schema.fieldNames())

    ordered = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    local = stage(ordered.mapInArrow(add_up, schema), name)
    over = (local.groupBy("conv_id").agg(F.min("_part").alias("low"), F.max("_part").alias("high"))
            .where("low < high").select("conv_id"))
    whole = {"sum": F.sum, "xor": F.bit_xor}
    sums = (local.join(F.broadcast(over), "conv_id").groupBy("conv_id", "_part")
            .agg(*[whole[kind](c).alias(c) for c, kind in columns.items()]))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = sums.select("conv_id", "_part", *[F.coalesce(whole[kind](c).over(before), F.lit(0)).alias(f"_{c}") for c, kind in columns.items()])
    joined = local.join(F.broadcast(brought), ["conv_id", "_part"], "left")
    for column, kind in columns.items():
        more = F.coalesce(f"_{column}", F.lit(0))
        run = F.col(f"{column}_run")
        joined = joined.withColumn(f"{column}_run", run + more if kind == "sum" else run.bitwiseXOR(more))
    return joined.select(*rows.columns, *made)


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, role, text``: the turns of each conversation, counted from 0.

    Turns come in the order of ``turn`` (null first), equal ones by role, then text. A null
    role or text is empty. Rows without a conv_id belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"))
    counted = running(rows, ["turn", "role", "text"], {"one": "sum"}, "turns")
    return counted.select("conv_id", (F.col("one_run") - 1).alias("pos"), "role", "text")


def turn_marks(turns: DataFrame) -> DataFrame:
    """What the trie needs of turns instead of their texts: 128 bits (``x1, x2``) and ``words``."""
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")
    return turns.select(*[c for c in turns.columns if c not in ("role", "text")], F.xxhash64(F.lit(1), "role", "text").alias("x1"),
                        F.xxhash64(F.lit(2), "role", "text").alias("x2"), words.alias("words"))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> Trie:
    """The trie of ``turns`` (``conv_id, pos, x1, x2, words``; pos from 0, gapless) of the ``conversations`` (``conv_id``).

    Conversations without turns end in the root. No conversations, no nodes. Other columns
    are left out. Turns and prefixes are told apart by 128 bits.
    """
    return Trie(*_built(turns, conversations))


def _built(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = turns.sparkSession
    marks = stage(turns.select("conv_id", "pos", F.xxhash64("pos", "x1").alias("t1"), F.xxhash64("pos", "x2").alias("t2"), "words"), "marks")
    whole = marks.groupBy("conv_id").agg(F.bit_xor("t1").alias("h1"), F.bit_xor("t2").alias("h2"), F.count("*").alias("length"))
    zero = F.lit(0).cast("long")
    ends = stage(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct()
                 .join(whole, "conv_id", "left")
                 .select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("length", "h1", "h2")]), "ends")
    # Equal conversations collapse to one sequence, known by the smallest.
    sequences = stage(ends.groupBy("length", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "sequences")
    kept = finished(spark, lambda: running(
        marks.join(small_keys(sequences.select("conv_id", "weight", "length")), "conv_id"), ["pos"], {"t1": "xor", "t2": "xor"}, "chains"), "prefixes")
    prefixes = kept.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("t1_run").alias("n1"), F.col("t2_run").alias("n2"),
                           F.col("t1_run").bitwiseXOR(F.col("t1")).alias("p1"), F.col("t2_run").bitwiseXOR(F.col("t2")).alias("p2"), "words", "weight", "length")
    root = sequences.select("conv_id", *[zero.alias(c) for c in (*NODE, "p1", "p2", "words")], "weight", "length")
    prefixes = prefixes.union(root.select(prefixes.columns))
    # Sequences that are proper prefixes of others are no leaves.
    proper = prefixes.where("depth < length").select(F.col("depth").alias("length"), F.col("n1").alias("h1"), F.col("n2").alias("h2")).distinct()
    leaves = sequences.join(proper, ["length", "h1", "h2"], "left_anti").select(F.col("length").alias("depth"), F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.lit(1).alias("leaf"))
    weighed = prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"),
                                          F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    children = (prefixes.where("depth > 0").select(*NODE, "p1", "p2").distinct()
                .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children")))
    nodes = stage(weighed.join(children, NODE, "left").join(leaves, NODE, "left").select(
        *NODE, "conv_id", "n_convs", "p1", "p2", F.coalesce("n_children", zero).alias("n_children"), F.coalesce(F.col("leaf").cast("long"), zero).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (-F.col("depth")).alias("up")), "nodes")
    return _summed(nodes, prefixes, ends), sequences.join(
        leaves.select(F.col("depth").alias("length"), F.col("n1").alias("h1"), F.col("n2").alias("h2"), F.lit(True).alias("leaf")), ["length", "h1", "h2"], "left").fillna(False, "leaf"), ends


def _summed(nodes: DataFrame, prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with their sums over subtrees, their parents and the digests of the lists of ends."""
    below = running(nodes, ["up"], {"leaf": "sum", "saved": "sum"}, "chain-sums")
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    hanging = (prefixes.select("conv_id", *NODE).join(chains, "conv_id").where("depth < top")
               .groupBy(*NODE).agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    zero, empty = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    digests = end_digests(ends).select(F.col("length").alias("depth"), F.col("h1").alias("n1"), F.col("h2").alias("n2"), "digest")
    return (below.join(hanging, NODE, "left").join(parents, ["depth", "p1", "p2"], "left").join(digests, NODE, "left")
            .select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children",
                    (F.col("leaf_run") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
                    (F.col("saved_run") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
                    F.coalesce("digest", empty).alias("ends_sha256")))


def end_digests(ends: DataFrame) -> DataFrame:
    """``length, h1, h2, digest``: SHA-256 of the ids that end in a sequence, ascending, with commas between.

    Ids are sorted by range. A list inside a range is hashed there; one that meets an edge
    of its range is sent on in joined chunks and hashed as they come, so neither kind is
    ever held as a whole (the hash itself has to read its list in order).
    """
    key = ["length", "h1", "h2"]
    schema = "length bigint, h1 bigint, h2 bigint, part int, chunk bigint, ids string, digest string"
    names = [*key, "part", "chunk", "ids", "digest"]

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of one range: those at its edges and very long ones go on in chunks, the others are hashed."""
        part, now, held, count, goes_on = TaskContext.get().partitionId(), None, [], 0, True
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names)

        def chunk() -> tuple:
            return (*now, part, count, ",".join(held), None)

        for batch in batches:
            out = []
            for *at, conv in zip(*[batch.column(c).to_pylist() for c in (*key, "conv_id")]):
                if at != now:
                    if goes_on and held:
                        out.append(chunk())
                    elif not goes_on:
                        out.append((*now, part, 0, None, hashlib.sha256(",".join(held).encode()).hexdigest()))
                    goes_on = now is None
                    now, held, count = at, [], 0
                held.append(str(conv))
                if len(held) >= CHUNK:
                    out.append(chunk())
                    held, count, goes_on = [], count + 1, True
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([chunk()])

    def hash_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *at, ids in zip(*[batch.column(c).to_pylist() for c in (*key, "ids")]):
                if at != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*key, "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], [*key, "digest"])

    ordered = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    found = stage(ordered.mapInArrow(join_up, schema), "end-lists")
    parts = found.where("digest is null").repartition(*key).sortWithinPartitions(*key, "part", "chunk")
    return found.where("digest is not null").select(*key, "digest").union(
        parts.mapInArrow(hash_up, "length bigint, h1 bigint, h2 bigint, digest string"))


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]


def rebuilt(turns: DataFrame, head: Column, base: Column) -> DataFrame:
    """Conversations with another one's beginning: ``conv_id, pos`` and the other columns of ``turns``.

    A conversation gets the first ``head`` turns of conversation ``base`` (all if it has
    fewer, none if it is not there), then its own after its first ``head``. Both are
    functions of ``conv_id``; ``head`` is at most 3, so a base is asked for few turns.
    """
    most = 3
    other = [c for c in turns.columns if c not in ("conv_id", "pos")]
    ids = turns.select("conv_id").distinct().select("conv_id", head.alias("head"), base.alias("base"))
    starts = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", *other)
    sizes = starts.groupBy("base").agg(F.count("*").alias("has"))
    known = ids.join(sizes, "base", "left").select("conv_id", "head", "base", F.least("head", F.coalesce("has", F.lit(0))).alias("given"))
    heads = known.join(starts, "base").where(F.col("pos") < F.col("head")).select("conv_id", "pos", *other)
    own = (turns.join(small_keys(known.select("conv_id", "head", "given")), "conv_id").where(F.col("pos") >= F.col("head"))
           .select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), *other))
    return heads.union(own)
