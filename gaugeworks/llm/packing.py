"""Shortest-pack-first packing of token pieces into fixed sequences.

Documents are tokenized and cut into pieces of at most one sequence. Only the
histogram of piece lengths is packed: lengths are placed longest first, each into the
pattern with the most room, many copies at once. The patterns are then joined back:
the pieces of a length are numbered, and ranges of these numbers belong to patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.llm.common import stage
from gaugeworks.llm.links import small_keys
from gaugeworks.llm.tokens import ByteLevelIds, give_back, remembered

BIN_ROWS = 50_000
BATCH_BYTES = 2 << 20


def token_pieces(docs: DataFrame, path: str, ranks_path: str, pattern: str, length: int, end_id: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized documents, each followed by ``end_id``, in pieces of at most ``length`` ids.

    Columns: the id column, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit
    bytes), ``doc_tokens``. A null text is an empty one: one piece with ``end_id``.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("doc_tokens", T.LongType())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = remembered(ByteLevelIds, path, ranks_path, pattern)
        for batch in batches:
            names, rows, held = batch.column(0), ([], [], [], [], []), 0
            for i, text in enumerate(batch.column(1)):
                ids = encode.text(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    for column, value in zip(rows, (i, start, size, ids[4 * start:4 * (start + size)], n)):
                        column.append(value)
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield _batch(names, rows)
                    rows, held = ([], [], [], [], []), 0
            yield _batch(names, rows)
            give_back()

    def _batch(names, rows):
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
             pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int64())], schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ``(((length, copies), ...), count)`` that place every piece of the histogram once.

    Longest lengths first; each goes to the patterns with the most room left, as many
    as there are, and opens new ones when none has room. A pattern takes several
    copies of a length where they fit. Work depends on ``length`` only.
    """
    by_room: list[dict[tuple, int]] = [{} for _ in range(length + 1)]
    for size in sorted(histogram, reverse=True):
        left, room = histogram[size], length
        while left:
            while room >= size and not by_room[room]:
                room -= 1
            if room < size:  # nothing has room: new patterns of this length alone
                copies = length // size
                full, rest = divmod(left, copies)
                for n, count in ((copies, full), (rest, 1)):
                    if n and count:
                        target = by_room[length - n * size]
                        key = ((size, n),)
                        target[key] = target.get(key, 0) + count
                break
            pattern, count = by_room[room].popitem()
            copies = min(room // size, max(1, -(-left // count)))
            used = min(count, left // copies)
            if not used:
                copies, used = left, 1
            if count > used:
                by_room[room][pattern] = count - used
            key = (*pattern, (size, copies))
            target = by_room[room - copies * size]
            target[key] = target.get(key, 0) + used
            left -= used * copies
    return [(pattern, count) for group in by_room for pattern, count in group.items()]


def pattern_ranges(patterns, start_id: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, count, first_sequence, offset, copies)``: pieces of a length with ranks from
    ``first_rank`` go to sequences from ``first_sequence``, ``copies`` each, from ``offset`` on."""
    next_rank: dict[int, int] = {}
    out, sequence = [], start_id
    for pattern, count in patterns:
        offset = 0
        for size, copies in pattern:
            rank = next_rank.get(size, 0)
            out.append((size, rank, count * copies, sequence, offset, copies))
            next_rank[size] = rank + count * copies
            offset += size * copies
        sequence += count
    return out


def pack(pieces: DataFrame, length: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``length``) with ``sequence_id`` and ``offset``.

    Every piece is placed once; offsets in a sequence are gapless from 0. The driver
    holds the histogram and its patterns, whose number depends on ``length``, never on
    the number of pieces. Pieces of one length are numbered in bins, so a length that
    most pieces share is no hot group; only their numbers and lengths are moved for that.
    Extra columns pass through; ``sequence_id``,
    ``offset`` and names with a leading ``_`` are rejected. Lengths that are null or out
    of range raise an error; an empty table gives an empty one.
    """
    clash = [c for c in pieces.columns if c in ("sequence_id", "offset") or c.startswith("_")]
    if clash:
        raise ValueError(f"column names are taken: {clash}")
    pieces = stage(pieces.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(k is None or not 1 <= k <= length for k in histogram):
        raise ValueError(f"lengths must lie between 1 and {length}")
    spark = pieces.sparkSession
    ranges = pattern_ranges(shortest_pack_first(histogram, length))
    bins = max(1, max(histogram.values(), default=0) // bin_rows)
    binned = pieces.select("_id", "length").withColumn("_bin", F.pmod(F.xxhash64("_id"), F.lit(bins)).cast("int"))
    counts = binned.groupBy("length", "_bin").agg(F.count("*").alias("_n"))
    by_length = Window.partitionBy("length").orderBy("_bin")
    before = counts.select("length", "_bin", (F.sum("_n").over(by_length) - F.col("_n")).alias("_before"))
    numbered = (binned.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_bin").orderBy("_id")) - 1)
                .join(before, ["length", "_bin"])
                .withColumn("_rank", F.col("_before") + F.col("_at")))
    per_length: dict[int, list] = {}
    for size, *rest in ranges:
        per_length.setdefault(size, []).append(tuple(rest))
    schema = "length bigint, _ranges array<struct<first:bigint,n:bigint,sequence:bigint,offset:bigint,copies:bigint>>"
    table = spark.createDataFrame(list(per_length.items()), schema)
    hit = _last_not_after(F.col("_ranges"), F.col("_rank"))
    inside = F.col("_rank") - F.col("_r.first")
    placed = stage(numbered.join(F.broadcast(table), "length")  # at most one row per length, see the docstring
                   .withColumn("_r", hit)
                   .withColumn("sequence_id", F.col("_r.sequence") + F.floor(inside / F.col("_r.copies")).cast("long"))
                   .withColumn("offset", F.col("_r.offset") + (inside % F.col("_r.copies")) * F.col("length"))
                   .select("_id", "sequence_id", "offset"), "places")
    return pieces.join(small_keys(placed), "_id").select(*[c for c in pieces.columns if c != "_id"], "sequence_id", "offset")


def _last_not_after(ranges: Column, rank: Column) -> Column:
    """The range that holds ``rank``; ranges of a length follow each other without a gap."""
    return F.element_at(F.filter(ranges, lambda r: (r["first"] <= rank) & (rank < r["first"] + r["n"])), 1)
