"""Removal of long word sequences that an earlier document has, by FM-indexes of shards.

Texts are cut where the anchor of their windows changes: the smallest hash among the
short sequences inside a window. Equal windows have equal anchors, so a shard that gets
all cuts of its anchors sees every pair of equal windows, and no text is held against
all others. A shard indexes its distinct cuts and streams them backwards through the
index; windows that a smaller document has are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import KEY, finished, row_key, stage
from gaugeworks.llm.fm_index import FmIndex
from gaugeworks.llm.links import BROADCAST_KEYS, small_keys
from gaugeworks.llm.shingles import M1, mixed, text_words

WINDOW = 50
GRAM = 16
"""Words of an anchor, a power of two."""
LONGEST = 512
"""Windows of a cut; longer runs of one anchor are cut again."""
SHARD_WORDS = 400_000
"""Words that one index is planned for."""
LEVELS = 6
"""How often cuts whose anchor has more words than a shard are cut anew, by another order of anchors."""


def anchors(words: np.ndarray, window: int, salt: int) -> np.ndarray:
    """For each window the smallest hash of ``GRAM`` words in it (fewer where a window has no more)."""
    gram, found = words ^ mixed(np.array([salt + 1], np.uint64) * M1), 1
    while 2 * found <= min(GRAM, window):
        gram = mixed(gram[:-found] * M1 + gram[found:])
        found *= 2
    wanted, wide = window - found + 1, 1
    least = mixed(gram)
    while 2 * wide <= wanted:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    return np.minimum(least[:len(least) - (wanted - wide)], least[wanted - wide:])


def cuts(words: np.ndarray, window: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run of windows with one anchor."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = anchors(words, window, salt).view(np.int64)
    starts = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
    sizes = np.diff(np.concatenate([starts, [len(least)]]))
    if sizes.max() > LONGEST:
        parts = -(-sizes // LONGEST)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + within * LONGEST
        sizes = np.minimum(np.repeat(sizes, parts) - within * LONGEST, LONGEST)
    return least[starts], starts, sizes


def _anchor_extent(cut: DataFrame) -> DataFrame:
    """Anchors that at least two different documents have."""
    return cut.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")


def _shared_anchors(texts: DataFrame, window: int, salt: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(cuts(text_words(t.as_py() or b"", False), window, salt)[0]) for t in batch.column("text")]
            docs = np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(docs.astype(np.int64))], ["anchor", "doc"])

    return stage(_anchor_extent(texts.select("doc", "text").mapInArrow(find, "anchor bigint, doc bigint")), "anchors")


def _cut(texts: DataFrame, window: int, salt: int) -> DataFrame:
    """``k1, k2, doc, anchor, start, n, s1, s2, words`` of every cut with a shared anchor.

    ``s1, s2`` stand for the words; a task gives the words themselves once. Anchors are
    looked up in the task where counting has shown that they are few, otherwise joined.
    """
    shared = _shared_anchors(texts, window, salt)
    few = shared.count() <= BROADCAST_KEYS
    known = None
    if few:
        values = np.sort(np.array([x for column in shared.toArrow().column(0).chunks for x in column.to_numpy()], np.int64))
        known = texts.sparkSession.sparkContext.broadcast(values)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for k1, k2, doc, text in zip(*[batch.column(c).to_pylist() for c in (*KEY, "doc", "text")]):
                anchor, starts, sizes = cuts(text_words(text or b"", False), window, salt)
                if known is not None and len(anchor):
                    keep = known.value[np.minimum(np.searchsorted(known.value, anchor), len(known.value) - 1)] == anchor if len(known.value) else np.zeros(len(anchor), bool)
                    anchor, starts, sizes = anchor[keep], starts[keep], sizes[keep]
                if not len(anchor):
                    continue
                words = (text if isinstance(text, bytes) else text.encode()).split()
                for a, start, n in zip(anchor.tolist(), starts.tolist(), sizes.tolist()):
                    content = b" ".join(words[start:start + n + window - 1])
                    mark = hashlib.blake2b(content, digest_size=16).digest()
                    new = mark not in given
                    if new:
                        given.add(mark)
                    s1, s2 = np.frombuffer(mark, np.int64)
                    for out, value in zip(rows, (k1, k2, doc, a, start, n, int(s1), int(s2), content if new else None)):
                        out.append(value)
                if len(given) > 200_000:  # only saves copies, so it may forget
                    given.clear()
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in rows[:8]], pa.array(rows[8], pa.binary())],
                                             ["k1", "k2", "doc", "anchor", "start", "n", "s1", "s2", "words"])

    found = texts.select(*KEY, "doc", "text").mapInArrow(
        find, "k1 bigint, k2 bigint, doc bigint, anchor bigint, start bigint, n bigint, s1 bigint, s2 bigint, words binary")
    return stage(found if few else found.join(shared, "anchor", "left_semi"), "cuts")


def _search_shard(window: int):
    def search(group: pa.Table) -> pa.Table:
        """Runs of windows of each cut that a cut of a smaller document has too."""
        docs = group.column("doc").to_numpy()
        index = FmIndex([x.as_py().split() for x in group.column("words")], window)
        least = np.minimum.reduceat(docs[index.owner[index.order]], index.class_starts[:-1])
        hits, places = [], []
        for cut, start, classes in index.windows(window):
            hit = least[classes] < docs[cut]
            hits.append(cut[hit])
            places.append(start[hit])
        cut, start = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (hits, places))
        order = np.lexsort((start, cut))
        cut, start = cut[order], start[order]
        new = np.nonzero(np.concatenate([[True], (cut[1:] != cut[:-1]) | (start[1:] != start[:-1] + 1)]))[0] if len(cut) else np.zeros(0, np.int64)
        ends = start[np.concatenate([new[1:] - 1, [len(cut) - 1]])] + 1 if len(cut) else start
        return pa.table({"s1": group.column("s1").combine_chunks().take(pa.array(cut[new])), "s2": group.column("s2").combine_chunks().take(pa.array(cut[new])),
                         "low": pa.array(start[new]), "high": pa.array(ends)})
    return search


def repeated_windows(texts: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, level: int = 0) -> DataFrame:
    """``k1, k2, low, high``: windows from ``low`` to before ``high`` that a smaller ``doc`` has too.

    ``texts`` has ``k1, k2, doc, text`` (text or bytes). Cuts of equal words are one cut of
    their smallest document, so what a third of all documents share is indexed once. An
    anchor with more words than a shard has its cuts cut anew, in the order of other hashes.
    """
    cut = _cut(texts, window, level)
    narrow = cut.select(*KEY, "doc", "start", "n", "s1", "s2")
    anchor = _anchor_extent(cut.select("anchor", "doc"))
    distinct = stage(cut.groupBy("s1", "s2").agg(F.min("doc").alias("doc"), F.first("anchor").alias("anchor"), F.max("n").alias("n"))
                     .join(small_keys(stage(anchor, "shared")), "anchor"), "distinct-cuts")
    sizes = distinct.groupBy("anchor").agg(F.sum(F.col("n") + window - 1).alias("size"))
    large = stage(sizes.where(F.col("size") > shard_words).select("anchor"), "large-anchors")
    total = sizes.agg(F.sum("size")).head()[0] or 0
    contents = cut.where("words is not null").select("s1", "s2", "words").dropDuplicates(["s1", "s2"])
    held = stage(distinct.select("s1", "s2", "doc", "anchor").join(contents, ["s1", "s2"]), "cut-words")
    again = level + 1 < LEVELS and not large.isEmpty()
    small = held.join(small_keys(large), "anchor", "left_anti") if again else held
    shards = int(total // shard_words) + 1
    found = (small.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select("shard", "s1", "s2", "doc", "words")
             .groupBy("shard").applyInArrow(_search_shard(window), "s1 bigint, s2 bigint, low bigint, high bigint"))
    if again:
        deeper = held.join(small_keys(large), "anchor", "left_semi").select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "doc", F.col("words").alias("text"))
        found = found.union(repeated_windows(deeper, window, shard_words, level + 1).select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "low", "high"))
    parts = stage(found, "found")
    owners = small_keys(distinct.select("s1", "s2", F.col("doc").alias("first")))
    placed = narrow.join(owners, ["s1", "s2"])
    later = placed.where("doc > first").select(*KEY, F.col("start").alias("low"), (F.col("start") + F.col("n")).alias("high"))
    first = (placed.where("doc = first").join(small_keys(parts), ["s1", "s2"])
             .select(*KEY, (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")))
    return stage(later.union(first), "windows")


def _spans(docs: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> DataFrame:
    """``k1, k2, spans`` of the rows that lose words; no spans: all windows."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        *row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.lit(3), text_col).alias("t1"), F.xxhash64(F.lit(4), text_col).alias("t2"),
        F.col(text_col).alias("text"))
    first = rows.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    # Texts that an earlier document has as a whole need no index.
    copies = stage(rows.select(*KEY, "doc", "t1", "t2").join(small_keys(stage(first, "copied")), ["t1", "t2"]).where("doc > first").select(*KEY).distinct(), "copies")
    found = repeated_windows(rows.join(small_keys(copies), KEY, "left_anti"), window, shard_words)
    lists = found.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return lists.union(copies.select(*KEY, F.lit(None).cast(lists.schema["spans"].dataType).alias("spans")))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the words that lie in a window (``window`` words in a row) that also starts in a document with a smaller id.

    Words are split at ASCII white space and unchanged; a text becomes its kept words with one
    blank between. Added: ``n_words``, ``n_removed`` and ``removed`` (word spans: first, and the one after the
    last). Windows are judged on the input. Null texts stay null and have no words; rows
    without an id lose nothing and take nothing from others; ids that are equal are not
    smaller, so equal rows keep and lose the same. Other columns pass through; the three
    added names and ``_spans``, ``_gone`` and ``_k1``, ``_k2`` are rejected.
    """
    clash = {"n_words", "n_removed", "removed", "_spans", "_gone", "_k1", "_k2"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"column names are taken: {sorted(clash)}")
    spans = finished(docs.sparkSession, lambda: _spans(docs, id_col, text_col, window, shard_words), "spans")
    gone = spans.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.lit(True).alias("_gone"), F.col("spans").alias("_spans"))
    n_spans = spans.select(F.sum(F.coalesce(F.size("spans"), F.lit(1)))).head()[0] or 0
    gone = F.broadcast(gone) if n_spans <= BROADCAST_KEYS else gone
    k1, k2 = row_key(id_col, text_col)
    rows = docs.withColumns({"_k1": k1, "_k2": k2}).join(gone, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    span = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span)])
    width, place = len(docs.columns), docs.columns.index(text_col)

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, lost, where = [], [], [], []
            for text, hit, found in zip(*[batch.column(c).to_pylist() for c in (text_col, "_gone", "_spans")]):
                words = (text or "").encode().split()
                out: list[tuple[int, int]] = []
                if hit:
                    found = [(0, len(words) - window + 1)] if found is None else [(x["low"], x["high"]) for x in found]
                    for low, high in sorted((a, b + window - 1) for a, b in found if a < b):
                        if out and low <= out[-1][1]:
                            out[-1] = (out[-1][0], max(high, out[-1][1]))
                        else:
                            out.append((low, high))
                kept, at = [], 0
                for low, high in out:
                    kept += words[at:low]
                    at = high
                kept += words[at:]
                texts.append(None if text is None else b" ".join(kept).decode())
                counts.append(len(words))
                lost.append(len(words) - len(kept))
                where.append([{"low": a, "high": b} for a, b in out])
            columns = batch.columns[:width]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(lost, pa.int64()),
                                              pa.array(where, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], schema.fieldNames())

    return rows.select(*docs.columns, "_gone", "_spans").mapInArrow(take_out, schema)
