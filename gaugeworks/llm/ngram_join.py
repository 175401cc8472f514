"""Jaccard join of documents over word n-grams by T-occurrence search.

A document that shares at least T shingles with a query stands in at least T of the
query's inverted lists. Lists are divided: of the short ones (the rarest shingles) a
candidate must stand in a known number, found by merging them with a heap; the long
ones are only probed, by binary search, until T is reached or out of reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import KEY, finished, row_key, stage
from gaugeworks.llm.links import linked, reachable, small_keys
from gaugeworks.llm.shingles import SPACES, mixed, shingle_set, shingles, text_words
from gaugeworks.llm.tokens import give_back

WIDTH = 3
NUM, DEN = 9, 10
SHORT = 2
"""How many of the short lists a candidate must stand in (fewer where a set has no more)."""
RARITY_BITS, WORD_BITS = 18, 16


def least_overlap(n: int, m: int, num: int = NUM, den: int = DEN) -> int:
    """Least intersection of sets of ``n`` and ``m`` that reaches the similarity."""
    return -(-num * (n + m) // (num + den))


def _prefix_size(n: int, num: int, den: int) -> int:
    """Short lists of a set: all but the ones it may miss, and the occurrences asked for."""
    least = -(-num * n // den)
    return n - least + min(SHORT, least)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Rarity:
    """How long the list of a shingle may be, from counts over all documents in tables of fixed size.

    Two signs are combined: how often a shingle is expected from the frequencies of its
    words, and how many documents have a shingle of its hash bucket. The first tells
    everyday phrases, the second passages that many documents share.
    """

    def __init__(self, documents: np.ndarray, words: np.ndarray):
        self.documents = np.floor(8 * np.log2(documents + 1.0)).astype(np.int64)
        self.total = max(int(words.sum()), 1)
        self.words = np.log2(np.maximum(words, 1) / self.total)

    def order(self, text: str, width: int) -> np.ndarray:
        """The distinct shingles of a text, rarest first; ties by hash, so the order is one for all texts."""
        words = text_words(text)
        found, first = np.unique(shingles(words, width), return_index=True)
        each, take = self.words[_bucket(words, WORD_BITS)], min(width, len(words))
        expected = sum(each[i:len(words) - take + 1 + i] for i in range(take)) + np.log2(self.total)
        expected = np.maximum(np.round(expected[first], 3), 0).astype(np.int64)
        return found[np.lexsort((found, self.documents[_bucket(found, RARITY_BITS)], expected))]


def count_rarity(docs: DataFrame, width: int, text_col: str = "text") -> Rarity:
    """Tasks add up what they read; the tables that reach the driver have a fixed number of buckets."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, words = np.zeros(1 << RARITY_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                hashes = text_words(text.as_py() or "")
                if len(hashes):
                    words += np.bincount(_bucket(hashes, WORD_BITS), minlength=len(words))
                    np.add.at(documents, _bucket(np.unique(shingles(hashes, width)), RARITY_BITS), 1)
        give_back()
        for table, total in ((0, documents), (1, words)):
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([table] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(total[at])],
                                             ["table", "bucket", "n"])

    tables = np.zeros(1 << RARITY_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
    counted = docs.select(text_col).mapInArrow(count, "table bigint, bucket bigint, n bigint")
    for row in counted.groupBy("table", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        tables[row["table"]][row["bucket"]] = row["n"]
    return Rarity(*tables)


def document_sets(docs: DataFrame, rarity: Rarity, width: int, num: int, den: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, k1, k2, id`` (hash of the set, null if empty), ``n``, ``prefix`` (rarest shingles)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("k1", T.LongType()),
                           T.StructField("k2", T.LongType()), T.StructField("id", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prefixes = [], [], []
            for text in batch.column(3):
                words = text.as_py() or ""
                ordered = rarity.order(words, width) if words.strip(SPACES) else np.zeros(0, np.uint64)
                found, n = np.sort(ordered), len(ordered)
                ids.append(int(set_id(found)) if n else None)
                sizes.append(n)
                prefixes.append(ordered[:_prefix_size(n, num, den)].view(np.int64) if n else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(prefixes, pa.list_(pa.int64()))], schema.fieldNames())
        give_back()

    return docs.select(id_col, *row_key(id_col, text_col), text_col).mapInArrow(build, schema)


def set_id(found: np.ndarray) -> np.int64:
    """64 bits that stand for a set, from its ascending shingles."""
    place = mixed(np.arange(1, len(found) + 1, dtype=np.uint64))
    return np.bitwise_xor.reduce(mixed(found * (place | np.uint64(1)) + place)).view(np.int64)


def merge_short_lists(lists: list[list[tuple[int, int]]], n: int, num: int, den: int) -> list[int]:
    """Heap merge of sorted (id, size) lists: ids that stand in as many as the sizes ask for."""
    found, last, times, size = [], None, 0, 0

    def close():
        least = least_overlap(n, size, num, den)
        if last is not None and times >= min(SHORT, -(-num * n // den), -(-num * size // den), least):
            found.append(last)

    for i, m in heapq.merge(*lists):
        if i != last:
            close()
            last, times, size = i, 0, m
        times += 1
    close()
    return found


def reaches(query: np.ndarray, other: np.ndarray, num: int = NUM, den: int = DEN, block: int = 256) -> bool:
    """Whether two ascending sets reach the similarity: probes block by block until T is met or out of reach."""
    need, have = least_overlap(len(query), len(other), num, den), 0
    for at in range(0, len(query), block):
        part = query[at:at + block]
        place = np.searchsorted(other, part)
        have += int((other[np.minimum(place, len(other) - 1)] == part).sum())
        if have >= need:
            return True
        if have + len(query) - at - len(part) < need:
            return False
    return False


def search_hubs(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct candidates per query by merging its short lists; a query's lists are bounded by its own size."""
    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        lists: dict[int, list[tuple[int, int]]] = {}
        for token, a, na in zip(rows["token"], rows["a"], rows["na"]):
            lists.setdefault(token, []).append((a, na))
        found = merge_short_lists([sorted(x) for x in lists.values()], rows["nb"][0], num, den)
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([rows["b"][0]] * len(found), pa.int64())})

    return pairs.select("b", "nb", "token", "a", "na").groupBy("b").applyInArrow(merge, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, k1, k2, n_shingles`` and ``component`` (set id of the component, null for empty sets).

    Documents link when ``den * |intersection| >= num * |union|``. Equal sets are one
    node, so exact copies are never paired. A null or empty text, or one without words,
    has an empty set and links with nothing. Repeated rows give repeated results; null
    ids are rows like any other. Shingles and sets are told apart by 64-bit hashes.
    """
    return finished(docs.sparkSession, lambda: _components(docs, width, num, den, id_col, text_col), "components")


def _components(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    sets = stage(document_sets(docs, count_rarity(docs, width, text_col), width, num, den, id_col, text_col), "sets")
    full = sets.where("id is not null")
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))

    def candidates(pairs: DataFrame) -> DataFrame:
        least = lambda n: F.ceil(F.col(n) * num / den - 1e-9)
        if "ra" not in pairs.columns:
            return search_hubs(pairs, num, den)
        counted = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("times"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
        return counted.where((F.col("times") >= F.least(F.lit(SHORT), least("na"), least("nb")))
                             & reachable(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), num, den))

    def tokens(ids: DataFrame) -> DataFrame:
        """``id, tokens``: the ascending shingles of the sets asked for, from one text of each."""
        each = full.join(small_keys(ids), "id").groupBy("id", *KEY).agg(F.count("*").alias("rows"))
        one = stage(each.groupBy("id").agg(F.min(F.struct(*KEY, "rows")).alias("key")).select("id", "key.*"), "wanted-rows")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shingle_set(text.as_py(), width).view(np.int64) for text in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "tokens"])
            give_back()

        held = texts.join(small_keys(one), KEY).select("id", "rows", "text")
        # Only rows that come twice give a set twice; the others need no exchange of their texts or tokens.
        if not one.where("rows > 1").isEmpty():
            held = held.where("rows = 1").union(held.where("rows > 1").dropDuplicates(["id"]))
        return held.select("id", "text").mapInArrow(build, "id bigint, tokens array<bigint>")

    def verify(pairs: DataFrame, held: DataFrame) -> DataFrame:
        left, right = (held.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [reaches(tb.values.to_numpy().view(np.uint64), ta.values.to_numpy().view(np.uint64), num, den)
                        for ta, tb in zip(batch.column("ta"), batch.column("tb"))]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

        return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(probe, "a bigint, b bigint")

    roots = linked(full.select("id", "n", "prefix"), candidates, tokens, verify, num, den, "documents")
    return (sets.select("doc_id", *KEY, "id", F.col("n").alias("n_shingles"))
            .join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
            .select("doc_id", *KEY, "n_shingles", F.coalesce("root", "id").alias("component")))


def smallest_of_component(found: DataFrame) -> DataFrame:
    """``found`` with ``component_id``: the smallest doc_id of the component; a row without one has its own id."""
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component", "left").withColumn("component_id", F.coalesce("least", "doc_id")).drop("least")
