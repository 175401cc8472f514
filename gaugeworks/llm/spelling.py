"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

One edit leaves one half of a word as it is. Words are therefore listed by their first
half and, read backwards, by their last; lists are sorted, and each word is compared
with the words after it. Rows of the banded edit matrix are kept for as many code points
as neighbouring words share, and where a shared beginning is more than one edit away, all
words that begin so are passed over.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import finished, stage

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
RATIO = 10
"""How often the more frequent spelling must occur for one occurrence of the other."""
LONGEST_LIST = 2_000
"""Words of a list; longer ones are listed anew by a half of what may differ."""
HELD_WORDS = 200_000
"""Words that a task counts before it passes them on."""
FAR = 2
_END = "\U0010FFFF"


def word_counts(docs: DataFrame, damaged: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters, A-Z in lower case, of at least 7 code points and 2 occurrences.

    With ``damaged``, a run whose crc32 (with its document's id) is divisible by it loses one code
    point everywhere in that document. A null id is empty text there; null texts have no words.
    Tasks add up before they pass on; a word that fills a third of all texts is a row per task.
    """
    long_run = re.compile(RUN[:-1] + "{%d,}" % LEAST_LENGTH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                found = Counter(long_run.findall(text.encode().lower().decode()))  # bytes: A-Z only
                if damaged is None:
                    total.update(found)
                    continue
                begin = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % damaged == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < LEAST_LENGTH:
                            continue
                    total[word] += n
                if len(total) > HELD_WORDS:
                    yield passed_on()
        yield passed_on()

    counted = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_in_list(words: list[str], length: int) -> Iterator[tuple[int, int]]:
    """Places of the pairs one edit apart in a sorted list, the shorter word having ``length`` code points.

    The list holds distinct words of ``length`` and one more.
    """
    shared = [0] * len(words)  # code points shared with the word before
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        n = min(len(a), len(b))
        shared[i] = next((k for k in range(n) if a[k] != b[k]), n)
    for q, query in enumerate(words):
        size, padded = len(query), query + "\0\0"
        # Row k: least edits from the first k code points of a word to the first k - 1, k and k + 1 of the query.
        rows, i = [(FAR, 0, 1)], q + 1
        while i < len(words):
            word = words[i]
            if i > q + 1:  # a range that was passed over shares all rows it had, so this holds after it too
                del rows[shared[i] + 1:]
            for k in range(len(rows), len(word) + 1):
                before, same, after = rows[-1]
                c = word[k - 1]
                left = min(before + (c != padded[k - 2]), same + 1)
                mid = min(same + (c != padded[k - 1]), after + 1, left + 1)
                right = min(after + (c != padded[k]), mid + 1)
                rows.append((left, mid, right))
                if left >= FAR and mid >= FAR and right >= FAR:
                    i = bisect_left(words, word[:k] + _END, i)
                    break
            else:
                if rows[-1][1 + size - len(word)] == 1 and min(size, len(word)) == length:
                    yield q, i
                i += 1


def _halves(lists: DataFrame) -> DataFrame:
    """Lists cut in two kinds: words that also share the first, and words that also share the last half of what may differ.

    A list is ``length`` (of its shorter words), ``back`` (words read backwards), and how many
    code points its words share at their beginning and end (``low``, ``high``).
    """
    half = F.floor((F.col("length") - F.col("low") - F.col("high")) / 2)
    first = F.struct((F.col("low") + half).cast("int").alias("low"), F.col("high"))
    last = F.struct(F.col("low"), (F.col("high") + half).cast("int").alias("high"))
    return lists.withColumn("cut", F.explode(F.array(first, last))).select("word", "n", "length", "back", "cut.low", "cut.high")


def _keyed(lists: DataFrame) -> DataFrame:
    key = F.concat_ws("\0", "length", F.col("back").cast("int"), "low", "high", F.substr("word", F.lit(1), F.col("low")),
                      F.when(F.col("high") > 0, F.substr("word", F.char_length("word") - F.col("high") + 1, F.col("high"))).otherwise(""))
    return lists.withColumn("key", key)


def _scan(lists: DataFrame) -> DataFrame:
    """Pairs of each list, in both directions; lists arrive one after the other, sorted."""
    schema = "word string, n bigint, near string, near_n bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, length, back, out = None, [], [], 0, False, []

        def close() -> None:
            if len(words) > 1:
                for i, j in near_in_list(words, length):
                    a, b = (words[i][::-1], words[j][::-1]) if back else (words[i], words[j])
                    out.append((a, counts[i], b, counts[j]))
                    out.append((b, counts[j], a, counts[i]))

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))],
                                               ["word", "n", "near", "near_n"])
            out.clear()
            return batch

        for batch in batches:
            for k, word, n, size, backwards in zip(*[batch.column(c).to_pylist() for c in ("key", "word", "n", "length", "back")]):
                if k != key:
                    close()
                    key, words, counts, length, back = k, [], [], size, backwards
                words.append(word)
                counts.append(n)
            if out:
                yield rows()
        close()
        if out:
            yield rows()

    return (lists.select("key", "word", "n", "length", "back").repartition("key").sortWithinPartitions("key", "word")
            .mapInArrow(scan, schema))


def near_words(counts: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """``word, n, near, near_n`` for every pair of distinct words one inserted, deleted or replaced code point apart.

    ``counts`` has each word of at least two code points once. Lists with more than ``longest`` words are cut by half of what
    may still differ until they are shorter or nothing is left to cut.
    """
    size = F.char_length("word")
    words = counts.select("word", "n")
    lengths = words.withColumn("length", F.explode(F.array(size - 1, size))).where("length >= 2")
    both = lengths.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    half = F.floor(F.col("length") / 2).cast("int")
    lists = both.select(F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n", "length", "back",
                        half.alias("low"), F.lit(0).alias("high"))
    found, pairs = stage(_keyed(lists), "lists"), None
    while True:
        sizes = found.groupBy("key", "length", "low", "high").agg(F.count("*").alias("words"))
        long_lists = stage(sizes.where((F.col("words") > longest) & (F.col("length") - F.col("low") - F.col("high") > 1)).select("key"), "long-lists")
        none = long_lists.isEmpty()
        part = _scan(found if none else found.join(long_lists, "key", "left_anti"))
        pairs = part if pairs is None else pairs.union(part)
        if none:
            return pairs.distinct()
        found = stage(_keyed(_halves(found.join(long_lists, "key", "left_semi").drop("key"))), "lists")


def spelling_variants(counts: DataFrame, ratio: int = RATIO, longest: int = LONGEST_LIST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``counts`` (``word, n``).

    ``form`` is the near word that occurs most (ties: smallest in code-point order) if it occurs
    at least ``ratio`` times as often as the word, else null; ``root`` is where forms lead in the
    end, the word itself if nowhere. Other columns are left out; null words are no words,
    and rows of one word are added up.
    """
    return finished(counts.sparkSession, lambda: _variants(counts, ratio, longest), "variants")


def _variants(counts: DataFrame, ratio: int, longest: int) -> DataFrame:
    counts = stage(counts.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    best = near_words(counts, longest).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    zero, often = F.lit(0).cast("long"), -F.col("best.less") >= ratio * F.col("n")
    rows = stage(counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", zero).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "forms")
    # Each step follows twice as many forms; a form occurs ratio times as often, so there are few.
    ways = stage(rows.where("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = stage(ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ways")
        ways = farther.select("word", "root")
        if farther.where("moved").isEmpty():
            break
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
