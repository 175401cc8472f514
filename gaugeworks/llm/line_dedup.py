"""Removal of repeated and nearly repeated lines by an exact set-similarity join.

A line is the set of its five-word shingles (a shorter line: one shingle). Shingles
are ordered by rarity; lines whose prefixes share a shingle, and that pass the length
and positional filters, are compared exactly. Linked lines are one group, of which the
earliest line stays and the later matches go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.plans import evaluated_once
from gaugeworks.llm.common import KEY, finished, row_key, stage
from gaugeworks.llm.links import BROADCAST_KEYS, linked, reachable, small_keys

SHINGLE = 5
NUM, DEN = 4, 5
"""Least Jaccard similarity, as a fraction."""
RARITY_BUCKETS = 1 << 16
_HASH_BITS = 57


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col),
                                                          F.split(text_col, "\n").alias("lines"))
    each = rows.select("doc_id", *KEY, F.posexplode("lines").alias("line_no", "line")).where("trim(line) <> ''")
    return each.withColumn("id", F.xxhash64(F.lit(2), "line"))


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(RARITY_BUCKETS)).cast("int")


def rarity_classes(lines: DataFrame) -> bytes:
    """For each hash bucket the logarithm of how often its words stand in all lines, a byte each.

    Counted where the lines are; the table has a fixed size. A word is never rated rarer
    than it is.
    """
    words = lines.select(F.explode(_words("line")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("c"))
    table = bytearray(RARITY_BUCKETS)
    for row in counts.collect():  # at most RARITY_BUCKETS rows
        table[row["b"]] = row["c"].bit_length()
    return bytes(table)


def _with_tokens(lines: DataFrame, classes: bytes) -> DataFrame:
    """``lines`` with ``tokens`` instead of ``line``: the distinct shingles, rarest first.

    A token has the rarity class of its first word on top and 57 bits of the hash of its
    words below, so the natural order of longs is the order by rarity. Words are hashed
    once per line, not once per shingle. The hash of a shingle is the exclusive or of its
    words' hashes, that of word k shifted by k bits, so that order counts; hashing five
    longs in a lambda takes longer than the three steps to it. Places after the last word
    of a line with fewer than five count as 0.
    """
    table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")  # folded to a literal
    padding = F.array(*[F.lit(0).cast("long")] * (SHINGLE - 1))
    hashed = evaluated_once(lines.withColumn(
        "w", F.concat(F.transform(_words("line"), lambda w: F.xxhash64(w)), padding)).drop("line"))
    number = F.greatest(F.size("w") - 2 * (SHINGLE - 1), F.lit(1))

    def mixed(left: Column, right: Column, bits: int) -> Column:
        return F.zip_with(left, right, lambda x, y: x.bitwiseXOR(F.shiftrightunsigned(y, bits)))

    twos = evaluated_once(hashed.withColumn("two", mixed(F.slice("w", 1, number + 2), F.slice("w", 2, number + 2), 1)))
    fours = mixed(F.slice("two", 1, number), F.slice("two", 3, number), 2)
    fives = mixed(fours, F.slice("w", SHINGLE, number), 4)
    tokens = F.zip_with(fives, F.slice("w", 1, number), lambda x, w: F.shiftleft(F.get(table, _bucket(w)), _HASH_BITS)
                        .bitwiseOR(F.shiftrightunsigned(x, 64 - _HASH_BITS)))
    return twos.withColumn("tokens", F.sort_array(F.array_distinct(tokens))).drop("w", "two")


def _line_sets(ids: DataFrame, lines: DataFrame, classes: bytes) -> DataFrame:
    """``id, tokens`` of the lines asked for, one row per id."""
    return _with_tokens(lines.select("id", "line").join(small_keys(ids), "id").dropDuplicates(["id"]), classes).select("id", "tokens")


def _same_lines(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose shingle sets reach the similarity."""
    left, right = (sets.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(DEN * common >= NUM * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, line_no`` of the lines that a line before them repeats.

    Lines come in the order of document id (null first), then row key, then number.
    Blank lines are not judged. Equal lines are one set of 64-bit identity.
    """
    lines = _lines(docs, id_col, text_col)
    classes = rarity_classes(lines)
    keep = (F.size("tokens") - F.ceil(F.lit(NUM / DEN) * F.size("tokens") - 1e-9) + 1).cast("int")
    rows = stage(_with_tokens(lines, classes).select(
        "doc_id", *KEY, "line_no", "id", F.size("tokens").alias("n"), F.slice("tokens", 1, keep).alias("prefix")), "lines")

    def candidates(pairs: DataFrame) -> DataFrame:
        fits = reachable(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), NUM, DEN)
        return pairs.where(fits).select("a", "b").distinct()

    # One shingle is shared by equal sets only; two such lines differ in blanks at most.
    roots = linked(rows.select("id", "n", "prefix"), candidates, lambda ids: _line_sets(ids, lines, classes),
                   _same_lines, NUM, DEN, "lines")
    grouped = (rows.select("doc_id", *KEY, "line_no", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
               .select("doc_id", *KEY, "line_no", F.coalesce("root", "id").alias("root")))
    place = F.struct("doc_id", *KEY, "line_no")
    first = grouped.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return grouped.join(first, "root").where(place != F.col("first")).select(*KEY, "line_no")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated lines, with ``n_lines`` (not blank) and ``n_removed``.

    The first of linked lines stays, the others are taken out of the text whole; other
    text is untouched. Null and empty texts stay as they are (0 lines). A text may become
    empty. Rows equal in id and text count as one document: they keep and lose the same
    lines. Extra columns pass through; ``n_lines``, ``n_removed`` and names with a leading
    ``_`` are rejected.
    """
    clash = [c for c in docs.columns if c in ("n_lines", "n_removed") or c.startswith("_")]
    if clash:
        raise ValueError(f"column names are taken: {clash}")
    repeated = finished(docs.sparkSession, lambda: repeated_lines(docs, id_col, text_col), "repeated")
    gone = (repeated.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "line_no")
            .groupBy("_k1", "_k2").agg(F.collect_set("line_no").alias("_gone")))
    # The bound counts lines, so that the lists of line numbers are bounded too.
    gone = F.broadcast(gone) if repeated.count() <= BROADCAST_KEYS else gone
    k1, k2 = row_key(id_col, text_col)
    rows = docs.withColumns({"_k1": k1, "_k2": k2}).join(gone, ["_k1", "_k2"], "left")
    rows = evaluated_once(rows.withColumn("_lines", F.split(text_col, "\n")))  # else lambdas split the text anew for each line
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter("_lines", lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    counted = rows.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n_lines)).withColumn(
        "n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    counted = counted.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
    return counted.withColumn(text_col, text).select(*docs.columns, "n_lines", "n_removed")
