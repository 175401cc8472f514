"""Benchmark decontamination by a positional inverted index.

The index stores a posting (term, document, position) for each document word that is
an item word too. For phrases, postings whose neighbours never stand beside them in an
item are left out, since no window can cover them. Windows are looked up by their
rarest term: its postings, shifted by its place in the item, give the candidate
alignments, whose remaining terms are intersected with the lists position by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import KEY, finished, lower_ascii, row_key, stage

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_ROWS = 200_000
"""Most item terms or pairs that are broadcast; beyond, the same join shuffles."""


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast where its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_words(items: DataFrame) -> DataFrame:
    """``class`` (item text as words), ``n``, ``at``, ``term``, ``next``: items with the same words are one class."""
    classes = items.select(words("text").alias("w")).where("size(w) > 0").select(F.xxhash64("w").alias("class"), "w").distinct()
    pairs = F.transform("w", lambda w, i: F.struct(w.alias("term"), F.get("w", i + 1).alias("next")))
    return classes.select("class", F.size("w").alias("n"), F.posexplode(pairs).alias("at", "p")).select(
        "class", "n", "at", "p.term", "p.next")


def build_index(docs: DataFrame, terms: DataFrame, neighbours: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings ``k1, k2, doc_id, term, pos``, sorted by term inside each segment (file).

    ``terms`` (``term``, and ``next`` for ``neighbours``) says what is stored. With
    ``neighbours`` a word is stored where it and the word on one of its sides stand so in
    some item, or where it is an item by itself (``next`` null for every item's last
    word keeps these). Each document adds one row with a null term and its number of
    words as position, so that documents without postings are in the index too.
    """
    w = words(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), w.alias("w"))
    if not neighbours:
        known = small_side(terms.select("term").distinct().withColumn("hit", F.lit(True)))
        each = rows.select("doc_id", *KEY, F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "term"))
        found = each.join(known, "term", "left").where("term is null or hit").drop("hit")
    else:
        pair = F.arrays_zip(F.concat("w", F.array(F.lit(None).cast("string"))).alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))
        each = rows.select("doc_id", *KEY, F.posexplode(pair).alias("pos", "p")).select("doc_id", *KEY, "pos", "p.a", "p.b")
        known = small_side(terms.where("next is not null").select(F.col("term").alias("a"), F.col("next").alias("b"))
                           .distinct().withColumn("hit", F.lit(True)))
        # A pair keeps both its words; duplicates of a position fall away when the lists are merged.
        single = small_side(terms.where("n = 1").select(F.col("term").alias("a")).distinct().withColumn("alone", F.lit(True)))
        kept = each.join(known, ["a", "b"], "left").join(single, "a", "left").where("a is null or hit or alone")
        both = F.when(F.col("hit"), F.array(F.struct(F.col("pos"), F.col("a").alias("term")),
                                            F.struct((F.col("pos") + 1).alias("pos"), F.col("b").alias("term")))
                      ).otherwise(F.array(F.struct(F.col("pos"), F.col("a").alias("term"))))
        found = kept.select("doc_id", *KEY, F.explode(both).alias("x")).select("doc_id", *KEY, "x.term", "x.pos")
    return stage(found.select(*KEY, "doc_id", "term", F.col("pos").cast("int").alias("pos")).sortWithinPartitions("term"), "postings")


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``k1, k2, class, shift, at``: item words inside an occurrence of one of the item's windows.

    ``shift + at`` is the word's position in the document.
    """
    lengths = index.where("term is not null").groupBy("term").agg(F.count("*").alias("length"))
    listed = stage(items.join(lengths, "term", "left").fillna(0, ["length"]), "lists")
    span = F.least("n", F.lit(window))
    last = F.col("n") - span
    per_window = listed.select("class", "n", "at", "term", "length", F.explode(
        F.sequence(F.greatest(F.col("at") - span + 1, F.lit(0)), F.least(F.col("at"), last))).alias("start"))
    rarest = Window.partitionBy("class", "start").orderBy("length", "at")
    anchors = (per_window.withColumn("r", F.row_number().over(rarest)).where("r = 1 and length > 0")
               .select("class", "at", "term").distinct())
    shifted = (index.select(*KEY, "term", "pos").join(small_side(anchors), "term")
               .select(*KEY, "class", (F.col("pos") - F.col("at")).alias("shift")).distinct())
    wanted = (shifted.join(listed.select("class", "n", "at", "term"), "class")
              .select(*KEY, "class", "n", "shift", "at", "term", (F.col("shift") + F.col("at")).alias("pos")))
    found = wanted.join(index.select(*KEY, "term", "pos").distinct(), [*KEY, "term", "pos"], "left_semi")
    one = ["k1", "k2", "class", "shift"]
    runs = found.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*one).orderBy("at")))
    sized = runs.withColumn("size", F.count("*").over(Window.partitionBy(*one, "run")))
    return sized.where(F.col("size") >= F.least("n", F.lit(window))).select(*one, "at")


def proximity_hits(index: DataFrame, groups: DataFrame, slop: int) -> DataFrame:
    """``k1, k2, group, pos``: places of a group's rarest term with all its other terms within ``slop`` words.

    ``groups`` holds ``group`` and ``term``; terms may come in any order. The index must
    have been built without ``neighbours``. Lists are joined by blocks of ``slop`` words.
    """
    lengths = index.where("term is not null").groupBy("term").agg(F.count("*").alias("length"))
    listed = groups.select("group", "term").distinct().join(lengths, "term", "left").fillna(0, ["length"])
    rank = Window.partitionBy("group").orderBy("length", "term")
    listed = listed.withColumn("r", F.row_number().over(rank)).withColumn("size", F.count("*").over(Window.partitionBy("group")))
    block = F.floor(F.col("pos") / F.lit(slop + 1))
    postings = index.where("term is not null").select(*KEY, "term", "pos").distinct()
    first = (postings.join(listed.where("r = 1").select("group", "term", "size"), "term")
             .select(*KEY, "group", "size", F.col("pos").alias("first"), F.explode(F.array(block - 1, block, block + 1)).alias("block")))
    others = postings.join(listed.where("r > 1").select("group", "term"), "term").select(*KEY, "group", "term", "pos", block.alias("block"))
    near = (first.join(others, [*KEY, "group", "block"]).where(F.abs(F.col("pos") - F.col("first")) <= slop)
            .groupBy(*KEY, "group", "size", "first").agg(F.count_distinct("term").alias("found")).where("found = size - 1"))
    alone = first.where("size = 1").select(*KEY, "group", "first").distinct()
    return near.select(*KEY, "group", "first").union(alone).withColumnRenamed("first", "pos")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5,
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per document: ``k1, k2, doc_id, n_words, n_hit, items`` (ids as sorted strings) and ``contaminated``.

    A window is ``window`` words in a row of an item (all of a shorter one); every
    document word inside an occurrence of one is hit; a document with a hit in at least
    ``percent`` of a hundred of its words is contaminated. Null or empty texts have no
    words and are clean; items without words match nothing; a null item id is not
    listed. Rows equal in id and text give equal results, each its own row. Other
    columns are ignored; empty tables give empty or clean results.
    """
    return finished(docs.sparkSession, lambda: _contamination(docs, items, window, percent, id_col, text_col, item_id), "contamination")


def _contamination(docs: DataFrame, items: DataFrame, window: int, percent: int, id_col: str, text_col: str, item_id: str) -> DataFrame:
    terms = stage(item_words(items), "items")
    index = build_index(docs, terms, True, id_col, text_col)
    hits = stage(phrase_hits(index, terms, window), "hits")
    n_hit = (hits.select(*KEY, (F.col("shift") + F.col("at")).alias("pos")).distinct()
             .groupBy(*KEY).agg(F.count("*").alias("n_hit")))
    names = items.select(words("text").alias("w"), F.col(item_id).cast("string").alias("item")).where("size(w) > 0").select(
        F.xxhash64("w").alias("class"), "item")
    listed = (hits.select(*KEY, "class").distinct().join(names, "class")
              .groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items")))
    of_docs = index.where("term is null").select(*KEY, "doc_id", F.col("pos").cast("long").alias("n_words"))
    joined = of_docs.join(n_hit, KEY, "left").join(listed, KEY, "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return joined.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
