"""A training-data pipeline: language, lines, near duplicates, contamination, packing.

Each stage takes what the one before it kept. Stages but the last return the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm import decontamination, language_id, line_dedup, ngram_join, packing, queries
from gaugeworks.llm.common import KEY, importable, row_key, stage, table


def reject_clashes(docs: DataFrame) -> None:
    """Helper columns must not hide columns of the documents."""
    clash = {"_k1", "_k2", "_n"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"column names are taken: {sorted(clash)}")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; ``lang`` becomes the predicted language.

    The model is fitted on the labelled documents of the stage's input, held-out ones
    excepted. Texts that are null or without a letter are rejected. Columns named
    ``lang_pred``, ``score`` or ``rejected`` raise an error.
    """
    found = language_id.identify(docs, queries.language_model(docs))
    return found.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document that loses all its lines goes."""
    found = line_dedup.dedup_lines(docs)
    kept = found.where("n_lines = 0 or n_removed < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
                           ).select(docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest id, then row key.

    Documents link from a Jaccard similarity of 0.8 of their five-word shingles on. Documents without words have no group and stay.
    Of rows equal in id and text the first by the other columns stays. Columns named ``_k1``, ``_k2`` or ``_n`` are rejected.
    """
    reject_clashes(docs)
    rows = ngram_join.jaccard_components(docs, width=5, num=4, den=5)
    repeated = rows.where("component is not null").groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    found = rows.distinct()
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", *KEY)).alias("first"))
    gone = (found.join(first, "component").where(F.struct("doc_id", *KEY) != F.col("first"))
            .select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")))
    k1, k2 = row_key("doc_id", "text")
    marked = docs.withColumns({"_k1": k1, "_k2": k2}).join(stage(gone, "near-duplicates"), ["_k1", "_k2"], "left_anti")
    repeated = stage(repeated, "repeated-rows")
    if repeated.isEmpty():
        return marked.select(docs.columns)
    each = Window.partitionBy("_k1", "_k2").orderBy(*[c for c in docs.columns])
    one = marked.join(repeated, ["_k1", "_k2"], "left_semi").withColumn("_n", F.row_number().over(each)).where("_n = 1")
    return marked.join(repeated, ["_k1", "_k2"], "left_anti").select(docs.columns).union(one.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; rows equal in id and text share their fate. Columns named ``_k1``, ``_k2`` or ``_n`` are rejected."""
    reject_clashes(docs)
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    k1, k2 = row_key("doc_id", "text")
    marked = docs.withColumns({"_k1": k1, "_k2": k2}).join(stage(gone, "contaminated"), ["_k1", "_k2"], "left_anti")
    return marked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most one sequence with their ids, sequence and offset."""
    return packing.pack(queries.byte_pieces(docs), queries.SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    (name, importable(fn)) for name, fn in (
        ("language_id", identify_language), ("line_dedup", dedup_lines), ("ngram_join", join_near_duplicates),
        ("decontamination", decontaminate), ("packing", pack))]

ORACLE_SQL = None
"""Language, lines and packing are not expressible in SQL; stages are tested against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
