"""Registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontamination, importance, language_id, line_dedup, neighbours, ngram_join, packing, prefix_trie, sharding, spelling, substring_dedup, token_counts, warc
from gaugeworks.llm import oracles as O
from gaugeworks.llm.common import importable, stage, table

SEQUENCE, END_ID = 2048, 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = importable(fn)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from learning: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@query()
def op1_shard_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.shard(table(spark, sf_dir, "documents"), 8, seed=20240501).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def byte_pieces(docs: DataFrame) -> DataFrame:
    return packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SEQUENCE, END_ID)


@query()
def op2_pack_shortest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(byte_pieces(table(spark, sf_dir, "documents")), SEQUENCE)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(O.CONTAMINATION)
def op3_decontaminate_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query()
def op4_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"),
                        F.crc32(text).alias("kept_crc32"))


@query(O.COMPONENTS)
def op5_join_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return ngram_join.smallest_of_component(found).select("doc_id", "n_shingles", "component_id")


@query(O.NEAREST)
def op6_nearest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.where(~held_out()))


@query()
def op7_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query(O.ARCHIVE)
def op8_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_bundles(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_count_resynchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query()
def op10_resample_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, drawn towards those labelled good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return importance.resample(table(spark, sf_dir, "documents"), good, 0.5, seed=20240501)


@query(O.SPELLING)
def op11_group_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), damaged=31))


@query(O.SUBSTRINGS)
def op12_dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query(O.PREFIX_TRIE)
def op13_collapse_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    marks = stage(prefix_trie.turn_marks(prefix_trie.numbered(conversations)), "turn-marks")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    turns = prefix_trie.rebuilt(marks, head, F.col("conv_id") - F.col("conv_id") % 20)
    return prefix_trie.prefix_trie(turns, conversations.select("conv_id")).nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
