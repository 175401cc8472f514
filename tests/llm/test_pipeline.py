"""The pipeline stage by stage on a small table, each against a plain computation on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import decontamination, line_dedup, ngram_join, packing, tokens
from gaugeworks.llm.common import importable, stage, table
from llm_data import DOCS, documents

SF = "/root/testdata/sf0.001"
COLUMNS = [x.split()[0] for x in DOCS.split(", ")]


@pytest.fixture(scope="module")
def results(spark):
    """Input and output of every stage: the given documents with the awkward rows of the tests."""
    extra = [(None if i is None else 10_000 + i, *rest) for i, *rest in documents()]
    docs = stage(table(spark, SF, "documents").unionByName(spark.createDataFrame(extra, DOCS)), "documents")
    out = {}
    for name, fn in corpus_pipeline.STAGES:
        done = stage(fn(spark, docs, SF), name)
        out[name] = (docs, done)
        docs = done
    return out


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]
    for name, (_, done) in results.items():
        if name != "packing":
            assert done.columns == COLUMNS


def test_language_drops_texts_without_letters_only_where_clean(results):
    before, after = map(texts, results["language_id"])
    assert not after - before
    gone = before - after
    assert {(10_100, None), (10_101, ""), (10_108, "123 456 %%%")} <= set(gone)
    given = {k: v for k, v in gone.items() if k[0] is not None and k[0] < 10_000}
    assert len(given) <= 0.02 * len(before)


def test_lines(results):
    before, after = results["line_dedup"]
    found = line_dedup.dedup_lines(before).collect()
    want = Counter((r["doc_id"], r["text"]) for r in found if r["n_lines"] == 0 or r["n_removed"] < r["n_lines"])
    assert texts(after) == want and sum(r["n_removed"] for r in found) > 0
    assert all(r["n_chars"] == len(r["text"]) for r in after.where("text is not null").collect() if r["doc_id"] is not None and r["doc_id"] < 10_000)


def test_one_of_each_group_stays(results):
    before, after = results["ngram_join"]
    found = ngram_join.jaccard_components(before).join(before.select("doc_id", "text"), "doc_id").distinct().collect()
    groups = defaultdict(set)
    for r in found:
        if r["component"] is not None:
            groups[r["component"]].add(r["doc_id"])
    kept = {r["doc_id"] for r in after.collect()}
    for members in groups.values():
        assert kept & members == {min(members)}


def test_near_duplicates_by_five_words_at_four_fifths(spark):
    """The kept ids against brute force; one replaced word in 50 leaves 41 of 51 five-word shingles, 45 of 51 of three words."""
    rows = documents() + [(200 + i, " ".join(f"v{j}" if (i, j) not in ((1, 24), (2, 10), (2, 30)) else "other" for j in range(50)), "en", "s", 1)
                          for i in range(3)]
    rows = list({(r[0], r[1]): r for r in rows if r[0] is not None}.values())
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(j)] = find(i)
    first = {}
    for i, r in enumerate(rows):
        first[find(i)] = min(r[0], first.get(find(i), r[0]))
    want = sorted(r[0] for i, r in enumerate(rows) if not sets[i] or first[find(i)] == r[0])
    assert 200 in want and 201 not in want and 202 in want
    got = corpus_pipeline.join_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_contaminated_documents_go(spark, results):
    before, after = results["decontamination"]
    found = decontamination.contamination(before, table(spark, SF, "benchmark"))
    bad = {r["doc_id"] for r in found.where("contaminated").collect()}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == bad - {None}


def test_packing_takes_everything(results):
    before, after = results["packing"]
    ids = defaultdict(int)
    for r in after.collect():
        ids[r["doc_id"]] += r["length"]
    assert set(ids) == {r["doc_id"] for r in before.collect()}
    used = after.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in used) <= 2048


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_repeated_rows_empty_tables_and_clashes(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "b", 5), (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, "x " + text, "en", "s", 5), (3, None, "en", "s", 0), (3, None, "en", "s", 0)]
    got = corpus_pipeline.join_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted(map(tuple, got), key=str) == [(1, text, "en", "a", 5), (3, None, "en", "s", 0), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame([], DOCS)
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs, SF).count() == 0
    for stage_fn in (corpus_pipeline.join_near_duplicates, corpus_pipeline.decontaminate):
        with pytest.raises(ValueError, match="_k1"):
            stage_fn(spark, docs.withColumn("_k1", docs["doc_id"]), SF)


def test_batches_for_tasks_are_bounded_in_bytes(spark):
    """4,000 texts of 10 kB were four batches of Spark's default; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    def read(spark):
        texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        return texts.mapInArrow(sizes, "size bigint, n bigint").collect()

    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        found = importable(read)(spark)
        assert sum(r["n"] for r in found) == 4000 and max(r["size"] for r in found) < 5 << 20
        spark.conf.set(key, "16m")
        importable(read)(spark)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_language_tasks_empty_what_encoders_remember(monkeypatch):
    """Packing leaves its words in workers that language tasks reuse."""
    monkeypatch.setattr(tokens, "_MEMO", {})
    monkeypatch.setattr(tokens, "_LOADED", {})
    encoder = tokens.remembered(tokens.WordCounts, public_tokenizers.path("word_bpe_49k.json"))
    n = encoder.text("one two three")
    assert len(encoder.known) > 3 and tokens._LOADED
    tokens.forget()
    assert not encoder.known and not tokens._MEMO and not tokens._LOADED
    assert tokens.remembered(tokens.WordCounts, public_tokenizers.path("word_bpe_49k.json")).text("one two three") == n


def test_a_packing_worker_holds_little():
    """Distinct words by the hundred thousand filled 150 MB, and a batch took 8 MB; the ids are those of an empty memory."""
    class Given:
        schema = {"doc_id": packing.T.StructField("doc_id", packing.T.LongType())}

        def select(self, *_):
            return self

        def mapInArrow(self, fn, _):
            return fn

    cut = packing.token_pieces(Given(), *(public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")),
                               public_tokenizers.PATTERN, 2048, 1)
    texts = [" ".join(f"q{i * 10_000 + j}" for j in range(10_000)) for i in range(25)] + ["q1 q2", None]
    tokens.forget()
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    batches = list(cut(iter([given])))
    encoder, = tokens._MEMO.values()
    assert len(encoder.known) <= 200_000
    assert len(batches) > 1 and max(b.nbytes for b in batches) < 3 << 20
    got = defaultdict(bytes)
    for r in pa.Table.from_batches(batches).to_pylist():
        got[r["doc_id"]] += r["ids"]
    tokens.forget()
    fresh = tokens.remembered(tokens.ByteLevelIds, encoder.path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    end = (1).to_bytes(4, "little")
    assert set(got) == set(range(27)) and all(got[i] == fresh.text(texts[i] or "") + end for i in (0, 7, 24, 25, 26))
    tokens.forget()
