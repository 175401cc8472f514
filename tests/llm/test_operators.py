"""The operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import (decontamination, importance, language_id, line_dedup, links, neighbours, ngram_join, packing, queries,
                            sharding, shingles, token_counts, tokens, warc)
from gaugeworks.llm.common import components, positions, stage
from llm_data import DOCS, documents

BYTES = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN]
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5)


# --- shared helpers --------------------------------------------------------------------------

def test_positions_are_gapless_in_order(spark):
    df = stage(spark.range(1000).select((F.col("id") % 7).alias("k"), "id"), "t")
    got = sorted(positions(df, ["k", "id"], "t").collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1000))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(1000))


def test_staging_leaves_no_shuffle_files(spark):
    """The files go with the write, though the frame they were made for is still held; the setting is as before."""
    blocks, conf = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        each = blocks.getAllFiles()
        return {n for i in range(each.size()) if (n := each.apply(i).getName()).startswith("shuffle_")}

    before, set_before = files(), spark.conf.get(conf)
    df = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n")).withColumn("at", F.rand(3))
    held = df.repartition(4, "k")
    assert sorted(r["k"] for r in stage(held, "t").collect()) == list(range(50))
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(conf) == set_before
    assert held.count() == 50


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(i, 99) for i in range(100, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "t").collect()}
    want = {i: 0 for i in range(41)} | {i: 99 for i in range(99, 160)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "t").count() == 0


# --- sharding --------------------------------------------------------------------------------

@pytest.mark.parametrize("shards", [1, 3, 8, 100])
def test_shards_are_exact_and_gapless(docs, shards):
    got = sharding.shard(docs, shards, seed=3).collect()
    assert Counter(r[:5] for r in map(tuple, got)) == Counter(documents())
    sizes = Counter(r["shard"] for r in got)
    n = len(documents())
    assert [sizes.get(s, 0) for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_documents_are_exchanged_once(docs):
    plan = sharding.shard(docs, 8, seed=3)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) == 1 and "SortMergeJoin" not in plan


def test_every_place_is_equally_likely(spark):
    """15 shuffles of 40 rows in 4 partitions: where rows come from says nothing about shard or half."""
    rows = spark.range(40).repartition(4).select("id")
    seen = Counter()
    for seed in range(15):
        for r in sharding.shard(rows, 2, seed=seed).collect():
            seen[(r["id"] < 20, r["shard"], r["slot"] < 10)] += 1
    assert len(seen) == 8 and max(abs(n - 75) for n in seen.values()) < 42  # five standard deviations


def test_ranges_give_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 3)
    got = sharding.shard(spark.range(1000).repartition(7), 3, seed=1).collect()
    assert sorted(r["id"] for r in got) == list(range(1000))
    assert [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(3)] == [list(range(n)) for n in (334, 333, 333)]


def test_shards_of_nothing_and_clashes(spark, docs):
    assert sharding.shard(spark.createDataFrame([], DOCS), 8).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs.withColumn("slot", F.lit(1)), 8)


def test_hypergeometric_draws_follow_the_law(spark):
    u = (F.col("id") + 0.5) / 4000
    draw = sharding._hypergeometric(*(F.lit(x).cast("long") for x in (50, 20, 12)), u)
    got = Counter(r[0] for r in spark.range(4000).select(draw).collect())
    for k in range(13):
        p = math.comb(20, k) * math.comb(30, 12 - k) / math.comb(50, 12)
        assert abs(got[k] / 4000 - p) < 1e-3


def test_matrix_has_exact_margins(spark):
    sizes = [(p, n) for p, n in enumerate([0, 5, 1000, 3, 100000, 7, 20])]
    rows = sharding.communication_matrix(spark.createDataFrame(sizes, "part bigint, n bigint"), 8, 5).collect()
    counts = {r["part"]: np.diff([0, *r["ends"]]) for r in rows}
    assert {p: int(c.sum()) for p, c in counts.items()} == dict(sizes)
    total = sum(n for _, n in sizes)
    assert sum(counts.values()).tolist() == [total // 8 + (s < total % 8) for s in range(8)]
    assert abs(counts[4] - 100000 / 8).max() < 6 * math.sqrt(100000 / 8)


# --- packing ---------------------------------------------------------------------------------

def test_pack_round_trip(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTES[0])
    got = packing.pack(packing.token_pieces(docs, *BYTES, 64, 1), 64).collect()
    want = Counter()
    for r in documents():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 64):
            want[r[0], s, np.array(ids[s:s + 64], "<u4").tobytes(), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) // 4
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
        assert sum(n for _, n in places) <= 64
    assert sorted(by) == list(range(len(by)))


def test_patterns_place_every_length_once():
    rng = np.random.default_rng(1)
    for _ in range(30):
        histogram = {int(k): int(v) for k, v in Counter(rng.integers(1, 129, rng.integers(1, 3000)).tolist()).items()}
        placed = Counter()
        patterns = packing.shortest_pack_first(histogram, 128)
        for pattern, count in patterns:
            assert sum(s * n for s, n in pattern) <= 128
            for s, n in pattern:
                placed[s] += n * count
        assert placed == histogram
        full = sum(s * n for s, n in histogram.items()) / 128
        assert sum(c for _, c in patterns) <= 1.1 * full + 2 or max(histogram) > 64


def test_pack_rejects_bad_lengths(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 65)], "x bigint, length bigint"), 64)
    assert packing.pack(spark.createDataFrame([], "x bigint, length bigint"), 64).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", " lead", "trail ", "x \n y", "a\n\n b", "it's, 'twas.", "é, ß. ²a, b",
                                  "<|endoftext|> a<|endoftext|>b", "tab\t x", "  nb  x", "a\0b c", "12,5 3.", "...,,, ."])
def test_remembered_ids_equal_the_library(text):
    from tokenizers import Tokenizer
    ids = Tokenizer.from_file(BYTES[0]).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.ByteLevelIds(*BYTES).text(text), "<u4").tolist() == ids
    n = len(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids)
    assert tokens.WordCounts(WORDS).text(text) == n


# --- token counts ----------------------------------------------------------------------------

def test_token_counts(docs):
    tok = tokens.tokenizer(WORDS)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 100)
                   for r in documents())
    assert Counter(map(tuple, token_counts.token_counts(docs, WORDS, 100, chunk=500, overlap=8).collect())) == want


@pytest.mark.parametrize("text", ["ab " * 400, "x" * 900, "x" * 300 + " y" * 300, "Ünï codé, 12.5! " * 90 + "z" * 200, "\n".join(["word"] * 300)])
def test_resynchronised_counts(text):
    tok = tokens.tokenizer(WORDS)
    for chunk, overlap in ((64, 4), (100, 30), (2000, 10)):
        assert token_counts.count_resynchronised(tok, text, chunk, overlap) == len(tok.encode(text, add_special_tokens=False).ids)


# --- decontamination -------------------------------------------------------------------------

def _words3(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination(spark, docs):
    base = documents()[0][1].split()
    long_line = documents()[1][1].split("\n")[1]
    items = [(1, " ".join(base[3:30])), (2, "einzig"), (3, None), (4, "..."), (None, "einzig"), (5, long_line), (6, " ".join(base[3:30]).upper()),
             (7, " ".join(base[10:21])), (8, "nowhere at all"), (9, " ".join(base[50:60] + ["other"] * 5)), (9, "einzig")]
    got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    want = Counter()
    for r in documents():
        w = _words3(r[1])
        hit, found = set(), set()
        for item, text in items:
            iw = _words3(text)
            size = min(13, len(iw))
            for s in range(len(iw) - size + 1) if iw else []:
                for d in range(len(w) - size + 1):
                    if w[d:d + size] == iw[s:s + size]:
                        hit.update(range(d, d + size))
                        found.add(item)
        want[r[0], len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == want


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, none).collect())
    assert decontamination.contamination(spark.createDataFrame([], DOCS), none).count() == 0


def test_proximity(spark):
    texts = [(1, "a b c d e f"), (2, "c x x a"), (3, "a x x x x c"), (4, "b"), (5, "c a c a")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    groups = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "group int, term string")
    index = decontamination.build_index(docs, groups, False)
    key = {(r["k1"], r["k2"]): r["doc_id"] for r in index.select("k1", "k2", "doc_id").distinct().collect()}
    got = {(key[r["k1"], r["k2"]], r["group"]) for r in decontamination.proximity_hits(index, groups, 3).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (1, 2), (4, 2)}


# --- line dedup ------------------------------------------------------------------------------

def _line_set(line):
    w = [x for x in line.split(" ") if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1)))


def test_line_dedup(docs):
    unique = {(r[0], r[1]) for r in documents() if r[1] is not None}
    order = sorted(((r, i, x) for r in unique for i, x in enumerate(r[1].split("\n")) if x.strip(" ")),
                   key=lambda t: (t[0][0] is not None, t[0][0] or 0, t[1]))
    sets = [_line_set(x) for _, _, x in order]
    root = list(range(len(order)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(order)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    gone = {(order[i][0], order[i][1]) for i in range(len(order)) if find(i) != i}
    want = Counter()
    for r in documents():
        lines = [] if r[1] is None else r[1].split("\n")
        kept = [x for i, x in enumerate(lines) if ((r[0], r[1]), i) not in gone]
        want[r[0], None if r[1] is None else "\n".join(kept), len([x for x in lines if x.strip(" ")]), len(lines) - len(kept)] += 1
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == want
    assert len(gone) > 20


def test_line_dedup_of_nothing(spark, docs):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit(1)))


def test_line_dedup_splits_a_text_once(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(get(split(" not in plan and plan.count("split(text") == 1


def test_line_tokens(spark):
    words = ["a", "b", "c", "d", "e"]
    texts = [" ".join(w) for n in range(1, 6) for w in itertools.product(words[:4], repeat=n)]
    texts += [" ".join(w) for w in itertools.permutations(words)]
    lines = spark.createDataFrame([(x,) for x in sorted(set(texts))], "line string")
    tokens = line_dedup._with_tokens(lines, bytes(range(64)) * 1024)
    got = [r["tokens"] for r in tokens.collect()]
    assert all(len(x) == 1 for x in got) and len({x[0] for x in got}) == len(set(texts))
    rows = spark.createDataFrame([("  a b c d  e f a b c d e",), ("a b c d e f a b c d e f a b c d e f",)], "line string")
    one, two = (set(r["tokens"]) for r in line_dedup._with_tokens(rows, bytes(1 << 16)).collect())
    assert len(one) == len(two) == 6 and len(one & two) == 6


# --- n-gram join -----------------------------------------------------------------------------

def _shingles(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def test_jaccard_components(docs):
    rows = [(r[0], _shingles(r[1])) for r in documents()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            a, b = rows[i][1], rows[j][1]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[find(j)] = find(i)
    least = {}
    for i, (doc, s) in enumerate(rows):
        if s and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = Counter((doc, len(s), least.get(find(i), doc) if s else doc) for i, (doc, s) in enumerate(rows))
    found = ngram_join.smallest_of_component(ngram_join.jaccard_components(docs))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == want


def test_jaccard_sets_are_exchanged_only_where_rows_repeat(spark, monkeypatch):
    """The tokens of a set come from one row; only texts of rows that come twice are dealt out for that."""
    seen, real = [], ngram_join.linked

    def spied(sets, candidates, tokens, *rest):
        held = tokens(sets.select("id").distinct())
        seen.append(("dropduplicates" in (p := held._jdf.queryExecution().analyzed().toString().lower()) or "deduplicate" in p, held.collect()))
        return real(sets, candidates, tokens, *rest)

    monkeypatch.setattr(ngram_join, "linked", spied)
    once = [(i, " ".join(f"w{i}_{j}" for j in range(10))) for i in range(4)] + [(9, " ".join(f"w0_{j}" for j in range(10)))]
    for rows in (once, once + once[:2]):
        found = ngram_join.smallest_of_component(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
        assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter((i, i % 9) for i, _ in rows)
    (plain, sets), (dealt, again) = seen
    assert not plain and dealt and len(sets) == len(again) == 4
    assert sorted((r["id"], sorted(r["tokens"])) for r in sets) == sorted((r["id"], sorted(r["tokens"])) for r in again)


def test_jaccard_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_links_through_members_that_no_hub_reaches(spark):
    """A chain of texts, each like its neighbours only, around a hot list that all share."""
    w = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(w[4 * i:4 * i + 120])) for i in range(40)]
    found = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r["component_id"] for r in ngram_join.smallest_of_component(found).collect()} == {0}


def test_only_the_sets_of_listed_pairs_are_exchanged(spark, monkeypatch):
    """Texts that share a rare phrase keep its list open, but most are sorted out by their signatures."""
    seen, real = [], ngram_join.linked

    def spied(sets, candidates, tokens, verify, *rest):
        def checked(pairs, held):
            seen.append(({x for r in pairs.collect() for x in r}, sorted(r["id"] for r in held.select("id").collect())))
            return verify(pairs, held)
        return real(sets, candidates, tokens, checked, *rest)

    monkeypatch.setattr(ngram_join, "linked", spied)
    texts = [(i, " ".join(f"w{j}" for j in range(i, i + 22))) for i in range(160)]
    texts += [(1000 + i, " ".join(["rare phrase here", *(f"c{i}w{j}" for j in range(60))])) for i in range(20)]
    found = ngram_join.smallest_of_component(ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string")))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {doc: 0 if doc < 1000 else doc for doc, _ in texts}
    (_, _), (paired, held) = seen
    assert paired and held == sorted(paired)


def test_links_of_exactly_the_least_overlap(spark):
    """Chains of 20 shingles that share 19 with the next text, in lists longer than the hubs; inner words are equally rare."""
    texts = [(1000 * c + i, " ".join(f"c{c}w{j}" for j in range(i, i + 22))) for c in range(3) for i in range(160)]
    found = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string"))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.smallest_of_component(found).collect()}
    assert got == {doc: doc // 1000 * 1000 for doc, _ in texts}


def test_signatures_pass_every_pair_that_reaches_the_similarity(spark):
    """Pairs around the least overlap, sets from one token to more than a signature has bits."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 2, 9, 40, 150, 900):
        base = rng.integers(-2 ** 63, 2 ** 63, size)
        for share in (0, 0.05, 0.1, 0.2, 0.5, 1):
            other = base.copy()
            other[:int(share * size)] = rng.integers(-2 ** 63, 2 ** 63, int(share * size))
            sets.append((len(sets), sorted({int(x) for x in other})))
    rows = spark.createDataFrame(sets, "id bigint, tokens array<bigint>")
    signed = stage(rows.join(links.signatures(rows), "id").withColumn("n", F.size("tokens")), "signed")
    one, two = (signed.select(*[F.col(c).alias(f"{c[0]}{x}") for c in ("id", "n", "sign")]) for x in "ab")
    both = one.join(two, F.col("ia") < F.col("ib"))
    passed = {(r["ia"], r["ib"]) for r in both.where(links.near_signatures("na", "sa", "nb", "sb", 4, 5)).collect()}
    alike = {(i, j) for i, a in sets for j, b in sets if i < j and 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b})}
    assert alike and alike <= passed and len(passed) < 2 * len(alike)


def test_word_and_shingle_hashes():
    assert len(shingles.text_words("Ab  cd\x0bab")) == 3
    a = shingles.text_words("Ab cd AB")
    assert a[0] == a[2] != a[1]
    long = "x" * 9000
    swapped = long[:100] + "y" + long[101:]
    moved = long[:4196] + "y" + long[4197:]
    assert len({int(shingles.text_words(t)[0]) for t in (long, swapped, moved, long + "x")}) == 4
    assert len(shingles.shingle_set("a b", 3)) == 1 and not len(shingles.shingle_set(" ", 3)) and not len(shingles.shingle_set(None, 3))


def test_heap_merge_and_probe():
    assert ngram_join.merge_short_lists([[(1, 10), (5, 10)], [(5, 10)], [(5, 10), (9, 30)]], 10, 9, 10) == [5]
    a, b = np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64)
    assert ngram_join.reaches(a, b) and not ngram_join.reaches(a, b + np.uint64(1))


# --- nearest neighbours ----------------------------------------------------------------------

def test_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).astype("float32").tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # ties
    rows += [(5000, None), (5001, [0.0] * 12), (5020, [float("nan")] * 12), (5040, [None] * 12), (5060, [float("inf")] * 12),
             (None, rows[1][1]), rows[20], rows[20], (7000, [1.0, 2.0]), (7020, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 7, query_block=9, candidate_block=60).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    valid = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    want = {}
    for q in (i for i in valid if i % 20 == 0):
        scored = []
        for c, v in valid.items():
            if c != q and len(v) == len(valid[q]):
                total = 0.0
                for x, y in zip(valid[q], v):
                    total += float(x) * float(y)
                scored.append((-total, c))
        want[q] = [(k + 1, c, -s) for k, (s, c) in enumerate(sorted(scored)[:7])]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


# --- language --------------------------------------------------------------------------------

def test_language(spark):
    rng = np.random.default_rng(2)
    parts = {"xx": "ba be bi bo".split(), "yy": "sta ste sti sto".split(), "zz": "кра кре кри".split()}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang))
    extra = [(900, None, "xx"), (901, "", "xx"), (902, "12 34 !!", "yy"), (903, "ba", None), (904, "qzqzqz wkwkwk " * 30, None)]
    df = spark.createDataFrame([*rows, *extra], "doc_id bigint, text string, lang string")
    model = language_id.fit(df.where("doc_id < 240 or doc_id >= 900"), per_language=60)
    got = {r["doc_id"]: r for r in language_id.identify(df.withColumnRenamed("lang", "clash"), model).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] and not got[i]["rejected"] for i in range(300))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert got[904]["rejected"] and not got[903]["rejected"]
    empty = language_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df.select("doc_id", "text"), empty).collect()} == {"und"}


# --- archives --------------------------------------------------------------------------------

def test_archive_round_trip(spark):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a", big), (9, "http://b\r\nX: y", big), (5, None, big), (2, "u", None), (3, "u", ""), (4, "u", ""), (None, "u", big),
            (6, "u", "short"), (7, "u", "short"), (9, "http://c", big)] + [(100 + i, "u", f"{i} " * 600) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("size", F.lit(1)).repartition(3)
    index, folder = warc.archive(df)
    got = warc.read_bundles(index, folder).collect()
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and html == big and page != 9
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    empty, nowhere = warc.archive(df.limit(0))
    assert warc.read_bundles(empty, nowhere).count() == 0


def test_bundle_is_plain_zstandard_and_seekable(spark):
    import io

    import zstandard
    from pyarrow import fs
    df = spark.createDataFrame([(i, "u", f"{i} " * 900) for i in range(400)], "page_id bigint, url string, html string").coalesce(1)
    index, folder = warc.archive(df)
    store, base = fs.FileSystem.from_uri(folder)
    (name,) = {r["bundle"] for r in index.select("bundle").collect()}
    data = store.open_input_file(f"{base}/{name}").read()
    frames = warc.read_seek_table(lambda p, n: data[p:p + n], len(data))
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(frames) > 2 and len(plain) == sum(f[2] for f in frames) and plain.count(b"WARC/1.1\r\n") == 400
    starts = np.cumsum([0, *[f[2] for f in frames]])
    for r in index.collect():
        at = starts[r["frame"]] + r["place"]
        assert warc.parse_record(plain[at:at + r["size"]])["headers"]["warc-page-id"] == str(r["page_id"])


# --- resampling ------------------------------------------------------------------------------

def test_resample(spark, docs):
    targets = spark.createDataFrame([(i,) for i in range(0, 60, 6)] + [(None,), (0,)], "doc_id bigint")
    got = importance.resample(docs, targets, 0.3, seed=1, buckets=500).collect()
    raw, goal = Counter(), Counter()
    for r in documents():
        if r[1]:
            found = Counter(importance.buckets_of(r[1], 500).tolist())
            raw += found
            if r[0] is not None and r[0] < 60 and r[0] % 6 == 0:
                goal += found
    n_raw, n_goal = sum(raw.values()) + 500, sum(goal.values()) + 500
    want = Counter()
    for r in documents():
        grams = importance.buckets_of(r[1], 500).tolist() if r[1] else []
        w = sum(math.log((goal[g] + 1) / n_goal) - math.log((raw[g] + 1) / n_raw) for g in grams)
        want[r[0], len(grams), round(w, 6)] += 1
    assert Counter((r["doc_id"], r["n_grams"], round(r["log_weight"], 6) + 0.0) for r in got) == want
    order = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in order] == list(range(len(documents())))
    assert [r["key"] for r in order] == sorted((r["key"] for r in got), reverse=True)
    assert sum(r["selected"] for r in got) == round(0.3 * len(documents())) and all(r["selected"] for r in order[:5])
    assert importance.resample(docs.limit(0), targets, 0.5).count() == 0


def test_gumbel_noise_has_its_distribution(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    keys = np.array([r["key"] for r in importance.resample(df, df.limit(0), 0.5).collect()])
    assert abs(keys.mean() - 0.5772) < 0.08 and abs(keys.std() - math.pi / math.sqrt(6)) < 0.08


# --- registered queries ----------------------------------------------------------------------

SF = "/root/testdata/sf0.01"


def test_shard_query(spark):
    got = queries.QUERIES["op1_shard_hypergeometric"](spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in got)
    assert {type(f.dataType) for f in queries.QUERIES["op1_shard_hypergeometric"](spark, SF).schema[5:7]} >= {T.LongType}


def test_shard_query_moves_the_documents(spark, monkeypatch):
    given, shard = [], sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda df, *args, **kw: given.append(df.columns) or shard(df, *args, **kw))
    got = queries.QUERIES["op1_shard_hypergeometric"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert given == [docs.columns] and got.count() == docs.count()


def test_pack_query_equals_the_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTES[0])
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            want[r["doc_id"], s, zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes()), len(ids)] += 1
    got = queries.QUERIES["op2_pack_shortest_first"](spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    used = len({r["sequence_id"] for r in got})
    assert sum(r["length"] for r in got) / (2048 * used) > 0.98


def test_language_query_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op7_language_centroids"](spark, SF).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_count_query_equals_the_library(spark):
    tok = tokens.tokenizer(WORDS)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_count_resynchronised"](spark, SF).collect():
        n = len(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def test_the_sample_is_the_smallest_hashes_of_a_language(spark):
    ids = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang"), "id").union(
        spark.createDataFrame([("fr", i) for i in range(30)], "lang string, id bigint"))
    got = {(r.lang, r.id) for r in language_id._smallest_hashes(ids, 100).collect()}
    hashed = ids.withColumn("h", F.xxhash64("id")).collect()
    want = {(x.lang, x.id) for lang in ("de", "en", "fr") for x in sorted((r for r in hashed if r.lang == lang), key=lambda r: (r.h, r.id))[:100]}
    assert got == want and len(got) == 230


def test_counts_and_packed_ids_on_the_given_documents(spark):
    """Both queries against the library on whole texts, some of them above the chunk of op9."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sum(len(t) > token_counts.CHUNK for _, t in docs) > 5
    tok = tokens.tokenizer(WORDS)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in queries.QUERIES["op9_count_resynchronised"](spark, sf).collect()}
    assert got == {i: (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in docs}
    tok = tokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in docs}
    pieces = queries.QUERIES["op2_pack_shortest_first"](spark, sf).collect()
    for r in pieces:
        ids = np.array(want[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
    assert sum(r["length"] for r in pieces) == sum(map(len, want.values()))
