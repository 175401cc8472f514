"""Removal of repeated word sequences against a comparison of all windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from gaugeworks.llm.fm_index import FmIndex, Wavelet
from gaugeworks.llm.substring_dedup import cuts, dedup_substrings, repeated_windows
from gaugeworks.llm.shingles import text_words

SCHEMA = "doc_id bigint, text string, spans string, n int"


def by_hand(rows: list[tuple], window: int) -> Counter:
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first: dict[tuple, int] = {}
    for doc, words in texts:
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = Counter()
    for (doc, words), row in zip(texts, rows):
        gone = {p for s in range(len(words) - window + 1) if doc is not None and first[tuple(words[s:s + window])] < doc for p in range(s, s + window)}
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone).decode()
        out[(doc, None if row[1] is None else kept, *row[2:], len(words), len(gone))] += 1
    return out


def documents(seed: int, few: int) -> list[tuple]:
    rng = random.Random(seed)

    def text(n: int) -> list[str]:
        return [f"w{rng.randrange(few)}" for _ in range(n)]

    line, page = text(30), text(120)
    rows = []
    for i in range(70):
        words = text(rng.randrange(60))
        if i % 3 == 0:  # a passage that many share, in differing surroundings
            words += line + text(rng.randrange(10))
        if i % 7 == 0:  # nearly the same page
            page_now = list(page)
            page_now[rng.randrange(120)] = "Ändert"
            words += page_now
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(200 + i, rows[7][1]) for i in range(20)]  # copies, one of them twice
    rows += [rows[-1], (None, rows[7][1]), (None, None), (300, None), (301, ""), (302, " \t\n"), (303, "one"), (3, rows[21][1]),
             (304, "same " * 700), (305, "same " * 650), (306, "a b " * 30), (307, "Same " * 60), (308, " ".join(text(4000))), (309, "x y " * 40), (-5, "a b " * 9)]
    return [(*r, "keep", i) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed, few, window, shard", [(1, 3, 7, 400_000), (2, 3, 7, 150), (3, 500, 20, 60), (4, 40, 50, 500)])
def test_equals_comparison_of_windows(spark, seed, few, window, shard):
    rows = documents(seed, few)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = dedup_substrings(docs, window=window, shard_words=shard)
    assert found.columns == ["doc_id", "text", "spans", "n", "n_words", "n_removed", "removed"]
    want, have = by_hand(rows, window), Counter(tuple(r)[:-1] for r in found.collect())
    assert have == want
    for r in found.where("n_removed > 0").limit(20).collect():
        assert sum(x.high - x.low for x in r.removed) == r.n_removed


def test_joined_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("gaugeworks.llm.substring_dedup.BROADCAST_KEYS", 0)
    rows = documents(5, 20)
    assert Counter(tuple(r)[:-1] for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA), window=12).collect()) == by_hand(rows, 12)


def test_clashes_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError, match="n_removed"):
        dedup_substrings(empty.withColumnRenamed("n", "n_removed"))
    assert repeated_windows(spark.createDataFrame([], "k1 bigint, k2 bigint, doc bigint, text string")).count() == 0


def test_cuts_cover_each_window_once():
    words = text_words(" ".join(str(i % 11) for i in range(100)) + " z" * 3000, False)
    anchor, starts, sizes = cuts(words, 50, 0)
    assert starts[0] == 0 and (starts[1:] == starts[:-1] + sizes[:-1]).all() and sizes.sum() == len(words) - 49
    assert sizes.max() <= 512


def test_index_finds_classes_and_ranks():
    rng = random.Random(3)
    symbols = np.array([rng.randrange(37) for _ in range(500)])
    wavelet = Wavelet(symbols, 37)
    for c in (0, 5, 36):
        start = wavelet.follow(np.array([c]), np.array([0]))
        ends = wavelet.follow(np.full(501, c), np.arange(501))
        assert (ends - start == np.concatenate([[0], np.cumsum(symbols == c)])).all()
    texts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(9, 60))] for _ in range(40)]
    index = FmIndex(texts, 9)
    seen: dict[tuple, set] = {}
    for cut, start, classes in index.windows(9):
        for i, s, c in zip(cut, start, classes):
            seen.setdefault(tuple(texts[i][s:s + 9]), set()).add((int(c), int(index.class_starts[c + 1] - index.class_starts[c])))
    counts = Counter(tuple(t[s:s + 9]) for t in texts for s in range(len(t) - 8))
    assert {k: v for k, v in counts.items()} == {k: next(iter(v))[1] for k, v in seen.items()} and all(len(v) == 1 for v in seen.values())
