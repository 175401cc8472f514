"""Spelling variants against a comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from gaugeworks.llm import queries, spelling

DOCS = "doc_id bigint, text string, word string, n int"


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def variants_by_hand(counts: dict[str, int], ratio: int = 10) -> set[tuple]:
    near: dict[str, list[str]] = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def many_words(seed: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choice("abßé") for _ in range(rng.randint(7, 9))) for _ in range(250)}
    base = "international"  # most words share a beginning, or an end
    words |= {base + a + b for a in "abcdefgh" for b in "abcdefgh"} | {a + b + base for a in "abcdé" for b in "abcdé"} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa"}
    for w in list(words)[:120]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + "ÿ" + w[k + 1:]}
    return {w: rng.choice([2, 3, 20, 45, 300, 5000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("seed, longest", [(1, 2_000), (2, 6), (3, 1)])
def test_variants_equal_all_pairs(spark, seed, longest):
    counts = many_words(seed)
    rows = spark.createDataFrame([(n, w, "other") for w, n in counts.items()], "n bigint, word string, near string").repartition(4)
    found = [tuple(r) for r in spelling.spelling_variants(rows, longest=longest).collect()]
    assert set(found) == variants_by_hand(counts) and len(found) == len(counts)


def test_scan_of_a_list_passes_over_ranges():
    rng = random.Random(4)
    for length in (3, 6):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([length, length + 1]))) for _ in range(60)})
        found = set(spelling.near_in_list(words, length))
        assert found == {(i, j) for i, j in combinations(range(len(words)), 2)
                         if one_edit(words[i], words[j]) and min(len(words[i]), len(words[j])) == length}


def documents() -> list[tuple]:
    rng = random.Random(5)
    base = ["Wasserstand", "größenordnung", "internationally", "ÀÉÎÕÜßÿ", "measurement", "shorter", "sechs", "naïvement×ok"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ",", "1", "\n"]) for _ in range(rng.randrange(90))), "w", 1) for i in range(60)]
    rows += [(70, None, None, None), (71, "", None, None), (None, "Wasserstand measurement " * 40, None, 1), rows[3], rows[3], (72, "Measurements " * 30_000, None, 1), (-4, "MEASUREMENT", None, 1)]
    return rows


def test_query_equals_words_by_hand(spark, tmp_path):
    rows = documents()
    counts: Counter = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.QUERIES["op11_group_spellings"](spark, str(tmp_path)).collect()]
    assert set(found) == variants_by_hand(counts) and len(found) == len(counts)


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    counts = spelling.word_counts(docs)
    assert counts.count() == 0 and spelling.spelling_variants(counts).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(None, 3), ("a", 1), ("a", 2)], "word string, n bigint")).collect()[0][:4] == ("a", None, "a", 3)
