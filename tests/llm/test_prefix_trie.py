"""The prefix trie against a trie built by hand."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gaugeworks.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, n1 int"


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = []
    for conv in range(90):
        for turn in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "bot", rng.choice(["yes", "no", "Grüß  Gott\tan alle", "a b c"]), "x", 1))
    rows += [(97, t, "user", f"long {t % 3}", None, None) for t in range(700)]  # most rows in one conversation
    rows += [(c, 0, "user", "the same", None, None) for c in range(200, 460)]  # most conversations alike
    rows += [(500, None, None, None, None, None), (500, 0, "", "", None, None), (501, 1, "b", "tie", None, 3), (501, 1, "a", "tie", None, 3),
             (501, 1, "a", "tie", None, 3), (None, 0, "user", "nobody's", None, None), (-21, 0, "user", "yes", None, None), (502, 2, "u", "x " * 30_000, None, 1)]
    rng.shuffle(rows)
    return rows


def by_hand(rows: list[tuple]) -> Counter:
    original = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(t)] for c, t in original.items()}
    rebuilt = {}
    for c, turns in original.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(original.get(base, [])[:h] + turns[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[:d - 1]].add(turns[:d])
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words
            leaves[node[:d]] += not children[node]
    return Counter((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, who in members.items())


@pytest.fixture
def many_ranges(spark):
    """Small inputs over all shuffle partitions, so that lists and conversations lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed, chunk", [(1, 7), (2, 1 << 16)])
def test_query_equals_trie_by_hand(many_ranges, tmp_path, monkeypatch, seed, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = conversations(seed)
    many_ranges.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op13_collapse_conversations"](many_ranges, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == by_hand(rows)


def test_empty_table_and_turnless(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_collapse_conversations"](spark, str(tmp_path)).count() == 0
    rows = [(next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4), 0, "user", "lost", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/one/conversations.parquet")
    found = queries.QUERIES["op13_collapse_conversations"](spark, f"{tmp_path}/one").collect()
    assert [tuple(r)[1:7] for r in found] == [(0, None, 1, 0, 1, 0)]
    assert Counter(map(tuple, found)) == by_hand(rows)


def test_tables_of_a_trie(many_ranges):
    turns = many_ranges.createDataFrame([(c, p, "user", t) for c, text in ((1, "ab"), (2, "ab"), (3, "a"), (4, "ac")) for p, t in enumerate(text)],
                                        "conv_id bigint, pos bigint, role string, text string")
    trie = prefix_trie.prefix_trie(prefix_trie.turn_marks(turns), turns.select("conv_id"))
    assert sorted((r.conv_id, r.weight, r.length, r.leaf) for r in trie.sequences.collect()) == [(1, 2, 2, True), (3, 1, 1, False), (4, 1, 2, True)]
    assert trie.ends.count() == 4 and trie.nodes.count() == 4
