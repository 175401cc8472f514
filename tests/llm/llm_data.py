"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def documents(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = []
    base = words(rng, 60)
    line = " ".join(words(rng, 40))
    for i in range(60):
        if i % 6 == 0:  # near copies
            w = list(base)
            if i:
                w[rng.randrange(60)] = "changed"
            text = " ".join(w)
        elif i % 6 == 1:  # a line that many share
            text = "\n".join([" ".join(words(rng, 12)), line, " ".join(words(rng, 3))])
        elif i % 6 == 2:  # nearly that line
            text = line + " tail" + str(i) + "\n" + " ".join(words(rng, 9))
        else:
            text = "\n".join(" ".join(words(rng, rng.randint(1, 30))) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, "en", "src0", len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 4), (103, "Einzig", "de", "s", 6),
             (104, rows[0][1], "en", "s", 1), (105, rows[0][1].upper(), "en", "s", 1), (None, rows[3][1], "en", "s", 1),
             (None, rows[3][1], "en", "s", 1), (106, " ".join(words(rng, 3000)), "en", "s", 1), rows[5], rows[5],
             (107, "a  b\n\na  b", "en", "s", 1), (108, "123 456 %%%", "en", "s", 1)]
    return rows
