"""Token ids by public tokenizer files, remembered word by word inside a task.

Byte-level and word-end tokenizers never merge across the white space between two
words, so the ids of a text are those of its pieces; words repeat, so a worker keeps
what it has encoded. The memory is bounded and emptied when full.
"""

from __future__ import annotations

import array
import base64
import re

import pyarrow as pa

REMEMBERED = 700_000
REMEMBERED_IDS = 200_000
"""As ``REMEMBERED``, of ``ByteLevelIds``: with their ids, 700,000 pieces take 150 MB of a worker."""
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s | \s")
_TAIL = re.compile(r"( ?[^\W\d_]+)([.,]+)")
_WORD = re.compile(r"[a-z]+")
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizers file at ``path``, loaded once per worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _ranks(path: str, pattern: str):
    if path not in _LOADED:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def pieces(text: str) -> list[str]:
    """Cut before every single space between two visible characters: no byte-level token crosses there."""
    if "\0" not in text and not _RUN.search(text):
        return text.replace(" ", "\0 ").split("\0")
    out, at = [], 0
    for m in _CUT.finditer(text):
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


class ByteLevelIds:
    """Ids as little-endian unsigned 32-bit bytes. ``ranks_path`` holds the same vocabulary as byte ranks."""

    def __init__(self, path: str, ranks_path: str, pattern: str):
        self.path, self.ranks, self.known = path, _ranks(ranks_path, pattern), {}

    def _fresh(self, piece: str) -> bytes:
        if "<|" in piece:  # special strings are the file's business
            ids = tokenizer(self.path).encode(piece, add_special_tokens=False).ids
        else:
            if m := _TAIL.fullmatch(piece):
                return self(m[1]) + self(m[2])
            ids = self.ranks.encode_ordinary(piece)
        return array.array("I", ids).tobytes()

    def __call__(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) >= REMEMBERED_IDS:
                self.known.clear()
            got = self._fresh(piece)
            if len(piece) < 64:
                self.known[piece] = got
        return got

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        parts = pieces(text)
        known = self.known.get
        return b"".join([known(p) or self(p) for p in parts])


class WordCounts:
    """Number of tokens, for tokenizers that drop white space and end words with a suffix."""

    def __init__(self, path: str):
        self.tok, self.known = tokenizer(path), {"": 0}

    def _fresh(self, piece: str) -> int:
        if m := _TAIL.fullmatch(piece):
            return self(m[1]) + self(m[2])
        small = piece.lower() if piece.isascii() else piece
        if _WORD.fullmatch(small):
            return len(self.tok.model.tokenize(small))
        return len(self.tok.encode(piece, add_special_tokens=False).ids)

    def __call__(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known = {"": 0}
            got = self._fresh(piece)
            if len(piece) < 64:
                self.known[piece] = got
        return got

    def text(self, text: str) -> int:
        known = self.known.get
        total = 0
        for p in text.split(" "):
            n = known(p)
            total += self(p) if n is None else n
        return total


_MEMO: dict[tuple, object] = {}


def remembered(kind, *args):
    """One encoder per worker and file."""
    key = (kind, *args)
    if key not in _MEMO:
        _MEMO[key] = kind(*args)
    return _MEMO[key]


def give_back() -> None:
    """Returns what Arrow holds of earlier batches to the system; workers are reused and several share an executor."""
    pa.default_memory_pool().release_unused()


def forget() -> None:
    """Empties what the encoders of this worker remember, for tasks of other operators that reuse the worker."""
    for encoder in _MEMO.values():
        encoder.known.clear()
    _MEMO.clear()
    _LOADED.clear()
