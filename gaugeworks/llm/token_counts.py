"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are resynchronised."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Encoding

from gaugeworks.llm.tokens import WordCounts, remembered, tokenizer

CHUNK, OVERLAP = 4_000, 256


class Piece(NamedTuple):
    """An encoding of ``text[begin:...]``; tokens before ``first`` are counted already."""

    encoding: Encoding
    begin: int
    first: int = 0

    def starting(self, place: int) -> int | None:
        """The token that starts at a place of the text, if one does."""
        token = self.encoding.char_to_token(place - self.begin)
        return token if token is not None and self.encoding.token_to_chars(token)[0] == place - self.begin else None


def _encode(tok, text: str, begin: int, end: int) -> Piece:
    return Piece(tok.encode(text[begin:end], add_special_tokens=False), begin)


def _common_boundary(text: str, left: Piece, right: Piece, low: int, high: int) -> tuple[int, int] | None:
    """Tokens of both encodings that start at one place in (low, high) that no token can cross.

    The place follows white space, which the tokenizer drops and never merges across,
    so what stands left of it cannot change the tokens right of it and the reverse.
    The token there must be the same in both encodings. The place nearest to the
    middle is taken, away from the cut ends.
    """
    places = [x for x in range(low + 1, high) if text[x - 1] in " \n\t\r"]
    for x in sorted(places, key=lambda x: (abs(2 * x - low - high), x)):
        i, j = left.starting(x), right.starting(x)
        if i is not None and j is not None and left.encoding.ids[i] == right.encoding.ids[j]:
            return i, j
    return None


def count_resynchronised(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, equal to encoding it at once, never encoding more than needed together.

    Consecutive chunks share ``overlap`` characters and are spliced at a common
    boundary. Where there is none (a run without white space) the overlap is doubled
    by moving the end of the left chunk, in the end to the end of the text.
    """
    total, end = 0, min(len(text), chunk)
    left = _encode(tok, text, 0, end)
    while end < len(text):
        wide = overlap
        while True:
            low = max(left.begin, end - wide)
            next_end = min(len(text), low + max(chunk, 2 * wide))
            right = _encode(tok, text, low, next_end)
            splice = _common_boundary(text, left, right, low, end)
            if splice is not None and splice[0] >= left.first:
                break
            wide *= 2
            end = min(len(text), end + wide)
            left = _encode(tok, text, left.begin, end)._replace(first=left.first)
            if end == len(text):
                return total + len(left.encoding) - left.first
        total += splice[0] - left.first
        left, end = right._replace(first=splice[1]), next_end
    return total + len(left.encoding) - left.first


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text is an empty one (0 bytes, 0 tokens). Rows are independent of each other:
    repeated rows give repeated results, null ids stay null, other columns are ignored.
    Texts longer than ``chunk`` characters are counted chunk by chunk.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tok = remembered(WordCounts, path), tokenizer(path)
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(count_resynchronised(tok, text, chunk, overlap) if len(text) > chunk else words.text(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], schema.fieldNames())

    return docs.select(id_col, text_col).mapInArrow(count, schema)
