"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed letter n-grams. Each language gets a
few centroids by spherical k-means on a bounded sample of labelled rows. A text takes
the language of the centroid with the largest cosine and is rejected where it lies
further from that centroid than almost all texts the centroid was made of (short texts
are not rejected for their distance).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.llm.common import stage
from gaugeworks.llm.links import small_keys
from gaugeworks.llm.tokens import forget, give_back

DIMENSIONS = 8192
SAMPLE_PER_LANGUAGE = 1500
"""Bound of the labelled rows that a language's centroids are fitted on (chosen by a hash of the id)."""
SLACK = 4
"""How many times the sample is sorted to choose it; fewer than a sample among so many has odds below 1e-300."""
CENTROIDS = 3
ROUNDS = 10
TAIL, EASE = 0.002, 0.6
"""A text is rejected below EASE times the TAIL quantile of the similarities of its centroid's own texts."""
ENOUGH = 60
"""Letter n-grams from which on a text can be rejected; the cosine of shorter ones says little."""
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def ngram_counts(text: str | None, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letter bi- and trigrams of the whole text; empty where it has no letter.

    What is no letter counts as a word edge; runs of edges are one.
    """
    empty = np.zeros(0, np.int64), np.zeros(0)
    if not text:
        return empty
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return empty
    keep = letter | np.concatenate([[False], letter[:-1]])
    c = np.concatenate([[0], np.where(letter, points, 0)[keep], [0]]).astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]
    three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[2:] + np.uint64(1)
    grams = np.concatenate([two, three])
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    counts = np.bincount((grams % np.uint64(dimensions)).astype(np.int64), minlength=dimensions)
    at = np.nonzero(counts)[0]
    return at, counts[at]


def _vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    """One row per centroid, unit length."""
    owner: np.ndarray
    least: np.ndarray
    """Smallest accepted cosine per centroid."""

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, rejected."""
        at, counts = ngram_counts(text, len(self.idf))
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0, True
        near = self.centroids[:, at] @ _vector(at, counts, self.idf)
        best = int(near.argmax())
        return self.langs[self.owner[best]], float(min(max(near[best], 0.0), 1.0)), bool(near[best] < self.least[best] and counts.sum() >= ENOUGH)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's cosine to its own; starts from rows far from each other."""
    seeds = [int((x @ x.sum(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centers = x[seeds]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else centers[i] for i in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ centers.T
    return centers, np.stack([near.argmax(axis=1), near.max(axis=1)], axis=1)


def _smallest_hashes(ids: DataFrame, most: int) -> DataFrame:
    """``lang, id`` of the ``most`` rows of each language whose ids have the smallest hashes.

    Hashes are uniform, so rows far above the place sought are left out where they are
    read; only about ``SLACK`` times the sample is sorted, whatever the size of a language.
    """
    share = ids.groupBy("lang").agg((F.lit(float(SLACK * most)) / F.count("*")).alias("share"))
    hashed = ids.withColumn("h", F.xxhash64("id")).join(small_keys(stage(share, "shares")), "lang")
    low = hashed.where(F.col("h") / F.lit(float(1 << 64)) + 0.5 <= F.col("share"))
    by_hash = Window.partitionBy("lang").orderBy("h", "id")
    return low.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= most).select("lang", "id").distinct()


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS,
        dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Centroids from at most ``per_language`` labelled rows per language, whole texts.

    Rows without language, and texts without a letter, teach nothing. Each language's
    k-means runs in a task on its bounded sample; the driver gets the centroids and the
    document frequencies of the sample.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = _smallest_hashes(known.select("lang", "id"), per_language)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [ngram_counts(t.as_py(), dimensions) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                 pa.array([c.astype(np.float64) for _, c in found], pa.list_(pa.float64()))], ["lang", "at", "counts"])
        give_back()

    rows = known.join(small_keys(stage(chosen, "chosen")), ["lang", "id"], "left_semi").select("lang", "text")
    sample = stage(rows.mapInArrow(vectors, "lang string, at array<int>, counts array<double>").where("size(at) > 0"), "sample")
    n = sample.count()
    seen = np.zeros(dimensions)
    for row in sample.select(F.explode("at").alias("d")).groupBy("d").count().collect():
        seen[row["d"]] = row["count"]
    idf = np.log((1.0 + n) / (1.0 + seen)) + 1.0

    def cluster(group: pa.Table) -> pa.Table:
        forget()
        x = np.zeros((group.num_rows, dimensions), np.float32)
        for i, (at, counts) in enumerate(zip(group.column("at"), group.column("counts"))):
            at = np.asarray(at.as_py())
            x[i, at] = _vector(at, np.asarray(counts.as_py()), idf)
        centers, own = spherical_kmeans(x, centroids)
        least = [EASE * float(np.quantile(own[own[:, 0] == i, 1], TAIL)) if (own[:, 0] == i).any() else 0.0
                 for i in range(len(centers))]
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(centers), "least": least,
                         "center": [c.astype(np.float64) for c in centers]})

    found = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, least double, center array<double>").collect(),
                   key=lambda r: (r["lang"], r["center"]))
    langs = sorted({r["lang"] for r in found})
    return Model(langs, idf, np.array([r["center"] for r in found]).reshape(len(found), dimensions),
                 np.array([langs.index(r["lang"]) for r in found], int), np.array([r["least"] for r in found]))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A text that is null, empty or without a letter gets ``und``, 0 and is rejected. Only
    the text is looked at. Columns with these three names are rejected.
    """
    clash = [c for c in docs.columns if c in ("lang_pred", "score", "rejected")]
    if clash:
        raise ValueError(f"column names are taken: {clash}")
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
             T.StructField("rejected", T.BooleanType())]
    names, at = [*docs.columns, "lang_pred", "score", "rejected"], docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names)
        give_back()

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, *extra]))
