"""Exact nearest neighbours by a block matrix join with int8 tiles.

Vectors are dealt into blocks; each query block meets each candidate block in one
tile. A tile multiplies int8 codes, brackets every inner product by its quantisation
error, recomputes in double precision the pairs that may be among the nearest, and
keeps a heap per query. The tiles' heaps are merged per query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 2048, 16_384, 2048
PAIRS = 1 << 18
RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _quantised(x: np.ndarray):
    """Codes (int8 values), scale, norm of the vector, of its code vector and of the error."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x, axis=1), np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _once(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors; rows equal in both count once (they always meet in one block)."""
    ids, x = rows.column("id").to_numpy(), _matrix(rows.column("v"))
    if len(np.unique(ids)) < len(ids):
        _, at = np.unique(np.column_stack([ids.astype(np.float64), x]), axis=0, return_index=True)
        ids, x = ids[np.sort(at)], x[np.sort(at)]
    return ids, x


def nearest_in_tile(q_ids, q, c_ids, c, k: int, strip: int = STRIP) -> list[list[tuple[float, int]]]:
    """Per query a heap of its ``k`` best candidates as (score, -id), exact, ties to smaller ids."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    qq = _quantised(q)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds the whole-number products of codes exactly
    q_codes = qq[0].astype(exact)
    floor = np.full(len(q_ids), -np.inf)
    for at in range(0, len(c_ids), strip):
        ids, rows = c_ids[at:at + strip], c[at:at + strip]
        codes, scale, norm, coded, error = _quantised(rows)
        near = (q_codes @ codes.astype(exact).T).astype(np.float64) * qq[1][:, None] * scale
        slack = qq[4][:, None] * norm + qq[3][:, None] * error + 1e-12 * qq[2][:, None] * norm
        own = q_ids[:, None] == ids
        low = np.where(own, -np.inf, near - slack)
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        left, right = np.nonzero((near + slack >= floor[:, None]) & ~own)
        for part in range(0, len(left), PAIRS):
            i, j = left[part:part + PAIRS], right[part:part + PAIRS]
            score = inner_products(q[i], rows[j])
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], ids[j][order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            for a, b, s in zip(i[rank < k].tolist(), j[rank < k].tolist(), score[rank < k].tolist()):
                if len(heaps[a]) < k:
                    heapq.heappush(heaps[a], (s, -b))
                else:
                    heapq.heappushpop(heaps[a], (s, -b))
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def _valid(vector: Column) -> Column:
    v = F.col(vector)
    return (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` candidates of largest inner product per query.

    Candidates are all rows but those with the query's id; ties go to smaller ids.
    Rows with a null id, and vectors that are null, zero or hold null or non-finite
    components, take no part; vectors of different length never meet. Rows with the
    same id and vector count once. Blocks are dealt by id, so equal vectors spread over
    blocks; tiles work in strips, so memory does not grow with the table.
    """
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("query"))
            .where(F.col("id").isNotNull() & _valid("v")).withColumn("dim", F.size("v")))
    n, n_query = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0))).first()
    c_blocks, q_blocks = -(-n // candidate_block) or 1, -(-n_query // query_block) or 1
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    queries = rows.where("query").select("id", "v", "dim", own(q_blocks).alias("qb"), each(c_blocks).alias("cb"))
    candidates = rows.select("id", "v", "dim", own(c_blocks).alias("cb"), each(q_blocks).alias("qb"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return RESULT.empty_table()
        (q_ids, q), (c_ids, c) = _once(left), _once(right)
        heaps = nearest_in_tile(q_ids, q, c_ids, c, k)
        found = [(int(a), -b, s) for a, h in zip(q_ids, heaps) for s, b in h]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found), RESULT.types)], RESULT) if found else RESULT.empty_table()

    tiles = (queries.groupBy("dim", "qb", "cb").cogroup(candidates.groupBy("dim", "qb", "cb"))
             .applyInArrow(tile, "query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (tiles.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
