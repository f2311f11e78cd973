"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are dealt into candidate groups and query groups; each pair of groups is a tile that one task works
on, so no task holds more than one tile.  In a tile the vectors are rounded to int8 and multiplied as a
matrix, which gives every distance up to a known rounding error.  Candidates whose lower bound lies above
the k-th smallest upper bound cannot be among the k nearest; the others are recomputed from the original
vectors in double precision and merged through a heap of k.  The best k of the tiles are merged by rank.
The result is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of other lengths than the query's are no candidates; ties go to the smaller id; candidates that
share the query's id are left out; rows repeated with one id are candidates each, and as queries the
smallest of them counts; a query without candidates gives no row; an empty table gives an empty table.
Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks]
    data = np.concatenate(flat) if flat else np.zeros(0)
    return ids, data.astype(np.float64).reshape(len(ids), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the distance of each rounded row from the original."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # below the smallest double that can be divided
    rounded = np.rint(x / scale[:, None])
    error = np.sqrt(((x - rounded * scale[:, None]) ** 2).sum(axis=1))
    return rounded.astype(np.int8), scale, error


def tile_nearest(query_ids, queries, ids, vectors, k: int, rows: int = 256, columns: int = 4096) -> Iterator[tuple[int, int, float]]:
    """The k nearest of a tile for each query, as query id, id, distance; ``rows`` and ``columns`` bound what is held at once."""
    qi, qs, qe = quantise(queries)
    vi, vs, ve = quantise(vectors)
    v_norm = ((vi.astype(np.float64) * vs[:, None]) ** 2).sum(axis=1)
    q_norm = ((qi.astype(np.float64) * qs[:, None]) ** 2).sum(axis=1)
    for a in range(0, len(queries), rows):
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(min(rows, len(queries) - a))]
        for b in range(0, len(vectors), columns):
            part = slice(b, b + columns)
            # products of int8 rows are whole numbers that float32 holds exactly up to 1040 components, float64 beyond
            kind = np.float32 if queries.shape[1] <= 1040 else np.float64
            product = (qi[a:a + rows].astype(kind) @ vi[part].astype(kind).T).astype(np.float64)
            square = q_norm[a:a + rows, None] + v_norm[None, part] - 2 * product * qs[a:a + rows, None] * vs[None, part]
            near = np.sqrt(np.maximum(square, 0))
            slack = (qe[a:a + rows, None] + ve[None, part]) + 1e-6 * (near + np.sqrt(q_norm[a:a + rows, None]) + np.sqrt(v_norm[None, part])) + 1e-300
            own = query_ids[a:a + rows, None] == ids[None, part]
            upper = np.where(own | np.isnan(near + slack), np.inf, near + slack)  # squares may be beyond a double; those pairs are compared exactly
            width = upper.shape[1]
            limit = np.partition(upper, min(k, width) - 1, axis=1)[:, min(k, width) - 1]
            for r, heap in enumerate(heaps):
                bound = min(limit[r], -heap[0][0]) if len(heap) == k else limit[r] if width >= k else np.inf
                alive = np.flatnonzero(~own[r] & ~(near[r] - slack[r] > bound))
                exact = np.sqrt(((vectors[b + alive] - queries[a + r]) ** 2).sum(axis=1))
                for d, i in zip(exact.tolist(), ids[b + alive].tolist(), strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -i))
                    elif (-d, -i) > heap[0]:
                        heapq.heapreplace(heap, (-d, -i))
        for r, heap in enumerate(heaps):
            for d, i in heap:
                yield query_ids[a + r], -i, -d


def nearest(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            group_rows: int = 4096, group_queries: int = 4096) -> DataFrame:
    """query_id, rank (from 1), ``key`` and score (Euclidean distance) of the k nearest rows of each query row."""
    rows = df.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    rows = rows.withColumn("size", F.size("vector"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    parts, blocks = max(1, math.ceil(n / group_rows)), max(1, math.ceil(asked / group_queries))
    spread = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("size", spread(1, parts).alias("part"), every(blocks).alias("block"), "id", "vector")
    queries = rows.where("asks").groupBy("size", "id").agg(F.min("vector").alias("vector"))
    queries = queries.select("size", every(parts).alias("part"), spread(2, blocks).alias("block"), "id", "vector")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = list(tile_nearest(*_matrix(left), *_matrix(right), k))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    tiles = queries.groupBy("size", "part", "block").cogroup(candidates.groupBy("size", "part", "block")).applyInArrow(
        tile, "query_id bigint, id bigint, score double")
    ranked = tiles.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
