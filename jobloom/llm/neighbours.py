"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt to tiles (query block, candidate block). A tile's unit vectors are
quantised to int8 with a scale each; an integer product gives every cosine within a bound that follows
from the lengths of the rounding errors. Pairs whose upper bound reaches the k-th best lower bound of
their query are recomputed in double precision on the original vectors and merged by a heap per query;
a window then merges the tiles' k best. Every row takes part, so nothing is approximate in the end.

Vectors that are null, zero, or hold null or non-finite components take no part. Only vectors of one length
are compared. Rows equal in id and vector count once; a query never meets its own id. Ties go to the smaller
id. Null ids take no part. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_id long, vec_id long, score double"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed from the first component to the last, as a plain loop does."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, lengths of the rounding errors and of the quantised unit vectors."""
    big = np.abs(x).max(axis=1, keepdims=True)
    unit = x / big
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt((back**2).sum(axis=1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int8 matrices: float32 holds sums of 1024 products of int8 values exactly."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def search_tile(q_ids, queries, c_ids, candidates, k: int, step: int = 2048):
    """The k best (negative score, id) of each query, as heaps turned into lists."""
    q8, qs, qe, ql = _quantised(queries)
    q_norm = np.sqrt(_summed(queries, queries))
    best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    for at in range(0, len(c_ids), step):
        ids, own = c_ids[at : at + step], candidates[at : at + step]
        c8, cs, ce, _ = _quantised(own)
        near = _product(q8, c8) * qs[:, None] * cs[None, :]
        slack = ql[:, None] * ce[None, :] + qe[:, None] + 1e-12
        near[q_ids[:, None] == ids[None, :]] = -np.inf
        low = near - slack
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        i, j = np.nonzero((near + slack >= floor[:, None]) & (near > -np.inf))
        score = _summed(queries[i], own[j]) / (q_norm[i] * np.sqrt(_summed(own[j], own[j])))
        score = np.clip(score, -1.0, 1.0)
        for a, s, c in zip(i.tolist(), score.tolist(), ids[j].tolist(), strict=True):
            item = (s, -c)  # the heap's root is the worst that is kept
            if len(best[a]) < k:
                heapq.heappush(best[a], item)
            elif item > best[a][0]:
                heapq.heapreplace(best[a], item)
        floor = np.maximum(floor, [b[0][0] if len(b) == k else -np.inf for b in best])
    return best


def nearest(vectors: DataFrame, is_query, k: int = 5, query_block: int = 2048, candidate_block: int = 32768) -> DataFrame:
    """query_id, rank, vec_id and cosine of the k nearest rows of vectors (vec_id, embedding) to each row
    for which the column is_query holds."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    usable = usable.where(F.col("vec_id").isNotNull() & good).dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))
    counts = {r["dim"]: (r["n"], r["q"]) for r in usable.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}
    # Blocks by dimension: enough of them that none holds many rows.
    n_c = max([1, *(-(-n // candidate_block) for n, _ in counts.values())])
    n_c = max(n_c, min(24, max([1, *(n // 1024 for n, _ in counts.values())])))
    n_q = max([1, *(-(-q // query_block) for _, q in counts.values())])
    salt = F.xxhash64("vec_id", "embedding")
    queries = usable.where("is_query").withColumn("qb", F.pmod(salt, F.lit(n_q))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    candidates = usable.withColumn("cb", F.pmod(salt, F.lit(n_c))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    key = ["dim", "qb", "cb"]
    typed = [F.col("dim").cast("int").alias("dim"), F.col("qb").cast("int").alias("qb"), F.col("cb").cast("int").alias("cb"), "vec_id", "embedding"]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            q_ids = left.column("vec_id").to_numpy()
            best = search_tile(q_ids, _matrix(left.column("embedding"), dim), right.column("vec_id").to_numpy(), _matrix(right.column("embedding"), dim), k)
            found = [(q, -c, s) for q, heap in zip(q_ids.tolist(), best, strict=True) for s, c in heap]
        return pa.table({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())})

    near = queries.select(typed).groupBy(key).cogroup(candidates.select(typed).groupBy(key)).applyInArrow(tile, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
