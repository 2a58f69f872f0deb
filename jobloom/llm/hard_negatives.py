"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label; a negative suits a positive when its score lies in a
window below the positive's score. The upper ends of an anchor's windows split all scores into disjoint slots.
Tiles (anchor block, candidate block) compute integer inner products and combine: each keeps the k best of every
slot. A window merges the tiles' slots, and merging an anchor's slots from the lowest to the highest gives the k best
below every upper end; what lies under a window's lower end is cut off at last, since it can only stand at the end.
So each score is looked at once, however many windows overlap.

Vectors are compared as integers: each component x becomes floor(scale * x). Rows without id or label, with a null
vector or one that holds null or non-finite components take no part. Only vectors of one length are compared. Rows
equal in id, label and vector count once; a row never meets its own id. Ties go to the smaller id. Windows of
negative positives are empty. An anchor without positives, or a window without rows, gives no rows; an empty table
gives none. Other columns are ignored, whatever their names. A score beyond 64 bits raises an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.common import stored

POSITIVES = "akey long, anchor_id long, vec_id long, score long"
SLOTS = "akey long, slot int, vec_id long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
STEP = 4096


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b: in float64 where it is exact, else in integers."""
    most = max(1, a.shape[1]) * int(max(abs(int(a.min(initial=0))), int(a.max(initial=0)))) * int(max(abs(int(b.min(initial=0))), int(b.max(initial=0))))
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if any(abs(x) >= 1 << 63 for x in exact.ravel()):
        raise OverflowError("an inner product passes 64 bits")
    return exact.astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, best first."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _blocks(ids: np.ndarray, matrix: np.ndarray, others: np.ndarray):
    for at in range(0, len(ids), STEP):
        yield at, products(others, matrix[at : at + STEP])


def best_positives(a_ids, anchors, c_ids, candidates, k: int):
    """(anchor's place, candidate's id, score): the tile's k best candidates of each anchor."""
    best: list[list[tuple[int, int]]] = [[] for _ in a_ids]
    for at, scores in _blocks(c_ids, candidates, anchors):
        ids = c_ids[at : at + STEP]
        for i, own in enumerate(a_ids):
            other = np.flatnonzero(ids != own)
            got = other[first(scores[i, other], ids[other], k)]
            best[i] = sorted([*best[i], *((-s, c) for s, c in zip(scores[i, got].tolist(), ids[got].tolist(), strict=True))])[:k]
    return [(i, c, -s) for i, top in enumerate(best) for s, c in top]


def best_per_slot(a_ids, a_labels, limits, floors, anchors, c_ids, c_labels, candidates, k: int):
    """(anchor's place, slot, candidate's id, score): the tile's k best candidates of another label in each slot.
    Slot j holds scores above limits[j + 1] and up to limits[j]; floors are the lowest scores that any window takes."""
    best: list[dict[int, list[tuple[int, int]]]] = [{} for _ in a_ids]
    for at, scores in _blocks(c_ids, candidates, anchors):
        ids, labels = c_ids[at : at + STEP], c_labels[at : at + STEP]
        for i, own in enumerate(a_ids):
            upper = limits[i]
            fits = np.flatnonzero((scores[i] <= upper[0]) & (scores[i] >= floors[i]) & (labels != a_labels[i]) & (ids != own))
            if not len(fits):
                continue
            found, names = scores[i, fits], ids[fits]
            slot = len(upper) - 1 - np.searchsorted(upper[::-1], found, "left")
            for j in np.unique(slot).tolist():
                mine = np.flatnonzero(slot == j)
                got = mine[first(found[mine], names[mine], k)]
                best[i][j] = sorted([*best[i].get(j, []), *((-s, c) for s, c in zip(found[got].tolist(), names[got].tolist(), strict=True))])[:k]
    return [(i, j, c, -s) for i, slots in enumerate(best) for j, top in slots.items() for s, c in top]


def upper_limits(positive_scores: list[int], high: int) -> list[int]:
    """The largest scores that the windows of an anchor's positives take, highest first: 100 s <= high p."""
    return sorted((high * p // 100 for p in positive_scores), reverse=True)


def merged(slots: dict[int, list[tuple[int, int]]], positives: list[tuple[int, int]], k: int, low: int, high: int):
    """Rows (positive id, rank, negative id, positive's score, negative's score) of one anchor. slots: (-score, id),
    sorted; positives: (score, id), best first, so that their limits come in the slots' order."""
    rows, below = [], []
    for j in reversed(range(len(positives))):
        below = list(heapq.merge(slots.get(j, []), below))[:k]
        score, positive = positives[j]
        fits = [(c, -s) for s, c in below if low * score <= -100 * s <= high * score]
        rows += [(positive, r + 1, c, score, s) for r, (c, s) in enumerate(fits)]
    return rows


def mine(spark: SparkSession, vectors: DataFrame, is_anchor, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, anchor_block: int = 1024, candidate_block: int = 32768) -> DataFrame:
    """The first k rows of another label in the window low % to high % of each of the n_positives best positives of
    each row of vectors (vec_id, embedding, label) for which the column is_anchor holds."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("is_anchor"))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    usable = usable.withColumn("v", F.transform("embedding", lambda x: F.floor(x * float(scale)).cast("long"))).withColumn("akey", F.xxhash64("vec_id", "label", "embedding"))
    usable = usable.dropDuplicates(["vec_id", "label", "embedding"]).select("vec_id", "label", "v", "akey", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), F.size("embedding").alias("dim"))
    usable = stored(spark, usable, "vectors")
    size = usable.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("q")).first()
    n_c = max(1, -(-size["n"] // candidate_block), min(24, size["n"] // 1024))
    n_a = max(1, -(-size["q"] // anchor_block))
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("akey", F.lit("block")), F.lit(n)).cast("int")
    anchors = usable.where("is_anchor").drop("is_anchor").withColumn("ab", block(n_a)).withColumn("cb", over(n_c))
    renewed = [F.col(c).alias(c) for c in usable.columns if c != "is_anchor"]  # columns of their own, so that both sides of a tile can be told apart
    candidates = usable.select(renewed).withColumn("cb", block(n_c)).withColumn("ab", over(n_a))

    def ids_and_matrix(t: pa.Table):
        return t.column("vec_id").to_numpy(), _matrix(t.column("v"), t.column("dim")[0].as_py())

    def positives_of_tile(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            rows = best_positives(*ids_and_matrix(left), *ids_and_matrix(right), n_positives)
        keys, ids = left.column("akey").to_pylist(), left.column("vec_id").to_pylist()
        return pa.table([pa.array(x, pa.int64()) for x in ([keys[r[0]] for r in rows], [ids[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows])], ["akey", "anchor_id", "vec_id", "score"])

    def slots_of_tile(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            a_ids, a = ids_and_matrix(left)
            c_ids, c = ids_and_matrix(right)
            own = [sorted(x, reverse=True) for x in left.column("scores").to_pylist()]
            limits = [np.array(upper_limits(x, high), np.int64) for x in own]
            floors = [min(-(-low * p // 100) for p in x) for x in own]
            rows = best_per_slot(a_ids, left.column("label").to_numpy(), limits, floors, a, c_ids, right.column("label").to_numpy(), c, k)
        keys = left.column("akey").to_pylist()
        return pa.table([pa.array([keys[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["akey", "slot", "vec_id", "score"])

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        own = sorted(((r["score"], r["vec_id"]) for r in left.to_pylist()), key=lambda x: (-x[0], x[1]))
        slots: dict[int, list[tuple[int, int]]] = {}
        for r in right.to_pylist():
            slots.setdefault(r["slot"], []).append((-r["score"], r["vec_id"]))
        rows = merged({j: sorted(x) for j, x in slots.items()}, own, k, low, high)
        anchor = left.column("anchor_id")[0].as_py() if left.num_rows else None
        columns = [[anchor] * len(rows), *([r[i] for r in rows] for i in range(5))]
        return pa.table([pa.array(x, pa.int32() if i == 2 else pa.int64()) for i, x in enumerate(columns)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    def best(df: DataFrame, n: int, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")

    key = ["dim", "ab", "cb"]
    found = anchors.groupBy("label", *key).cogroup(candidates.groupBy("label", *key)).applyInArrow(positives_of_tile, POSITIVES)
    positives = stored(spark, best(found, n_positives, "akey"), "positives")
    limited = anchors.join(positives.groupBy("akey").agg(F.collect_list("score").alias("scores")), "akey")
    slots = best(limited.groupBy(key).cogroup(candidates.groupBy(key)).applyInArrow(slots_of_tile, SLOTS), k, "akey", "slot")
    return positives.groupBy("akey").cogroup(slots.groupBy("akey")).applyInArrow(merge, MINED)
