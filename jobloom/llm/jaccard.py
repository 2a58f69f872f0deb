"""Near-duplicate groups by an exact n-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct 5-word shingles. Two documents link when the intersection
of their sets has at least 75 % of the size of the union. The result is each document's component.

1. Counting filter. If A links to any B, the shingles first in hash order of A and of B share a known number
   (prefix filter extended by `n // 8` shingles). Those prefixes are dealt by hash in packed columns of 32-bit
   remainders, and each document counts how many of its own occur twice anywhere. Too few: it links to none.
2. What is left, one document for each set, is small wherever most texts are new. Its shingles are counted
   again, all of them; in the order of rising frequency a linked pair must share one of the first few
   shingles, and those that are frequent in the corpus (passages, boilerplate) come last. Documents that share
   such a shingle are joined to candidate components.
3. In a candidate component a signature tree holds OR-combined bitmaps and size ranges; a dual traversal
   prunes node pairs by their maximum possible overlap, and surviving pairs are verified on whole sets. Pairs
   already known to be connected are skipped.
4. A candidate component of more than `most` documents or MOST_BYTES is cut into chunks by hash. Chunks are linked
   inside, then their classes' representatives among each other. Then the component is cut into chunks of neighbouring
   sizes, and those meet in which something that is not yet in its largest class shares one of the first shingles with
   something of fitting size; each text goes once to each chunk that its own meets. So no task holds such a component
   and no link is lost.

Shingles are compared by 64-bit hashes (32 bits and the bucket only in the filters, where equality by
accident makes a candidate more), equal sets are found by 128-bit hashes and then numbered. Null and wordless texts
have size 0 and are alone; with fewer than five words the whole sequence is the only shingle. Very long texts are
taken whole. Repeated rows are in one component. A null doc_id never is the smallest unless there is no other. An
empty table gives no rows. Extra columns are ignored by near_duplicates and kept by keep_first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import SPACED, arrow_batches, free_name, keyed, mix, row_key, stored, word_hashes, words
from jobloom.llm.graphs import components

WIDTH = 5
MOST, MOST_BYTES = 4000, 64 << 20
_SALTS = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    data, start, end, at = words(data, offsets, SPACED)
    h = word_hashes(data, start, end)
    n = max(len(h) - width + 1, 0)
    joined = np.zeros(n, np.uint64)
    for k in range(width):
        joined += h[k : k + n] * _SALTS[k]
    joined = mix(joined)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            out.append(mix((h[a:b] * _SALTS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(joined[:0])
    return out


def least_overlap(n):
    """Of a set of n with any set it links to: three quarters of n, rounded up."""
    return -(-3 * n // 4)


def extension(n):
    return max(1, n // 8)


def prefix_length(n: int) -> int:
    return min(n, n - least_overlap(n) + extension(n)) if n else 0


def least_shared(n: int) -> int:
    """A partner has three quarters of n shingles at least, and its prefix is extended accordingly."""
    return min(extension(least_overlap(n)), least_overlap(n))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 4 * len(small) < 3 * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


class Tree:
    """Documents in order of size, their bitmaps, and levels of nodes over them."""

    LEAF, FAN = 16, 8

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort(([int(s[0]) for s in sets], size))
        self.sets = [sets[i] for i in self.order]
        self.size = size[self.order]
        bits = 1 << int(min(16, max(9, int(2 * size.mean()).bit_length())))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(maps, self.sets, strict=True):
            place = s & np.uint64(bits - 1)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.bits, self.maps = bits, maps
        self.lost = self.size - np.bitwise_count(maps).sum(axis=1)  # shingles on a bit that another has
        self.levels = []
        step, maps_, low, high, lost = self.LEAF, maps, self.size, self.size, self.lost
        by = self.LEAF
        while True:
            cut = np.arange(0, len(maps_), by)
            maps_ = np.bitwise_or.reduceat(maps_, cut)
            low, high, lost = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)
            self.levels.append((step, maps_, low, high, lost))
            if len(cut) == 1:
                break
            step, by = step * self.FAN, self.FAN


class Classes:
    """Labels that shrink as links are found: the smallest of a class."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, a, b) -> None:
        low, high = min(a, b), max(a, b)
        self.label[self.label == high] = low


def _fold(tree: Tree, bits: int) -> np.ndarray:
    """Bitmaps with fewer bits: a shingle's place in the smaller map is its place's low bits."""
    maps = tree.maps
    while maps.shape[1] * 64 > bits:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def link(x: Tree, y: Tree, label_x: np.ndarray, label_y: np.ndarray, found: Classes) -> None:
    """Dual traversal. label_x and label_y number the classes of the documents in tree order; found maps
    them to the classes as far as known and is updated."""
    same_tree = x is y
    need = lambda a, b: -(-3 * (a + b) // 7)  # noqa: E731  with 75 %: both >= 3/7 of the sizes' sum
    comparable = x.bits == y.bits
    if not comparable:
        bits = min(x.bits, y.bits)
        leaf_x, leaf_y = _fold(x, bits), _fold(y, bits)
        lost_x, lost_y = x.size - np.bitwise_count(leaf_x).sum(axis=1), y.size - np.bitwise_count(leaf_y).sum(axis=1)
    else:
        leaf_x, leaf_y, lost_x, lost_y = x.maps, y.maps, x.lost, y.lost

    def settled(a0, a1, b0, b1) -> bool:
        one = found.label[label_x[a0]]
        return bool((found.label[label_x[a0:a1]] == one).all() and (found.label[label_y[b0:b1]] == one).all())

    def leaves(a0, a1, b0, b1) -> None:
        sa, sb = x.size[a0:a1, None], y.size[None, b0:b1]
        over = np.bitwise_count(leaf_x[a0:a1, None, :] & leaf_y[None, b0:b1, :]).sum(axis=2, dtype=np.int64) + np.minimum(lost_x[a0:a1, None], lost_y[None, b0:b1])
        may = (over >= need(sa, sb)) & (4 * np.minimum(sa, sb) >= 3 * np.maximum(sa, sb))
        if same_tree and a0 == b0:
            may = np.triu(may, 1)
        for i, j in zip(*np.nonzero(may), strict=True):
            p, q = found.label[label_x[a0 + i]], found.label[label_y[b0 + j]]
            if p != q and linked(x.sets[a0 + i], y.sets[b0 + j]):
                found.join(p, q)

    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        u, i, v, j = stack.pop()
        step_x, maps_x, low_x, high_x, most_x = x.levels[u]
        step_y, maps_y, low_y, high_y, most_y = y.levels[v]
        a0, b0 = i * step_x, j * step_y
        a1, b1 = min(a0 + step_x, len(x.size)), min(b0 + step_y, len(y.size))
        if 4 * high_x[i] < 3 * low_y[j] or 4 * high_y[j] < 3 * low_x[i] or settled(a0, a1, b0, b1):
            continue
        if comparable and not (same_tree and u == v and i == j):
            over = int(np.bitwise_count(maps_x[i] & maps_y[j]).sum()) + int(min(most_x[i], most_y[j]))
            if over < need(int(low_x[i]), int(low_y[j])):
                continue
        if u == 0 and v == 0:
            leaves(a0, a1, b0, b1)
            continue
        fan = Tree.FAN
        kids_x = [(u, i)] if u == 0 or v > u else [(u - 1, k) for k in range(i * fan, min(i * fan + fan, len(x.levels[u - 1][1])))]
        kids_y = [(v, j)] if v == 0 or u > v else [(v - 1, k) for k in range(j * fan, min(j * fan + fan, len(y.levels[v - 1][1])))]
        pairs = [(*p, *q) for p in kids_x for q in kids_y if not same_tree or p[0] != q[0] or p[1] <= q[1]]
        # A node with itself comes first, since it settles most of what is near.
        stack += sorted(pairs, key=lambda t: t[1] == t[3])


def classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of its class's first member in the tree's order, as any number of the class."""
    tree = Tree(sets)
    labels = np.arange(len(sets))
    found = Classes(labels)
    link(tree, tree, labels, labels, found)
    out = np.empty(len(sets), np.int64)
    out[tree.order] = tree.order[found.label]
    return out


# ---- the filters ------------------------------------------------------------------------------------

_PACKED = "batch long, bucket int, hashes binary, counts binary"


def _deal(sets: list[np.ndarray], buckets: int):
    """Sets cut by bucket: (bucket, 32-bit remainders document by document, their numbers by document)."""
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bucket = ((every >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    doc = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    short = every.astype(np.uint32)
    for k in range(buckets):
        own = order[at[k] : at[k + 1]]
        if len(own):
            yield k, short[own], np.bincount(doc[own], minlength=len(sets)).astype(np.uint32)


def _number(part: int, k: int) -> int:
    return (part << 24) | k


def signatures(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of documents (bucket -1: batch, place, rk, doc_id, n, same and more: hashes of the set) and packed
    prefixes. In a batch each set's prefix is dealt once."""

    def task(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            sets = [s for _, _, data, offsets in arrow_batches(b, "text") for s in shingle_sets(data, offsets)]
            number, k = _number(part, k), k + 1
            n = np.array([len(s) for s in sets], np.int64)
            same, more = (mix(np.array([x(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64) + n.astype(np.uint64)).view(np.int64) for x in (lambda s: s * (s >> np.uint64(29) | np.uint64(1)), lambda s: mix(s ^ _SALTS[6])))
            yield _rows(number, -1, pa.array(np.arange(len(sets)), pa.int32()), b.column("rk"), b.column("doc_id"), pa.array(n), pa.array(same), pa.array(more), None, None)
            _, once = np.unique(same, return_index=True)
            firsts = np.zeros(len(sets), bool)
            firsts[once] = True
            dealt = [s[: prefix_length(len(s))] if f else s[:0] for s, f in zip(sets, firsts, strict=True)]
            for bucket, hashes, counts in _deal(dealt, buckets):
                yield _rows(number, bucket, None, None, None, None, None, None, hashes, counts)

    return docs.select("doc_id", "rk", "text").mapInArrow(task, _ROWS)


_ROWS = "batch long, bucket int, place int, rk long, doc_id long, n long, same long, more long, hashes binary, counts binary"
_NAMES = ["batch", "bucket", "place", "rk", "doc_id", "n", "same", "more", "hashes", "counts"]


def _rows(batch, bucket, place, rk, doc_id, n, same, more, hashes, counts) -> pa.RecordBatch:
    rows = 1 if place is None else len(place)
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    given = [pa.array(np.full(rows, batch)), pa.array(np.full(rows, bucket), pa.int32()), place, rk, doc_id, n, same, more, *[None if x is None else pa.array([x.tobytes()], pa.binary()) for x in (hashes, counts)]]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if g is None else g for g, t in zip(given, types, strict=True)], _NAMES)


def _by_bucket(batches):
    """All rows of one bucket at a time: (bucket, batches, hashes, counts)."""
    held, last = [], None
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("bucket", "batch", "hashes", "counts")], strict=True):
            if last is not None and row[0] != last:
                yield last, held
                held = []
            last = row[0]
            held.append(row[1:])
    if held:
        yield last, held


def _frequency(parts: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
    count = np.diff(np.append(edge, len(every)))
    out = np.empty(len(every), np.int64)
    out[order] = np.repeat(count, count)
    return out


def shared_counts(packed: DataFrame, partitions: int) -> DataFrame:
    """batch, place and how many of the document's dealt shingles occur in another set. A bucket's counts go
    back packed, one row for each batch."""

    def count(batches):
        for _, held in _by_bucket(batches):
            twice = _frequency([np.frombuffer(h, np.uint32) for _, h, _ in held]) > 1
            at = 0
            for batch, _, counts in held:
                counts = np.frombuffer(counts, np.uint32).astype(np.int64)
                edge = at + np.concatenate(([0], np.cumsum(counts)))
                sums = np.concatenate(([0], np.cumsum(twice[at : edge[-1]])))
                shared = sums[edge[1:] - at] - sums[edge[:-1] - at]
                place = np.flatnonzero(shared)
                at = int(edge[-1])
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([place.astype(np.uint32).tobytes()], pa.binary()), pa.array([shared[place].astype(np.uint32).tobytes()], pa.binary())], ["batch", "places", "shared"])

    def add(batches):
        def row(batch, total):
            place = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), batch)), pa.array(place, pa.int32()), pa.array(total[place])], ["batch", "place", "shared"])

        last, total = None, np.zeros(0, np.int64)
        for b in batches:
            for batch, places, shared in zip(*[b.column(c).to_pylist() for c in ("batch", "places", "shared")], strict=True):
                if batch != last:
                    if last is not None:
                        yield row(last, total)
                    last, total = batch, np.zeros(0, np.int64)
                place = np.frombuffer(places, np.uint32)
                if place[-1] >= len(total):
                    total = np.pad(total, (0, int(place[-1]) + 1 - len(total)))
                total[place] += np.frombuffer(shared, np.uint32)
        if last is not None:
            yield row(last, total)

    counted = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "batch long, places binary, shared binary")
    return counted.repartition(partitions, "batch").sortWithinPartitions("batch").mapInArrow(add, "batch long, place int, shared long")


def rare_shingles(docs: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """rk and token: the first shingles, in the order of rising frequency, that a linked pair must share."""

    def deal(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            sets = [s for _, _, data, offsets in arrow_batches(b, "text") for s in shingle_sets(data, offsets)]
            number, k = _number(part, k), k + 1
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([b.column("rk").to_numpy().tobytes()], pa.binary()), pa.array([np.array([len(s) for s in sets], np.uint32).tobytes()], pa.binary())], ["batch", "bucket", "hashes", "counts"])
            for bucket, hashes, counts in _deal(sets, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([bucket], pa.int32()), pa.array([hashes.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["batch", "bucket", "hashes", "counts"])

    def count(batches):
        for bucket, held in _by_bucket(batches):
            if bucket >= 0:
                often = np.minimum(_frequency([np.frombuffer(h, np.uint32) for _, h, _ in held]), 1 << 30).astype(np.uint32)
            at = 0
            for batch, hashes, counts in held:
                n = len(hashes) // 4
                frequency = b"" if bucket < 0 else often[at : at + n].tobytes()
                at += n
                yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([bucket], pa.int32()), pa.array([hashes], pa.binary()), pa.array([counts], pa.binary()), pa.array([frequency], pa.binary())], ["batch", "bucket", "hashes", "counts", "often"])

    def choose(batches):
        def first(held):
            rk = n = None
            doc, token, often = [], [], []
            for bucket, hashes, counts, frequency in held:
                if bucket < 0:
                    rk, n = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)
                    continue
                f = np.frombuffer(frequency, np.uint32)
                use = f > 1
                c = np.frombuffer(counts, np.uint32).astype(np.int64)
                doc.append(np.repeat(np.arange(len(c)), c)[use])
                token.append((np.int64(bucket) << 32) | np.frombuffer(hashes, np.uint32)[use].astype(np.int64))
                often.append(f[use])
            if not doc:
                return
            doc, token, often = np.concatenate(doc), np.concatenate(token), np.concatenate(often)
            order = np.lexsort((token, often, doc))
            doc, token = doc[order], token[order]
            held_n = np.bincount(doc, minlength=len(n))
            begin = np.cumsum(held_n) - held_n
            length = np.maximum(held_n - least_overlap(n) + 1, 0)
            use = np.arange(len(doc)) - begin[doc] < length[doc]
            yield pa.RecordBatch.from_arrays([pa.array(rk[doc[use]]), pa.array(token[use])], ["rk", "token"])

        held, last = [], None
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("batch", "bucket", "hashes", "counts", "often")], strict=True):
                if last is not None and row[0] != last:
                    yield from first(held)
                    held = []
                last = row[0]
                held.append(row[1:])
        yield from first(held)

    dealt = docs.select("rk", "text").mapInArrow(deal, _PACKED)
    # Lists of keys go straight on, as buckets below 0; they are dealt by their batch.
    counted = dealt.repartition(partitions, F.when(F.col("bucket") < 0, F.col("batch")).otherwise(F.col("bucket").cast("long"))).sortWithinPartitions("bucket").mapInArrow(count, _PACKED + ", often binary")
    return counted.repartition(partitions, "batch").sortWithinPartitions("batch").mapInArrow(choose, "rk long, token long")


# ---- linking ----------------------------------------------------------------------------------------


def _sets_of(texts: pa.Array) -> list[np.ndarray]:
    return [s for _, _, data, offsets in arrow_batches(pa.RecordBatch.from_arrays([texts], ["text"]), "text") for s in shingle_sets(data, offsets)]


def _link_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """rk and class (smallest rk linked to inside the group) of rows (key, rk, text), group by group."""

    def task(batches):
        held: list[pa.RecordBatch] = []

        def solve():
            t = pa.Table.from_batches(held)
            rk = t.column("rk").to_numpy()
            sets = _sets_of(t.column("text").combine_chunks())
            label = classes_of(sets)
            least = np.full(len(rk), np.iinfo(np.int64).max)
            np.minimum.at(least, label, rk)
            return pa.RecordBatch.from_arrays([pa.array(rk), pa.array(least[label])], ["rk", "class"])

        last = None
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in key], strict=True))
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != last:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    start = i
                    if i < len(keys):
                        if held:
                            yield solve()
                        held, last = [], keys[i]
        if held:
            yield solve()

    return rows.select(*key, "rk", "text").repartition(*key).sortWithinPartitions(*key).mapInArrow(task, "rk long, class long")


def _cross_links(some: DataFrame, every: DataFrame, key: list[str]) -> DataFrame:
    """Links a, b between classes of some and of every, group by group of key."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        right = right.rename_columns([c.removeprefix("of_") for c in right.column_names])
        x, y = (Tree(_sets_of(t.column("text").combine_chunks())) for t in (left, right))
        names = [t.column("class").to_numpy() for t in (left, right)]
        known, number = np.unique(np.concatenate(names), return_inverse=True)
        lx, ly = number[: len(names[0])][x.order], number[len(names[0]) :][y.order]
        found = Classes(np.arange(len(known)))
        link(x, y, lx, ly, found)
        moved = np.flatnonzero(found.label != np.arange(len(known)))
        return pa.table({"a": pa.array(known[moved]), "b": pa.array(known[found.label[moved]])})

    columns = [*key, "class", "text"]
    other = every.select([F.col(c).alias(f"of_{c}") for c in columns])
    return some.select(columns).groupBy(key).cogroup(other.groupBy([f"of_{c}" for c in key])).applyInArrow(task, "a long, b long")


def _parts(m: str, size: str, most: int) -> Column:
    """How many chunks hold m documents of so many bytes: at most about `most` documents and MOST_BYTES each."""
    return F.ceil(F.greatest(F.col(m) / most, F.col(size) / MOST_BYTES)).cast("int")


def _meetings(spark: SparkSession, split: DataFrame, tokens: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides, as rows (component, z, part, z2, part2, class, text), of the chunk pairs in which documents that are
    not in their component's main class meet what they can link to, from split (component, rk, n, text, class, main).

    Linked documents share a token, and their sizes differ by a third of the smaller at most. So a component's
    documents are cut into chunks of neighbouring size (powers of 4/3), and two chunks of the same or of adjacent sizes
    meet once, however many tokens they share, if a token occurs in both, on one side in a document that is apart, and
    they aren't all of one class. Which chunks meet is found from tokens alone; then each text goes once to each
    chunk that its own meets."""
    sized = split.select("component", "rk", "class", (F.col("class") != F.col("main")).alias("apart"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int").alias("z"), F.octet_length("text").alias("size"))
    per_size = sized.groupBy("component", "z").agg(F.count("*").alias("m"), F.sum("size").alias("size")).select("component", "z", _parts("m", "size", most).alias("parts"))
    placed = stored(spark, sized.join(per_size, ["component", "z"]).withColumn("part", F.pmod(F.xxhash64("rk"), F.col("parts")).cast("int")).select("component", "rk", "class", "apart", "z", "part"), "jaccard-placed")
    held = tokens.join(placed, "rk").groupBy("token", "component", "z", "part").agg(F.max("apart").alias("apart"), F.min("class").alias("low"), F.max("class").alias("high"))
    held = stored(spark, held, "jaccard-held")
    other = held.select("token", "component", *(F.col(c).alias(f"{c}2") for c in ("z", "part", "apart", "low", "high")))
    fits = ((F.col("z2") == F.col("z")) & (F.col("part2") >= F.col("part"))) | (F.col("z2") == F.col("z") + 1)
    open_ = (F.col("apart") | F.col("apart2")) & ((F.col("low") != F.col("high2")) | (F.col("high") != F.col("low2")))
    met = stored(spark, held.join(other, ["token", "component"]).where(fits & open_).select("component", "z", "part", "z2", "part2").distinct(), "jaccard-met")
    texts = placed.join(split.select("rk", "text"), "rk").select("component", "z", "part", "class", "text")
    ours = texts.join(met, ["component", "z", "part"])
    theirs = texts.withColumnsRenamed({"z": "z2", "part": "part2"}).join(met, ["component", "z2", "part2"])
    return ours, theirs


def _classes(spark: SparkSession, docs: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """rk and class of rows (component, rk, n, text); tokens: rk and the tokens of which a linked pair shares one."""
    size = docs.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.octet_length("text")).alias("size")).select("component", _parts("m", "size", most).alias("parts"))
    sized = docs.join(size, "component").withColumn("chunk", F.pmod(F.xxhash64("rk"), F.col("parts")).cast("int"))
    first = stored(spark, _link_groups(sized, ["component", "chunk"]), "jaccard-chunks")
    large = size.where("parts > 1")
    if large.isEmpty():
        return first
    # Components of several chunks: their classes' representatives, then what that leaves apart.
    labelled = stored(spark, sized.where("parts > 1").drop("parts", "chunk").join(first, "rk"), "jaccard-large")
    heads = labelled.where(F.col("rk") == F.col("class")).select("component", "rk", "text")
    per_head = heads.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.octet_length("text")).alias("size")).select("component", _parts("m", "size", most).alias("parts"))
    heads = heads.join(per_head, "component").withColumn("chunk", F.pmod(F.xxhash64("rk"), F.col("parts")).cast("int"))
    second = _link_groups(heads, ["component", "chunk"]).select(F.col("rk").alias("class"), F.col("class").alias("joined"))
    labelled = stored(spark, labelled.join(second, "class").select("component", "rk", "n", "text", F.col("joined").alias("class")), "jaccard-joined")
    per_class = labelled.groupBy("component", "class").agg(F.count("*").alias("k"))
    main = per_class.groupBy("component").agg(F.max(F.struct("k", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("component", F.col("main.class").alias("main"))
    links = stored(spark, _cross_links(*_meetings(spark, labelled.join(main, "component"), tokens, most), ["component", "z", "part", "z2", "part2"]), "jaccard-cross")
    joined = labelled.select("rk", "class")
    if not links.isEmpty():
        names = components(spark, links).select(F.col("node").alias("class"), F.col("component").alias("joined"))
        joined = joined.join(names, "class", "left").select("rk", F.coalesce("joined", "class").alias("class"))
    return first.join(joined.select("rk", F.col("class").alias("joined")), "rk", "left").select("rk", F.coalesce("joined", "class").alias("class"))


def near_duplicates(spark: SparkSession, docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, rk, n_shingles, component_id, component (a number that also tells apart components without
    any doc_id; null without words) of every row of docs."""
    docs = keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    # A bucket holds the shingles of about 16 MB of text: some MB.
    buckets = int(max(12, -(-size // (16 << 20))))
    partitions = buckets
    table = stored(spark, signatures(docs, buckets), "jaccard-signatures")
    members = table.where("bucket = -1").select("batch", "place", "rk", "doc_id", "n", "same", "more")
    shared = shared_counts(table.where("bucket >= 0").select("batch", "bucket", "hashes", "counts"), partitions)
    # least_shared() as a column.
    overlap = F.ceil(3 * F.col("n") / 4)
    least = F.least(F.greatest(F.lit(1), F.floor(overlap / 8)), overlap)
    one = ["same", "more", "n"]
    likely = members.join(shared, ["batch", "place"]).where((F.col("n") > 0) & (F.col("shared") >= least)).select(*one).distinct()
    # Copies of a set in one batch are dealt once, so the likely row may be another: take the set's first row. Sets
    # are numbered when they are stored, so that no two share a number.
    sets = members.where("n > 0").groupBy(*one).agg(F.min(F.struct("rk", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("row"), F.min("doc_id").alias("least_id"))
    sets = stored(spark, sets.join(likely.withColumn("likely", F.lit(True)), one, "left").withColumn("node", F.monotonically_increasing_id()), "jaccard-sets")
    chosen = sets.where("likely").select(F.col("row.id").alias("id"), F.col("row.rk").alias("rk"), "node", "n")
    # From here on rk is a set's number.
    texts = stored(spark, docs.join(chosen, ["id", "rk"]).dropDuplicates(["node"]).select(F.col("node").alias("rk"), "n", "text"), "jaccard-texts")
    tokens = stored(spark, rare_shingles(texts, buckets, partitions), "jaccard-tokens")
    heads = tokens.groupBy("token").agg(F.min("rk").alias("head"), F.count("*").alias("k")).where("k > 1").select("token", "head")
    edges = tokens.join(heads, "token").where("rk <> head").select(F.col("rk").alias("a"), F.col("head").alias("b")).distinct()
    candidates = components(spark, edges).withColumnRenamed("node", "rk")
    classes = _classes(spark, texts.join(candidates, "rk"), tokens, most).withColumnRenamed("rk", "node")
    grouped = sets.join(classes, "node", "left").withColumn("component", F.coalesce("class", "node")).select(*one, "least_id", "component")
    ids = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(ids, "component").select(*one, "component", "component_id")
    full = members.where("n > 0").join(named, one).select("doc_id", "rk", F.col("n").alias("n_shingles"), "component_id", "component")
    empty = members.where("n = 0").select("doc_id", "rk", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return full.unionByName(empty)


def keep_first(spark: SparkSession, docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id. Documents without words stay."""
    found = near_duplicates(spark, docs, most)
    id_name, rk = free_name(docs, "_id"), free_name(docs, "_rk")
    key = row_key()
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("first")).select(F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias(id_name), F.col("first.rk").alias(rk))
    marked = docs.withColumns({id_name: key[0], rk: key[1]})
    kept = marked.join(first, [id_name, rk]).dropDuplicates([id_name, rk])
    without = marked.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.unionByName(without).drop(id_name, rk)
