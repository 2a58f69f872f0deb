"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A window is `depth` symbols of a text: 400 bytes (law BYTES) or 51 words (law WORDS, a passage of over 50 words
whatever its bytes). Two windows are repeated if they are equal; only the order of suffixes through `depth`
symbols matters, so suffixes are sorted by digits, most significant first, and only groups that still hold
several suffixes go on. The sort is anchored: each window's anchor is its leftmost gram with the smallest hash,
about one in 177 bytes or 23 words, and equal windows have equal anchors at equal offsets. So the first digit is
the gram, and the following digits are taken from the anchor outwards, to the right and to the left:

1. The anchor's gram. Grams that occur once are done.
2. All symbols of the windows of one anchor (its stretch): members of groups of equal stretches are repeated as a
   whole, so exact copies, however many, end here.
3. The different stretches of one gram are sorted symbol by symbol (`_digits`): pass d splits every group by its
   members' d-th symbol from the anchor and drops members that are alone. A window that takes l symbols to the
   left and depth - l to the right is repeated exactly if another member is in its group of left pass l and in
   its group of right pass depth - l. Symbols themselves are compared, not hashes.

The first two digits are counted by aggregations that combine before the shuffle, and joined back; keys with over
a thousandth of all anchors are looked up in a list of at most a thousand instead. Rows hold hashes and positions,
no text. In the third, a gram with up to `most_stretches` different stretches (about 600 bytes each) is sorted in
one task of about 12 MB. The windows of larger groups are sorted by two wider digits with the same aggregations, so no task holds
such a group: first the symbols that all windows of `PART` neighbouring offsets share, then, in groups of several,
each window whole. Equality is that of 64-bit hashes in steps 1 and 2 and of 128 bits in these wider digits.

Defined cases: null is the empty text; texts shorter than a window keep all; repeated rows repeat each other, so
all their windows go; windows never cross texts; very long texts are read in overlapping pieces; an empty table
gives no rows; other columns are ignored by remove_repeats and kept by replace_texts, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import Hashes, arrow_batches, buffers, free_name, keyed, mix, released, row_key, runs, slices, stored, trimmed, word_hashes, words

DEPTH = 400
#: A passage of over 50 words is one of this many or more.
N_WORDS = 51
PART = 16
HOT_KEYS, LEAST_HOT = 1000, 100
BYTES, WORDS = 0, 1
_MUL = np.uint64(0x9FB21C651E98DF25)
ANCHORS = "law int, id long, rk long, gram long, stretch long, first int, last int, at int"
RUNS = "law int, id long, rk long, first int, last int"


class Law(NamedTuple):
    """What a symbol is (BYTES or WORDS), symbols of a window, symbols of a gram."""

    kind: int
    depth: int
    gram: int


def laws_of(depth: int | None = DEPTH, n_words: int | None = N_WORDS) -> list[Law]:
    """Laws for repeated windows of depth bytes and of n_words words; None leaves one out."""
    return [Law(BYTES, depth, min(48, -(-depth // 2)))] * (depth is not None) + [Law(WORDS, n_words, min(6, -(-n_words // 2)))] * (n_words is not None)


def symbols(data: np.ndarray, offsets: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes themselves, or for words (runs of anything but white space, A-Z lower-cased) their 64-bit
    hashes; and offsets."""
    if kind == BYTES:
        return data, offsets
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in slices(offsets):
        lower, start, end, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(word_hashes(lower, start, end))
        counts.append(np.diff(first))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def anchors_of(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = 48):
    """For every anchor: text number, gram hash, stretch hash, first and last window, its own place;
    places count from the buffer's start."""
    n, width = len(data), depth - gram + 1
    nothing = np.zeros(0, np.int64)
    if n < depth:
        return nothing, nothing, nothing, nothing, nothing, nothing
    hashes = Hashes(data)
    grams = hashes.windows(gram)
    low = np.uint64(32)  # one constant, so that equal windows choose alike in every buffer
    places = np.arange(len(grams), dtype=np.uint64)
    value = ((grams >> low) << low) | places  # ties: the leftmost
    m = len(value) - width + 1
    padded = np.full(-(-len(value) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    blocks = padded.reshape(-1, width)
    until = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(since[:m], until[width - 1 : width - 1 + m]) & ((np.uint64(1) << low) - np.uint64(1))
    best = best.astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    whole = np.arange(m) + depth <= offsets[doc + 1]
    best[~whole] = -1 - doc[~whole]
    change = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]))))
    first, last = change, np.append(change[1:], m) - 1
    keep = best[first] >= 0
    first, last = first[keep], last[keep]
    at = best[first]
    stretch = mix(hashes.of(first, last + depth) + (at - first).astype(np.uint64) * _MUL)
    return doc[first], grams[at].view(np.int64), stretch.view(np.int64), first, last, at


def _pieces(data: np.ndarray, offsets: np.ndarray, depth: int, piece: int = 8 << 20):
    """(place of the piece's start in its text, symbols, offsets); a longer single text comes in pieces
    that overlap by depth - 1 symbols. Its windows are the same; stretches that a cut shortens are told apart or
    found equal by the third digits."""
    piece = piece // data.itemsize
    if len(offsets) > 2 or len(data) <= piece:
        yield 0, data, offsets
        return
    for at in range(0, max(len(data) - depth + 1, 1), piece):
        own = data[at : at + piece + depth - 1]
        yield at, own, np.array([0, len(own)])


def anchors(docs: DataFrame, laws: list[Law]) -> DataFrame:
    def task(batches):
        for b in batches:
            ids = b.column("id").to_numpy(), b.column("rk").to_numpy()
            for i, _, data, offsets in arrow_batches(b, "text"):
                for law in laws:
                    salt = np.int64(law.kind * 0x2545F4914F6CDD1D)  # grams of several laws don't meet
                    for begin, own, edge in _pieces(*symbols(data, offsets, law.kind), law.depth):
                        doc, g, s, first, last, at = anchors_of(own, edge, law.depth, law.gram)
                        base = edge[doc] - begin
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), law.kind, np.int32)), *[pa.array(x[i + doc]) for x in ids], pa.array(g ^ salt), pa.array(s), *[pa.array(x - base, pa.int32()) for x in (first, last, at)]], ["law", "id", "rk", "gram", "stretch", "first", "last", "at"])

    return docs.select("id", "rk", "text").mapInArrow(trimmed(task), ANCHORS)


# ---- the third digits -------------------------------------------------------------------------------


class Stretches:
    """Stretches of one law from a table with bodies: their symbols, sizes and anchors."""

    def __init__(self, t: pa.Table, kind: int):
        data, offsets = buffers(t.column("body"))
        self.data, width = (data, 1) if kind == BYTES else (np.ascontiguousarray(data).view(np.uint64), 8)
        self.start, self.size = offsets[:-1] // width, np.diff(offsets) // width
        self.left = t.column("left").to_numpy().astype(np.int64)
        self.gram, self.n = t.column("gram").to_numpy(), t.column("n").to_numpy()
        self.id, self.rk, self.first = (t.column(c).to_numpy() for c in ("id", "rk", "first"))


def _digits(symbol: np.ndarray, place: np.ndarray, room: np.ndarray, step: int, group: np.ndarray, depth: int) -> np.ndarray:
    """Row d holds each member's group after d symbols from its place on, in the direction of step; -1 where no
    other member is equal so far, or where its room ends."""
    size = int(symbol.max(initial=0)) + 1
    out = np.full((depth + 1, len(group)), -1, np.int32)
    alive = np.argsort(group, kind="stable")
    own = group[alive]
    out[0] = group
    for d in range(depth):
        more = room[alive] > d
        alive, own = alive[more], own[more]
        if not len(alive):
            break
        digit = own * size + symbol[place[alive] + step * d]
        order = np.argsort(digit, kind="stable")  # already sorted by group
        digit = digit[order]
        new = np.concatenate(([True], digit[1:] != digit[:-1]))
        own = np.cumsum(new) - 1
        several = np.diff(np.append(np.flatnonzero(new), len(new)))[own] > 1
        alive, own = alive[order][several], own[several]
        out[d + 1, alive] = own
    return out


def repeated_in(s: Stretches, law: Law) -> pa.RecordBatch:
    """Runs of windows, as windows of their texts, that another stretch of the same gram holds too; only of
    stretches that are not repeated as a whole."""
    group = np.unique(s.gram, return_inverse=True)[1].astype(np.int64)
    symbol = s.data.astype(np.int64) if law.kind == BYTES else np.unique(s.data, return_inverse=True)[1]
    anchor = s.start + s.left
    right = _digits(symbol, anchor, s.size - s.left, 1, group, law.depth)
    left = _digits(symbol, anchor - 1, s.left, -1, group, law.depth - law.gram)
    hit = np.zeros((len(s.n), len(left) + 2), np.int8)
    for l in range(len(left)):
        member = np.flatnonzero((left[l] >= 0) & (right[law.depth - l] >= 0))
        key = left[l, member].astype(np.int64) * len(s.n) + right[law.depth - l, member]
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        hit[member[order], l + 1] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(key) else 0
    hit[s.n > 1] = 0
    edge = np.diff(hit, axis=1)
    who, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    base = s.first[who] + s.left[who]
    return _runs(law.kind, s.id[who], s.rk[who], base - high, base - low)


def _runs(kind: int, id_, rk, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rk), kind, np.int32)), pa.array(id_, pa.int64()), pa.array(rk, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["law", "id", "rk", "first", "last"])


def _by_law(t: pa.Table, laws: list[Law]):
    for law in laws:
        own = t.filter(pa.compute.equal(t.column("law"), law.kind)).combine_chunks()
        if own.num_rows:
            yield law, Stretches(own, law.kind)


def _sorted_groups(laws: list[Law], most_bytes: int = 4 << 20):
    """Over stretches sorted by gram, several groups at a time."""

    def task(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            while b.num_rows:
                g = b.column("gram").to_numpy()
                if held and size >= most_bytes:
                    # Cut only where a gram's group ends.
                    other = np.flatnonzero(g != held[-1].column("gram")[-1].as_py())
                    if len(other):
                        k = int(other[0])
                        if k:
                            held.append(b.slice(0, k))
                            b = b.slice(k)
                        yield from (repeated_in(s, law) for law, s in _by_law(pa.Table.from_batches(held), laws))
                        held, size = [], 0
                        continue
                ends = np.cumsum(pa.compute.binary_length(b.column("body")).to_numpy())
                k = min(b.num_rows, int(np.searchsorted(ends, most_bytes - size)) + 1) if size < most_bytes else b.num_rows
                held.append(b.slice(0, k))
                size += int(ends[k - 1])
                b = b.slice(k)
        if held:
            yield from (repeated_in(s, law) for law, s in _by_law(pa.Table.from_batches(held), laws))

    return task


PARTS = "law int, digit long, id long, rk long, place int, n long, windows binary"


def parts_of(s: Stretches, law: Law) -> pa.RecordBatch:
    """Windows of a stretch cut where their offset from the anchor passes a multiple of PART. The digit of a part
    covers the symbols that all windows of those offsets share; windows are given by their hashes."""
    count = s.size - law.depth + 1
    owner = np.repeat(np.arange(len(count)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hashes = Hashes(s.data)
    begin = s.start[owner] + step
    windows = hashes.of(begin, begin + law.depth)
    part = (s.left[owner] - step) // PART
    cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))))
    own, part = owner[cut], part[cut]
    anchor = s.start[own] + s.left[own]
    top = np.minimum((part + 1) * PART, law.depth - law.gram + 1)  # the part's offsets end before
    digit = mix(hashes.of(anchor - part * PART, anchor + law.depth - top + 1) + part.astype(np.uint64) * _MUL + s.gram[own].view(np.uint64))
    edge = (np.append(cut, len(owner)) * 8).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(edge), pa.py_buffer(windows)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), law.kind, np.int32)), pa.array(digit.view(np.int64)), pa.array(s.id[own]), pa.array(s.rk[own]), pa.array((s.first[own] + step[cut]).astype(np.int32)), pa.array(s.n[own]), packed], ["law", "digit", "id", "rk", "place", "n", "windows"])


def _large_groups(spark: SparkSession, bodies: DataFrame, laws: list[Law]) -> DataFrame:
    """Repeated windows of grams with many stretches, by two wider digits."""

    def parts(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                yield from (parts_of(s, law) for law, s in _by_law(pa.Table.from_batches([b.slice(k, 2000)]), laws))

    def single(batches):
        for b in batches:
            data, offsets = buffers(b.column("windows"))
            count = np.diff(offsets) // 8
            row = np.repeat(np.arange(b.num_rows), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            columns = [pa.array(b.column(c).to_numpy()[row]) for c in ("law", "digit")] + [pa.array(np.ascontiguousarray(data).view(np.int64))]
            columns += [pa.array(b.column(c).to_numpy()[row]) for c in ("id", "rk")] + [pa.array((b.column("place").to_numpy()[row] + step).astype(np.int32)), pa.array(b.column("n").to_numpy()[row])]
            yield pa.RecordBatch.from_arrays(columns, ["law", "digit", "h", "id", "rk", "place", "n"])

    def several(rows: DataFrame, key: list[str]) -> DataFrame:
        # Stored before the join: a join that shares the aggregation's shuffle could not split a large group.
        again = stored(spark, rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1").select(key), "suffix-digits")
        return rows.join(again, key)

    # Several rows of one key (equal rows) give equal bodies, which were counted as such.
    cut = stored(spark, bodies.dropDuplicates(["gram", "id", "rk", "first"]).mapInArrow(trimmed(parts), PARTS), "suffix-parts")
    whole = stored(spark, several(cut, ["digit"]).mapInArrow(trimmed(single), "law int, digit long, h long, id long, rk long, place int, n long"), "suffix-windows")
    return several(whole, ["digit", "h"]).where("n = 1").select("law", "id", "rk", F.col("place").alias("first"), F.col("place").alias("last"))


def repeated_runs(spark: SparkSession, docs: DataFrame, laws: list[Law], most_stretches: int = 20_000) -> DataFrame:
    """law, id, rk, first and last of runs of window starts that are repeated; docs is keyed()."""
    every = stored(spark, anchors(docs, laws), "suffix-anchors")
    # A key with more than a thousandth of all anchors is hot; there are at most a thousand of those, so they
    # are handed to every task as a list. The rows of all other keys are joined.
    hot_at = max(every.count() // HOT_KEYS, LEAST_HOT)
    groups = every.groupBy("gram").agg(F.count("*").alias("n_gram"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("n_gram > 1")
    # Stored before the join: a join that shares the aggregation's shuffle could not split a large gram.
    groups = stored(spark, groups.select("gram", "n_gram", (F.col("low") != F.col("high")).alias("several")), "suffix-grams")
    hot = {r["gram"]: r["several"] for r in groups.where(F.col("n_gram") > hot_at).select("gram", "several").collect()}
    cold = every.where(~F.col("gram").isin(list(hot))).join(groups.where(F.col("n_gram") <= hot_at).select("gram", "several"), "gram")
    heated = every.where(F.col("gram").isin(list(hot))).withColumn("several", F.col("gram").isin([g for g, several in hot.items() if several]))
    going = stored(spark, cold.unionByName(heated), "suffix-groups")
    released(spark, every, groups)
    # One stretch only: all are repeated. Else a stretch's own group decides.
    run = ["law", "id", "rk", "first", "last"]
    alike = going.where("not several").select(run)
    mixed = going.where("several")
    stretches = mixed.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min(F.struct(*run, "at")).alias("m"))
    stretches = stored(spark, stretches.select("gram", "stretch", "n", "m.*"), "suffix-stretches")
    # A stretch's hash covers its gram, so it may stand for both.
    hot_stretches = [r["stretch"] for r in stretches.where(F.col("n") > hot_at).select("stretch").collect()]
    again = stretches.where((F.col("n") > 1) & (F.col("n") <= hot_at)).select("gram", "stretch")
    equal = mixed.where(~F.col("stretch").isin(hot_stretches)).join(again, ["gram", "stretch"]).select(run)
    equal = equal.unionByName(mixed.where(F.col("stretch").isin(hot_stretches)).select(run))

    per_gram = stretches.groupBy("gram").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    # Without a stretch that occurs once there is nothing left to decide.
    open_grams = stored(spark, per_gram.where("least = 1").select("gram", (F.col("k") > most_stretches).alias("large")), "suffix-open")
    wanted = stretches.join(open_grams, "gram").groupBy("id", "rk").agg(F.collect_list(F.struct("law", "gram", "n", "first", "last", "at", "large")).alias("wanted"))
    texts = docs.join(wanted, ["id", "rk"])

    def bodies(batches):
        for b in batches:
            data, offsets = buffers(b.column("text"))
            lists = b.column("wanted")
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            kind = flat.field("law").to_numpy()
            for law in laws:
                mine = np.flatnonzero(kind == law.kind)
                if not len(mine):
                    continue
                given, edge = symbols(data, offsets, law.kind)
                own = {f: flat.field(f).take(pa.array(mine)) for f in ("law", "gram", "n", "first", "last", "at", "large")}
                first, last, at = (own[f].to_numpy().astype(np.int64) for f in ("first", "last", "at"))
                of = row[mine]
                start, size = edge[of] + first, last - first + law.depth
                till = np.concatenate(([0], np.cumsum(size)))
                for i in range(0, len(of), 8000):
                    j = min(i + 8000, len(of))
                    body = given[np.repeat(start[i:j] - till[i:j], size[i:j]) + np.arange(till[i], till[j])]
                    column = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((till[i : j + 1] - till[i]) * given.itemsize).astype(np.int32)), pa.py_buffer(body)])
                    keys = [pa.array(b.column(c).to_numpy()[of[i:j]]) for c in ("id", "rk")]
                    yield pa.RecordBatch.from_arrays([own["law"][i:j], own["gram"][i:j], own["n"][i:j], *keys, own["first"][i:j], pa.array((at - first)[i:j], pa.int32()), own["large"][i:j], column], ["law", "gram", "n", "id", "rk", "first", "left", "large", "body"])

    # id and rk may be those of several rows (equal ones); any of them will do, and equal rows were counted as such.
    stretched = texts.select("id", "rk", "text", "wanted").mapInArrow(trimmed(bodies), "law int, gram long, n long, id long, rk long, first int, left int, large boolean, body binary")
    stretched = stored(spark, stretched, "suffix-bodies")
    plain = stretched.where("not large").drop("large")
    small = plain.repartition("gram").sortWithinPartitions("gram").mapInArrow(trimmed(_sorted_groups(laws)), RUNS)
    found = alike.unionByName(equal).unionByName(small)
    large = stretched.where("large").drop("large")
    return found if large.isEmpty() else found.unionByName(_large_groups(spark, large, laws))


# ---- what is left of texts --------------------------------------------------------------------------


class Found:
    """The runs of a batch of texts: bytes covered by each law, and words in repeated passages."""

    def __init__(self, texts: pa.Array, lists: pa.ListArray, laws: list[Law]):
        self.data, self.offsets = buffers(texts)
        at = lists.offsets.to_numpy()
        flat = lists.flatten()
        n = len(self.offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(at))
        kind = flat.field("law").to_numpy(zero_copy_only=False)
        first, last = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("first", "last"))
        self.gone, self.n_words = {}, np.zeros(n, np.int64)
        for law in laws:
            mine = kind == law.kind
            own, begin, end = owner[mine], first[mine], last[mine] + law.depth
            if law.kind == BYTES:
                self.gone[law.kind] = self._covered(self.offsets[own] + begin, self.offsets[own] + end, len(self.data))
            elif len(own):
                _, start, stop, word = words(self.data, self.offsets)
                hit = self._covered(word[own] + begin, word[own] + end, len(start))
                self.n_words = np.diff(np.concatenate(([0], np.cumsum(hit)))[word])
                self.gone[law.kind] = self._covered(start[word[own] + begin], stop[word[own] + end - 1], len(self.data))
            else:
                self.gone[law.kind] = np.zeros(len(self.data), bool)

    @staticmethod
    def _covered(begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
        edge = np.zeros(size + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        return np.cumsum(edge, out=edge)[:-1] > 0

    def left(self, kinds: list[int]):
        """For each text: bytes, removed bytes, removed runs and what is left, where runs of all kinds go."""
        gone = self.gone[kinds[0]]
        for k in kinds[1:]:
            gone = gone | self.gone[k]
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            own, mark = self.data[a:b], gone[a:b]
            yield (b - a, int(mark.sum()), len(runs(mark)[0]), own[~mark]) if mark.any() else (b - a, 0, 0, own)


_NONE = "cast(array() as array<struct<law: int, first: int, last: int>>)"


def _lists(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("id", "rk").agg(F.collect_set(F.struct("law", "first", "last")).alias(name))


def remove_repeats(spark: SparkSession, docs: DataFrame, depth: int = DEPTH, n_words: int | None = N_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs by the law of depth bytes, and
    n_passage_words: its words in repeated passages of n_words words. with_text adds what is left by the law of
    bytes, where bytes that are no longer valid UTF-8, because a character was cut, are dropped."""
    docs, laws = keyed(docs), laws_of(depth, n_words)
    rows = docs.join(_lists(repeated_runs(spark, docs, laws), "found"), ["id", "rk"], "left").select("doc_id", "text", F.coalesce("found", F.expr(_NONE)).alias("found"))

    def task(batches):
        for b in batches:
            found = Found(b.column("text"), b.column("found"), laws)
            got = list(found.left([BYTES]))
            columns = [b.column("doc_id"), *[pa.array([g[k] for g in got], pa.int64()) for k in range(3)], pa.array([hashlib.sha256(g[3]).hexdigest() for g in got], pa.string()), pa.array(found.n_words, pa.int64())]
            if with_text:
                columns.append(pa.array([g[3].tobytes().decode("utf-8", "ignore") for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"] + ["text"] * with_text)

    return rows.mapInArrow(trimmed(task), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long" + ", text string" * with_text)


def replace_texts(spark: SparkSession, docs: DataFrame, depth: int | None = DEPTH, n_words: int | None = N_WORDS) -> DataFrame:
    """docs with text (and n_chars, if there is one) of what is left after repeated passages of n_words words
    and repeated windows of depth bytes are removed; the latter cover passages with few spaces. Other columns stay
    as they are. A text that has no repeat, null included, stays as it is."""
    # Two laws hold sums and marks of a whole batch in memory: batches of half the usual size.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    laws = laws_of(depth, n_words)
    id_name, key_name, found_name = free_name(docs, "_id"), free_name(docs, "_rk"), free_name(docs, "_found")
    found = _lists(repeated_runs(spark, keyed(docs), laws), found_name).withColumnsRenamed({"id": id_name, "rk": key_name})
    key = row_key()
    marked = docs.withColumns({id_name: key[0], key_name: key[1]}).join(found, [id_name, key_name], "left")
    names = docs.columns

    def task(batches):
        for b in batches:
            lists = b.column(found_name)
            cut = pa.compute.is_valid(lists)
            texts = [g[3].tobytes().decode("utf-8", "ignore") for g in Found(b.column("text"), lists, laws).left([law.kind for law in laws])]
            text = pa.compute.if_else(cut, pa.array(texts, pa.string()), b.column("text"))
            out = {n: b.column(n) for n in names}
            out["text"] = text
            if "n_chars" in out:
                out["n_chars"] = pa.compute.if_else(cut, pa.compute.utf8_length(text).cast(out["n_chars"].type), out["n_chars"])
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return marked.select(*names, found_name).mapInArrow(trimmed(task), docs.schema)
