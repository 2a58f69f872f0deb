"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: 13 consecutive words, or all words of a shorter
item. A shift table over two-word blocks tells how far a window's end can move on without missing a
pattern; where it can't move, the patterns whose last block has the same hash are compared word by word.
Many cursors, each over its own stretch of the words of many documents, advance together in numpy.

Defined cases: null or wordless texts have no words and no hits; a null item_id counts as an empty id;
items with the same id count once; repeated rows of documents each get their row; very long texts are searched
whole; an empty benchmark hits nothing and an empty table gives no rows; other columns stay, whatever their names.
Words are compared by 64-bit hashes.

The windows of one pass are broadcast and number at most `most_windows` (about 110 bytes each); a larger
benchmark is searched in several passes over parts of its items, whose hits are merged per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import ALNUM, annotate, arrow_batches, buffers, crc_of_id, free_name, word_hashes, words

WINDOW = 13
RESULT = "struct<n_words: long, hits: array<struct<start: int, end: int>>, items: array<string>>"
ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
_MUL = np.uint64(0x9FB21C651E98DF25)
_STRETCH = 256


class Patterns:
    """Shift table, suffix buckets and items of all windows of one length."""

    def __init__(self, rows: np.ndarray, owners: np.ndarray):
        unique, inverse = np.unique(rows, axis=0, return_inverse=True)
        last = self.blocks(unique)[:, -1]
        order = np.argsort(last, kind="stable")
        self.words, self.last, self.length = unique[order], last[order], rows.shape[1]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[inverse.ravel()], owners]), axis=1)
        self.owner, self.owner_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(order) + 1))
        self.bits = max(16, int(len(unique) * 4).bit_length())
        blocks = self.blocks(self.words)
        n = blocks.shape[1]
        self.shift = np.full(1 << self.bits, n, np.int64)
        for j in range(n):  # later blocks allow shorter shifts
            self.shift[self.slot(blocks[:, j])] = n - 1 - j

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        return rows if rows.shape[-1] == 1 else rows[..., :-1] * _MUL + rows[..., 1:]

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words of occurrences in text, and the pattern of each."""
        m, n = self.length, len(text)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = self.blocks(text)
        if m > 1:
            block = np.concatenate(([np.uint64(0)], block))  # of the words up to each end
        at = np.arange(0, n, _STRETCH)
        stop = np.minimum(at + _STRETCH, n)
        at = np.maximum(at, m - 1)
        jump = self.shift[self.slot(block)]
        found = []
        while (going := at < stop).any():
            at, stop = at[going], stop[going]
            by = jump[at]
            if len(check := at[by == 0]):
                found.append(check)
            at = at + np.maximum(by, 1)
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        low, high = (np.searchsorted(self.last, block[ends], side) for side in ("left", "right"))
        count = high - low
        which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ends = np.repeat(ends, count)
        for j in range(m):
            same = text[ends - j] == self.words[which, m - 1 - j]
            ends, which = ends[same], which[same]
        return ends, which


def windows_of(item_ids: list[str], texts: pa.Array, window: int = WINDOW) -> list[Patterns]:
    data, offsets = buffers(texts)
    data, start, end, at = words(data, offsets, ALNUM)
    hashed = word_hashes(data, start, end)
    ids = np.unique(np.array(item_ids, object).astype(str))
    place = {x: i for i, x in enumerate(ids)}
    by_length: dict[int, tuple[list, list]] = {}
    for i, item in enumerate(item_ids):
        own = hashed[at[i] : at[i + 1]]
        if len(own):
            m = min(window, len(own))
            rows, owners = by_length.setdefault(m, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(own, m))
            owners.append(np.full(len(own) - m + 1, place[item]))
    found = [Patterns(np.concatenate(rows), np.concatenate(owners)) for rows, owners in by_length.values()]
    for p in found:
        p.names = ids
    return found


def _scan(batch: pa.RecordBatch, patterns: list[Patterns]) -> pa.Array:
    n_words, hits, items = [], [], []
    for i, j, data, offsets in arrow_batches(batch, "text"):
        data, start, end, at = words(data, offsets, ALNUM)
        hashed = word_hashes(data, start, end)
        n = len(hashed)
        cover = np.zeros(n + 1, np.int64)
        pairs = []
        for p in patterns:
            ends, which = p.find(hashed)
            doc = np.searchsorted(at, ends, "right") - 1
            whole = ends - p.length + 1 >= at[doc]
            ends, which, doc = ends[whole], which[whole], doc[whole]
            np.add.at(cover, ends - p.length + 1, 1)
            np.add.at(cover, ends + 1, -1)
            count = p.owner_at[which + 1] - p.owner_at[which]
            owner = p.owner[np.repeat(p.owner_at[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            pairs.append(np.stack([np.repeat(doc, count), owner]))
        hit = np.cumsum(cover[:-1]) > 0
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        edge = np.searchsorted(pairs[0], np.arange(j - i + 1))
        for d in range(j - i):
            n_words.append(int(at[d + 1] - at[d]))
            if edge[d] == edge[d + 1]:
                hits.append([])
                items.append([])
                continue
            mine = np.flatnonzero(hit[at[d] : at[d + 1]])
            cut = np.flatnonzero(np.diff(mine) > 1)
            hits.append([{"start": a, "end": b + 1} for a, b in zip(mine[np.r_[0, cut + 1]].tolist(), mine[np.r_[cut, len(mine) - 1]].tolist(), strict=True)])
            items.append([str(patterns[0].names[x]) for x in pairs[1, edge[d] : edge[d + 1]]])
    return pa.StructArray.from_arrays([pa.array(n_words, ARROW[0].type), pa.array(hits, ARROW[1].type), pa.array(items, ARROW[2].type)], fields=list(ARROW))


def find_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = 500_000) -> tuple[DataFrame, str]:
    """docs with a struct column (n_words, hits: runs of hit words, items: ids found); returns its name too."""
    from pyspark.sql import types as T

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # An item has no more windows than half its characters, and one.
    total = items.agg(F.sum(F.length("text") / 2 + 1)).collect()[0][0] or 0
    parts = max(1, int(-(-total // most_windows)))
    result_type = T._parse_datatype_string(RESULT)
    found = []
    name = ""
    for k in range(parts):
        own = items if parts == 1 else items.where(F.pmod(crc_of_id("item_id"), F.lit(parts)) == k)
        got = own.toArrow()
        column = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
        shared = spark.sparkContext.broadcast(windows_of(got.column("item_id").to_pylist(), column, window))
        df, name = annotate(docs, result_type, _scan, lambda shared=shared: shared.value)
        found.append(df)
    if parts == 1:
        return found[0], name
    # Each pass has every row; equal rows have equal hits, so a row's hits can be merged by its content.
    row, more_items, more_hits = (free_name(found[0], x) for x in ("_row", "_items", "_hits"))
    marked = [df.withColumn(row, F.xxhash64(*docs.columns)) for df in found]
    merged = marked[0]
    rest = marked[1]
    for df in marked[2:]:
        rest = rest.unionByName(df)
    rest = rest.where(F.size(f"{name}.items") > 0).groupBy(row).agg(F.array_distinct(F.flatten(F.collect_set(f"{name}.items"))).alias(more_items), F.flatten(F.collect_set(f"{name}.hits")).alias(more_hits))
    merged = merged.join(rest, row, "left")
    hits = F.array_sort(F.concat(f"{name}.hits", F.coalesce(more_hits, F.expr("array()"))))
    # Runs are sorted by start: a run that begins within the last one prolongs it.
    joined = F.aggregate(
        hits,
        F.expr("cast(array() as array<struct<start: int, end: int>>)"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    both = F.array_union(f"{name}.items", F.coalesce(more_items, F.expr("array()")))
    return merged.withColumn(name, F.struct(F.col(f"{name}.n_words").alias("n_words"), joined.alias("hits"), both.alias("items"))).drop(row, more_items, more_hits), name


def hit_words(name: str):
    return F.aggregate(f"{name}.hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def contaminated(name: str):
    """A twentieth of a document's words, and one, are hit."""
    return (F.size(f"{name}.hits") > 0) & (20 * hit_words(name) >= F.col(f"{name}.n_words"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark's passages."""
    df, name = find_benchmark(spark, docs, benchmark, window)
    return df.where(~contaminated(name)).drop(name)
