"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period q, at least max(least, 2 q) long, that no neighbouring word extends.
The words of many texts, parted by symbols of their own, are compressed level by level: blocks of equal symbols
become one symbol with a count, then pairs across a random split of the alphabet become one symbol, and so on. Equal
stretches are compressed alike but for their edges, so the common extension of two places is found by climbing to
larger symbols while they agree and descending where they differ; a block is passed in one step, whatever its count.

Every run of period p holds two places k p and (k + 1) p of its text for some k. All such places (about n ln n in a
text of n words) are looked at; where the words around them agree far enough for a run, their exact extensions to both
sides are asked of the grammar, for all texts of a slice at once. Of equal stretches the smallest period is kept.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows each get their row; very long
texts are taken whole, at about 200 bytes of memory a word; an empty table gives no rows; other columns stay, whatever
their names. Words are runs of anything but white space and are compared by 64-bit hashes; case counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobloom.llm.common import WHITESPACE, annotate, arrow_batches, mix, word_hashes, words

RESULT = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
LEAST = 12
#: Grids of texts up to so many words are kept.
KEPT_GRID = 1 << 15
#: Words as they are, without a change of case.
_KIND = (np.arange(256, dtype=np.uint8), ~np.isin(np.arange(256), list(WHITESPACE)))
_PAIR, _BLOCK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Grammar:
    """Levels of a sequence of symbols, one behind the other, each between two symbols of its own: symbol, length in
    words, first and last part on the level below, the symbol above, whether a symbol is the first or last part of it,
    and how many equal symbols of the same block follow and precede."""

    def __init__(self, sequence: np.ndarray, most_levels: int = 200):
        self.levels: list[dict[str, np.ndarray]] = []
        symbols, length = sequence, np.ones(len(sequence), np.int64)
        low = high = np.full(len(sequence), -1, np.int64)
        base, blocks = 0, True
        while True:
            n = len(symbols)
            edge = lambda i: np.array([mix(np.array([(len(self.levels) << 1) | i], np.uint64) * _BLOCK)[0]])  # noqa: B023, E731
            level = {"symbol": np.concatenate((edge(0), symbols, edge(1)))}
            level["length"] = np.concatenate(([0], length, [0]))
            ends = (self.base, base - 1) if self.levels else (-1, -1)
            level["low"], level["high"] = np.concatenate(([ends[0]], low, [ends[1]])), np.concatenate(([ends[0]], high, [ends[1]]))
            self.levels.append(level)
            self.base, base = base, base + n + 2
            if n <= 1 or len(self.levels) == most_levels:
                break
            new = np.ones(n, bool)  # where a symbol of the next level begins
            if blocks:
                new[1:] = symbols[1:] != symbols[:-1]
            else:
                side = (mix(symbols ^ np.uint64(len(self.levels) * int(_PAIR) % (1 << 64))) & np.uint64(1)).astype(bool)
                new[1:] = side[:-1] | ~side[1:]
            start = np.flatnonzero(new)
            end = np.append(start[1:], n)
            count = end - start
            place = np.cumsum(new) - 1
            level["up"] = np.concatenate(([base], place + base + 1, [base + len(start) + 1]))
            level["is_first"] = np.concatenate(([True], new, [True]))
            level["is_last"] = np.concatenate(([True], np.append(new[1:], True), [True]))
            at = np.arange(n)
            level["after"] = np.concatenate(([1], end[place] - at if blocks else np.ones(n, np.int64), [1]))
            level["before"] = np.concatenate(([1], at - start[place] + 1 if blocks else np.ones(n, np.int64), [1]))
            first, many = symbols[start], count > 1
            if blocks:
                symbols = np.where(many, mix(first * _BLOCK + count.astype(np.uint64)), first)
                length = length[start] * count
            else:
                symbols = np.where(many, mix(mix(first + _PAIR) * _PAIR + symbols[end - 1]), first)
                length = np.add.reduceat(length, start)
            low, high = start + self.base + 1, end + self.base
            blocks = not blocks
        top = self.levels[-1]
        n = len(top["symbol"])
        top |= {"up": np.full(n, -1, np.int64), "is_first": np.zeros(n, bool), "is_last": np.zeros(n, bool), "after": np.ones(n, np.int64), "before": np.ones(n, np.int64)}
        kinds = {"symbol": np.uint64, "is_first": bool, "is_last": bool}
        small = np.int32 if base < 1 << 31 else np.int64
        for name in ("symbol", "length", "low", "high", "up", "is_first", "is_last", "after", "before"):
            setattr(self, name, np.concatenate([x.pop(name).astype(kinds.get(name, small)) for x in self.levels]))

    def extension(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from places i and j on (or up to and with them, backward) agree; i < j."""
        edge, part, run, step = (self.is_first, self.low, self.after, 1) if forward else (self.is_last, self.high, self.before, -1)
        out = np.zeros(len(i), np.int64)
        left, a, b = np.arange(len(i)), i + 1, j + 1  # level 0 has its edge symbol at 0
        while len(left):
            same = self.symbol[a] == self.symbol[b]
            up_a, up_b = self.up[a], self.up[b]
            climb = same & edge[a] & edge[b] & (up_a >= 0)
            climb &= self.symbol[up_a] == self.symbol[up_b]
            passed = np.minimum(run[a], run[b]).astype(np.int64)
            ahead = same & ~climb
            out[left] += np.where(ahead, passed * self.length[a], 0)
            down_a, down_b = part[a], part[b]
            done = ~same & (down_a < 0)
            a = np.where(climb, up_a, np.where(ahead, a + step * passed, down_a))
            b = np.where(climb, up_b, np.where(ahead, b + step * passed, down_b))
            if done.any():
                left, a, b = left[~done], a[~done], b[~done]
        return out


def _grid(n: int):
    """All places (k p, (k + 1) p) of a text of n words with p <= n / 2, in blocks."""
    root = max(1, int(n**0.5))
    for p in range(1, min(root, n // 2) + 1):
        second = np.arange(p, n, p)
        yield second - p, second
    p = np.arange(root + 1, n // 2 + 1)
    k = 0
    while len(p := p[(k + 1) * p < n]):
        yield k * p, (k + 1) * p
        k += 1


@lru_cache(1)
def _kept_grid() -> tuple[np.ndarray, np.ndarray]:
    """Places of a long text, by the second; those of a shorter one come first (with larger periods among them)."""
    blocks = list(_grid(KEPT_GRID))
    first, second = (np.concatenate([x[i] for x in blocks]).astype(np.int32) for i in (0, 1))
    order = np.argsort(second, kind="stable")
    return first[order], second[order]


def _candidates(words_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid places of all texts at which the words are equal. at: where each text begins, and one past its end."""
    ones, twos = [], []
    for start, end in at.tolist():
        n = end - start
        if n < 2:
            continue
        own = words_[start:end]
        if n <= KEPT_GRID:
            first, second = _kept_grid()
            stop = np.searchsorted(second, np.int32(n))
            blocks = [(first[:stop], second[:stop])]
        else:
            blocks = _grid(n)
        for a, b in blocks:
            same = np.flatnonzero(own[a] == own[b])
            ones.append(a[same].astype(np.int64) + start)
            twos.append(b[same].astype(np.int64) + start)
    return (np.concatenate(ones), np.concatenate(twos)) if ones else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def find_runs(symbols: np.ndarray, at: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), by text, start and period, of texts that begin at at[i] and end at
    at[i + 1] in symbols."""
    n_texts = len(at) - 1
    # A symbol of its own before each text and behind the last; its place in the sequence makes it unique.
    gap = np.searchsorted(at[:-1], np.arange(len(symbols)), "right")
    sequence = np.empty(len(symbols) + n_texts + 1, np.uint64)
    inside = np.arange(len(symbols)) + gap
    own = np.ones(len(sequence), bool)
    own[inside] = False
    sequence[inside] = symbols
    sequence[own] = mix(np.arange(own.sum(), dtype=np.uint64) * _PAIR + _BLOCK)
    start = at[:-1] + np.arange(n_texts) + 1
    a, b = _candidates(sequence, np.stack([start, start + np.diff(at)], axis=1))
    # A run has max(least - p, p) >= least / 2 agreeing places, half of them to one side or the other.
    reach = max(1, (least // 2 + 1) // 2)
    # Chains of agreement stop at the symbols between texts; places are kept within the sequence for their sake.
    after, before = np.ones(len(a), bool), np.ones(len(a), bool)
    for d in range(1, reach):
        after &= sequence[np.minimum(a + d, len(sequence) - 1)] == sequence[np.minimum(b + d, len(sequence) - 1)]
    for d in range(1, reach):
        before &= sequence[np.maximum(a - d, 0)] == sequence[np.maximum(b - d, 0)]
    keep = after | before
    a, b = a[keep], b[keep]
    if not len(a):
        return np.zeros((0, 4), np.int64)
    grammar = Grammar(sequence)
    p = b - a
    right = grammar.extension(a, b, True)
    left = grammar.extension(a - 1, b - 1, False)
    length = left + right + p
    good = length >= np.maximum(least, 2 * p)
    begin, length, p = (a - left)[good], length[good], p[good]
    # A start and a period fix the length; of equal starts and lengths the first, by period, has the smallest.
    for by_period in (True, False):
        one = np.unique((begin << 32) | (p if by_period else length), return_index=True)[1]
        begin, length, p = begin[one], length[one], p[one]
    text = np.searchsorted(start, begin, "right") - 1
    found = np.stack([text, begin - start[text], length, p], axis=1)
    return found[np.lexsort((p, begin))]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of data one behind the other, each with a space after it, and where each begins (one more than words)."""
    size = end - start + 1
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(at[-1], 0x20, np.uint8)
    if len(start):
        source = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
        is_word = np.ones(at[-1], bool)
        is_word[at[1:] - 1] = False
        out[is_word] = data[source[is_word]]
    return out, at


def _per_batch(batch: pa.RecordBatch, column: str, least: int) -> pa.Array:
    n_words, collapsed, n_runs, rows = [], [], [], []
    for _, _, data, offsets in arrow_batches(batch, column):
        data, start, end, at = words(data, offsets, _KIND)
        at = at.astype(np.int64)
        found = find_runs(word_hashes(data, start, end), at, least)
        drop = np.zeros(len(start) + 1, np.int64)
        begin = at[found[:, 0]] + found[:, 1]
        np.add.at(drop, begin + found[:, 3], 1)
        np.add.at(drop, begin + found[:, 2], -1)
        keep = np.cumsum(drop[:-1]) == 0
        text, place = _joined(data, start[keep], end[keep])
        cut = place[np.concatenate(([0], np.cumsum(keep)))[at]]
        whole = text.tobytes()
        collapsed += [whole[x : y - 1].decode() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        n_words.append(np.diff(at))
        n_runs.append(np.bincount(found[:, 0], minlength=len(at) - 1))
        rows.append(found[:, 1:])
    joined = lambda parts, empty: np.concatenate(parts) if parts else empty
    every = joined(rows, np.zeros((0, 3), np.int64))
    edges = np.concatenate(([0], np.cumsum(joined(n_runs, np.zeros(0, np.int64))))).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(every[:, i].astype(np.int64)) for i in range(3)], fields=list(RUN))
    return pa.StructArray.from_arrays([pa.array(joined(n_words, np.zeros(0, np.int64)).astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges), structs).cast(ARROW[1].type), pa.array(collapsed, pa.string())], fields=list(ARROW))


def periodic_runs(docs: DataFrame, column: str = "text", least: int = LEAST) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned too: n_words, runs (start and length in words, smallest
    period) by start and period, and the text without the words that a run repeats after its first period, its other
    words joined by one space."""
    from pyspark.sql.types import _parse_datatype_string

    return annotate(docs, _parse_datatype_string(RESULT), lambda batch, _: _per_batch(batch, column, least))
