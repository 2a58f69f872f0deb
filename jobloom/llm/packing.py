"""Packing of tokenised documents into fixed windows by sum-of-squares online packing.

Every task packs the documents of its own partition. A document's whole windows are cut off first; its rest goes
to the fill level that makes the sum, over all levels, of the squared number of windows partly filled to that level
smallest (ties: the fuller level; a new window counts as level 0). A level array holds those numbers. The rule keeps
few windows open, 550 to 620 however many documents a task has. What lies in them at a task's end is handed, packed, to
a second round of fewer tasks (`second_tokens` ids each), which place it by the same rule; that is all that is
shuffled. Only at the end of the second round the emptiest open windows are dissolved into the gaps of the fullest,
which cuts their pieces (column dissolved); so at most one window of a task of the second round is padded.

`most_open` (4096 windows, 32 MB of ids) bounds memory for inputs on which the rule would do worse: beyond it the
emptier half of the open windows goes to the second round early, or is dissolved there.

Defined cases: a null or empty text is its end id alone; the string of an added token of the vocabulary is that
token; very long texts are tokenised whole, in as many windows as they fill; repeated rows are packed one by one;
an empty table gives no pieces; other columns are ignored. A retried task gives the same pieces, since the order
within a file's split is fixed. sequence_id is the partition's number (in the second
round plus 2**29) times 2**33 plus a number in the partition.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import stored

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, dissolved boolean"
#: Fixed: the pre-tokenisation pattern of the vocabulary, in the form without backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict[str, object] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the other
    bytes are numbered on from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def encoder(path: str):
    """The byte-level BPE of a vocabulary in JSON: in such a file a token's id is its merge's rank. Added tokens
    are found in texts as the tokenizers library finds them."""
    import tiktoken

    if path not in _encoders:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): rank for token, rank in given["model"]["vocab"].items()}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in given["added_tokens"]})
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Packer:
    """Pieces are (document, start, ids, the document's ids, dissolved). left: what was handed on, if a second round
    takes it; else None."""

    def __init__(self, window: int, first_id: int, most_open: int, hand_on: bool = False):
        self.window, self.most_open = window, most_open
        self.left: list[tuple] | None = [] if hand_on else None
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open, self.next = 0, first_id
        self.done: list[tuple] = []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for at in range(0, n - n % w, w):
            self.done.append(((doc, at, ids[at : at + w], n, False), self._new(), 0))
        if rest := n % w:
            self.place((doc, n - rest, ids[n - rest :], n, False), rest)

    def place(self, piece: tuple, size: int) -> None:
        w, level = self.window, self.level
        before = level[1 : w - size + 1]
        cost = 1 - 2 * before + 2 * level[size + 1 : w + 1] + 1
        if len(cost):
            cost[-1] = 1 - 2 * before[-1]  # full windows are not counted
            cost[before == 0] = 4 * self.most_open + 9
        h = 0
        if len(cost):
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if before[k] and cost[k] <= 2 * level[size] + 1:
                h = k + 1
        if h:
            sequence = self.open[h].pop()
            level[h] -= 1
            self.n_open -= 1
        else:
            sequence = [self._new()]
        sequence.append(piece)
        if h + size == w:
            self._close(sequence)
        else:
            self.open[h + size].append(sequence)
            level[h + size] += 1
            self.n_open += 1
            if self.n_open > self.most_open:
                self.hand_on(self.most_open // 2) if self.left is not None else self.dissolve(self.most_open // 2)

    def _close(self, sequence: list) -> None:
        offset = 0
        for piece in sequence[1:]:
            self.done.append((piece, sequence[0], offset))
            offset += len(piece[2])

    def hand_on(self, keep: int) -> None:
        """Leave the pieces of open windows, the emptiest first, to the second round until keep are open."""
        for h in range(1, self.window):
            while self.open[h] and self.n_open > keep:
                self.left += self.open[h].pop()[1:]
                self.level[h] -= 1
                self.n_open -= 1

    def dissolve(self, keep: int) -> None:
        """Fill the fullest open windows from the emptiest ones until keep are open; with keep 0 until one is."""
        left = [(h, s) for h in range(1, self.window) for s in self.open[h]]
        low, high = 0, len(left) - 1
        loose: list[tuple] = []
        while (high > low or (high == low and loose)) and high - low + 1 > keep:
            fill, sequence = left[high]
            gap = self.window - fill
            while gap and (loose or high > low):
                if not loose:
                    loose = left[low][1][:0:-1]
                    low += 1
                doc, start, ids, n, _ = loose.pop()
                take = min(gap, len(ids))
                sequence.append((doc, start, ids[:take], n, True))
                gap -= take
                if take < len(ids):
                    loose.append((doc, start + take, ids[take:], n, True))
            if gap:
                left[high] = (self.window - gap, sequence)
                break
            self._close(sequence)
            high -= 1
        rest = left[low : high + 1]
        if loose:
            sequence = [self._new(), *loose[::-1]]
            rest.append((sum(len(x[2]) for x in loose), sequence))
        self.open = [[] for _ in range(self.window)]
        self.level[:] = 0
        for h, s in rest:
            self.open[h].append(s)
            self.level[h] += 1
        self.n_open = len(rest)

    def finish(self) -> None:
        if self.left is not None:
            self.hand_on(0)
            return
        self.dissolve(0)
        for at in self.open:
            for s in at:
                self._close(s)

    def take(self) -> list[tuple]:
        """(piece, sequence, offset) of closed windows; pieces handed on have neither."""
        out, self.done = self.done, []
        if self.left:
            out += [(piece, None, None) for piece in self.left]
            self.left = []
        return out


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, most_open: int = 4096, second_tokens: int = 16 << 20) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and whether it came there because an open
    window was dissolved; with_ids adds its ids."""
    vocabulary = vocabulary or default_vocabulary()
    schema = f"{SCHEMA}, part int, place long, ids binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(taken: list[tuple], part: int, place: int) -> pa.RecordBatch:
        pieces = [x[0] for x in taken]
        ids = [np.ascontiguousarray(p[2], "<u4") for p in pieces]
        columns = [
            pa.array([p[0] for p in pieces], pa.int64()),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([len(p[2]) for p in pieces], pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array([p[3] for p in pieces], pa.int64()),
            pa.array([x[1] for x in taken], pa.int64()),
            pa.array([x[2] for x in taken], pa.int64()),
            pa.array([p[4] for p in pieces], pa.bool_()),
            pa.array([part] * len(pieces), pa.int32()),
            pa.array(range(place, place + len(pieces)), pa.int64()),
            pa.array([x.tobytes() if with_ids or t[1] is None else None for x, t in zip(ids, taken, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def first_round(batches):
        encode = encoder(vocabulary).encode
        part, place = TaskContext.get().partitionId(), 0
        packer = Packer(window, part << 33, most_open, hand_on=True)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "", allowed_special="all")
                ids.append(end_id)
                packer.add(doc, np.array(ids, np.uint32))
                if len(packer.done) > 5000:
                    taken = packer.take()
                    yield rows(taken, part, place)
                    place += len(taken)
        packer.finish()
        yield rows(packer.take(), part, place)

    def second_round(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(window, (part + (1 << 29)) << 33, most_open)
        for batch in batches:
            for doc, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                own = np.frombuffer(ids, "<u4")
                packer.place((doc, start, own, n, False), len(own))
            if len(packer.done) > 5000:
                yield rows(packer.take(), part, 0)
        packer.finish()
        yield rows(packer.take(), part, 0)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stored(docs.sparkSession, plain.mapInArrow(first_round, schema), "packed")
    left = first.where("sequence_id is null")
    tasks = max(1, -(-(left.agg(F.sum("length")).first()[0] or 0) // second_tokens))
    second = left.repartition(tasks, "part").sortWithinPartitions("part", "place").mapInArrow(second_round, schema)
    out = first.where("sequence_id is not null").unionByName(second).drop("part", "place")
    if not with_ids:
        return out.drop("ids")
    unpacked = F.pandas_udf(lambda x: x.map(lambda b: np.frombuffer(b, "<i4")), "array<int>")
    return out.withColumn("ids", unpacked("ids"))
