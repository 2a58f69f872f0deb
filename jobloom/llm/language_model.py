"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Training texts give exact word counts and bigram counts. A bigram of count c is quantised to the level
1 + floor(log2 c) and entered once for each level up to it. A reader probes level 1, 2, ... until a probe
misses; the last hit gives the count. The probability of a word after another is the bigram's count smoothed
with the word's own probability: (count + MU * p(word)) / (follow + MU), where follow is the sum of the quantised
counts of all words after the first one, so that the probabilities of all words add up to 1 (but for false hits).

Counts are gathered from all training texts: each task sums its batch before the shuffle, bigrams are dealt
by hash to segments, packed, and every segment builds its own part of the filter. The filter takes about
10 bits a distinct bigram and the word table 24 bytes a word (hash, count, follow). They are broadcast if they are within
`most_bytes` (the driver fills the broadcast's arrays segment by segment, so it holds them once); beyond it batches
of texts ask the segments' filters and word tables for the same counts by shuffles (`_score_by_exchange`), with
equal results.

Tokens: words between white space with A-Z lower-cased, then one end. Defined cases: null and empty texts
are the end alone; very long texts are counted and scored whole; without training rows N and V are 0 and each
token has probability 1; repeated rows count and are scored each; a null doc_id has the crc32 of an empty text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401  pa.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.common import SPACED, annotate, arrow_batches, crc_of_id, keyed, mix, released, stored, word_hashes, words

END, BEGIN = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
BITS, PROBES, MU = 9, 4, 20.0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text by text, and each text's first token (one more than texts)."""
    data, start, end, at = words(data, offsets, SPACED)
    h = word_hashes(data, start, end)
    n = len(at) - 1
    out = np.full(len(h) + n, END)
    doc = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(h)) + doc] = h
    return out, at + np.arange(n + 1)


def bigrams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token (BEGIN for a text's first), and the hash of the two."""
    before = np.concatenate(([BEGIN], h[:-1])) if len(h) else h
    before[at[:-1]] = BEGIN
    return before, mix(before * _A + h * _B)


def _segment(pair: np.ndarray, segments: int) -> np.ndarray:
    return (pair >> np.uint64(40)) % np.uint64(segments)


def level_of(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(float))[1]  # 1 + floor(log2)


def count_at(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 1 at level 1, 0 at 0."""
    return np.where(level > 1, 3 * (np.int64(1) << np.maximum(level, 2).astype(np.int64)) // 4, level).astype(np.int64)


def _top(word: np.ndarray) -> np.ndarray:
    """The upper half of a word's hash, which tells its segment too. Words that share it share their follow sums."""
    return (word >> np.uint64(32)).astype(np.uint32)


def _slots(short: np.ndarray, level: int, size) -> list[np.ndarray]:
    g = mix(short.astype(np.uint64) * _A + np.array([level], np.uint64) * _B)
    low, high = g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)
    return [(low + np.uint64(i) * high) % size for i in range(PROBES)]


def filter_of(short: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits (packed, little end first) of one segment: distinct 32-bit remainders and their counts."""
    level = level_of(count)
    size = max(64, -(-int(level.sum()) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        for slot in _slots(short[level >= k], k, np.uint64(size)):
            bits[slot.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    def __init__(self, parts: dict[int, bytes], segments: int):
        self._lay_out({s: len(p) for s, p in parts.items()}, segments)
        for s, p in parts.items():
            self.put(s, p)

    def _lay_out(self, lengths: dict[int, int], segments: int) -> None:
        self.size = np.array([lengths.get(s, 8) * 8 for s in range(segments)], np.uint64)
        self.base = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.uint64)
        self.bits, self.segments = np.zeros(int(self.size.sum()) // 8, np.uint8), segments

    @classmethod
    def empty(cls, lengths: dict[int, int], segments: int) -> Filter:
        """Room for parts of these lengths, to be put one by one."""
        out = cls.__new__(cls)
        out._lay_out(lengths, segments)
        return out

    def put(self, segment: int, part: bytes) -> None:
        at = int(self.base[segment]) // 8
        self.bits[at : at + len(part)] = np.frombuffer(part, np.uint8)

    def level(self, pair: np.ndarray) -> np.ndarray:
        part = _segment(pair, self.segments).astype(np.int64)
        return self._probe(pair & np.uint64(0xFFFFFFFF), self.size[part], self.base[part])

    def level_of_short(self, short: np.ndarray, segment: int) -> np.ndarray:
        """Levels of remainders of one segment."""
        same = lambda x: np.full(len(short), x[segment])
        return self._probe(short.astype(np.uint64), same(self.size), same(self.base))

    def _probe(self, short: np.ndarray, size: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Level after level until a probe misses."""
        out = np.zeros(len(short), np.int64)
        going = np.arange(len(short))
        k = 1
        while len(going):
            hit = going
            for i in range(PROBES):
                g = mix(short[hit] * _A + np.array([k], np.uint64) * _B)
                slot = ((g & np.uint64(0xFFFFFFFF)) + np.uint64(i) * ((g >> np.uint64(32)) | np.uint64(1))) % size[hit] + base[hit]
                hit = hit[(self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[hit] = k
            going = hit
            k += 1
        return out


def _pairs(short: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """Remainders, first words and counts in one buffer; a count over 255 is split into several entries."""
    times = np.maximum(1, -(-count // 255))
    last = count - 255 * (times - 1)
    short, first, value = np.repeat(short, times), np.repeat(first, times), np.full(int(times.sum()), 255, np.uint8)
    value[np.cumsum(times) - 1] = last
    return short.astype(np.uint32).tobytes() + first.tobytes() + value.tobytes()


def gather(train: DataFrame, segments: int) -> DataFrame:
    """Packed counts of every batch: words (segment, 64-bit hashes, counts) and bigrams."""

    def task(batches):
        for b in batches:
            parts = [tokens(data, offsets) for _, _, data, offsets in arrow_batches(b, "text")]
            if not parts:
                continue
            before, pair = (np.concatenate(x) for x in zip(*[bigrams(h, at) for h, at in parts], strict=True))
            word, n_word = np.unique(np.concatenate([h for h, _ in parts]), return_counts=True)
            pair, place, n_pair = np.unique(pair, return_index=True, return_counts=True)
            first = _top(before[place])
            own_w, own_p = _segment(word, segments).astype(np.int64), _segment(pair, segments).astype(np.int64)
            order_w, order_p = np.argsort(own_w, kind="stable"), np.argsort(own_p, kind="stable")
            at_w, at_p = (np.searchsorted(own[order], np.arange(segments + 1)) for own, order in ((own_w, order_w), (own_p, order_p)))
            rows: list[tuple] = []
            for s in range(segments):
                w, p = order_w[at_w[s] : at_w[s + 1]], order_p[at_p[s] : at_p[s + 1]]
                rows.append((s, word[w].tobytes(), n_word[w].astype(np.uint32).tobytes(), _pairs(pair[p], first[p], n_pair[p])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)]], ["segment", "words", "counts", "pairs"])

    return train.select("text").mapInArrow(task, "segment int, words binary, counts binary, pairs binary")


def _sum(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, the sums of their counts, and of other columns the first value of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts[order].astype(np.int64), edge) if len(edge) else np.zeros(0, np.int64), *(x[order][edge] for x in more)


def segment_tables(packed: DataFrame, partitions: int) -> DataFrame:
    """One row a segment: its words with counts, summed, its part of the filter, and of its bigrams the quantised
    counts summed by first word."""

    def task(batches):
        def row(segment, held):
            word, n_word = _sum(np.concatenate([np.frombuffer(h[0], np.uint64) for h in held]), np.concatenate([np.frombuffer(h[1], np.uint32) for h in held]))
            pairs = [h[2] for h in held]
            short, first = (np.concatenate([np.frombuffer(p, np.uint32, len(p) // 9, len(p) // 9 * 4 * k) if len(p) else np.zeros(0, np.uint32) for p in pairs]) for k in (0, 1))
            value = np.concatenate([np.frombuffer(p, np.uint8, -1, len(p) // 9 * 8) if len(p) else np.zeros(0, np.uint8) for p in pairs])
            short, count, first = _sum(short, value, first)
            first, follow = _sum(first, count_at(level_of(count)))
            columns = [pa.array([segment], pa.int32()), pa.array([len(word)], pa.int64()), pa.array([int(n_word.sum())], pa.int64())]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (word, n_word.astype(np.int64), filter_of(short, count), first, follow)]
            return pa.RecordBatch.from_arrays(columns, ["segment", "n_words", "n_tokens", "words", "counts", "bits", "firsts", "sums"])

        held, last = [], None
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("segment", "words", "counts", "pairs")], strict=True):
                if last is not None and r[0] != last:
                    yield row(last, held)
                    held = []
                last = r[0]
                held.append(r[1:])
        if held:
            yield row(last, held)

    return packed.repartition(partitions, "segment").sortWithinPartitions("segment").mapInArrow(task, "segment int, n_words long, n_tokens long, words binary, counts binary, bits binary, firsts binary, sums binary")


def with_follows(tables: DataFrame, segments: int) -> DataFrame:
    """tables with follows, the follow sum of each word, and begin, that of BEGIN in its segment's row. The sums by
    first word are dealt to the segments of these words, and meet their tables there."""
    names = ["segment", "firsts", "sums"]

    def deal(batches):
        for b in batches:
            for firsts, sums in zip(b.column("firsts").to_pylist(), b.column("sums").to_pylist(), strict=True):
                first, follow = np.frombuffer(firsts, np.uint32), np.frombuffer(sums, np.int64)
                own = (first >> 8) % segments  # the segment of the word, from the upper half of its hash
                yield pa.RecordBatch.from_arrays([pa.array(range(segments), pa.int32()), *[pa.array([x[own == s].tobytes() for s in range(segments)], pa.binary()) for x in (first, follow)]], names)

    def meet(batches):
        held: list[tuple[bytes, bytes]] = []
        last = None
        for b in batches:
            for r in b.to_pylist():
                if r["segment"] != last:
                    held, last = [], r["segment"]
                if r["words"] is None:  # sums come before the segment's own row
                    held.append((r["firsts"], r["sums"]))
                    continue
                first, follow = _sum(*(np.concatenate([np.frombuffer(x[k], kind) for x in held]) if held else np.zeros(0, kind) for k, kind in ((0, np.uint32), (1, np.int64))))
                own = np.frombuffer(r["words"], np.uint64)
                begin = _counts(first, follow, _top(np.array([BEGIN])))[0] if _segment(np.array([BEGIN]), segments)[0] == last else None
                columns = {"segment": [last], "n_words": [r["n_words"]], "n_tokens": [r["n_tokens"]], "words": [r["words"]], "counts": [r["counts"]], "follows": [_counts(first, follow, _top(own)).tobytes()], "bits": [r["bits"]], "begin": [begin]}
                yield pa.RecordBatch.from_pydict(columns, schema=out)

    out = pa.schema([("segment", pa.int32()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("follows", pa.binary()), ("bits", pa.binary()), ("begin", pa.int64())])
    dealt = tables.select("firsts", "sums").mapInArrow(deal, "segment int, firsts binary, sums binary")
    both = tables.drop("firsts", "sums").unionByName(dealt, allowMissingColumns=True).repartition(segments, "segment")
    return both.sortWithinPartitions("segment", F.col("words").isNotNull()).mapInArrow(meet, "segment int, n_words long, n_tokens long, words binary, counts binary, follows binary, bits binary, begin long")


RESULT = "struct<n_tokens: long, n_known: long, base_score: double, score: double>"


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at[:-1]) if len(at) > 1 else np.zeros(0)  # each text has a token


def _scores(at: np.ndarray, c: np.ndarray, follow: np.ndarray, level: np.ndarray, n: int, v: int, begin: int) -> np.ndarray:
    """RESULT's fields of texts whose tokens have counts c, follow sums and bigram levels; begin: the follow sum of a
    text's beginning."""
    before = np.concatenate(([0], follow[:-1]))
    before[at[:-1]] = begin
    p = (c + 1) / (n + v + 1)
    smooth = np.minimum((count_at(level) + MU * p) / (before + MU), 1.0)  # a false hit may pass its first word's sum
    return np.stack([np.diff(at), _sums((c > 0).astype(float), at), _sums(np.log10(p), at), _sums(np.log10(smooth), at)])


def _result(parts: list[np.ndarray]) -> list[pa.Array]:
    got = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0))
    return [pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(got[2]), pa.array(got[3])]


FIELDS = ["n_tokens", "n_known", "base_score", "score"]


def _counts(word: np.ndarray, count: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of wanted words in the sorted table word."""
    if not len(word):
        return np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(word, wanted), len(word) - 1)
    return np.where(word[place] == wanted, count[place], 0).astype(np.int64)


def _per_batch(batch: pa.RecordBatch, state) -> pa.Array:
    word, count, follow, filter_, n, v, begin = state
    out = []
    for _, _, data, offsets in arrow_batches(batch, "text"):
        h, at = tokens(data, offsets)
        distinct, inverse = np.unique(h, return_inverse=True)
        out.append(_scores(at, _counts(word, count, distinct)[inverse], _counts(word, follow, distinct)[inverse], filter_.level(bigrams(h, at)[1]), n, v, begin))
    return pa.StructArray.from_arrays(_result(out), FIELDS)


def _batch_words(batch: pa.RecordBatch):
    """A batch's tokens by slice, its distinct words and bigrams, and a key of its content."""
    parts = [tokens(data, offsets) for _, _, data, offsets in arrow_batches(batch, "text")]
    word = np.unique(np.concatenate([h for h, _ in parts]))
    pair = np.unique(np.concatenate([bigrams(h, at)[1] for h, at in parts]))
    key = hashlib.blake2b(batch.column("rk").to_numpy(zero_copy_only=False).tobytes(), digest_size=8).digest()
    return parts, word, pair, int.from_bytes(key, "little", signed=True)


_ASKED = "batch long, segment int, words binary, pairs binary, bits binary"
_ASKED_NAMES = ["batch", "segment", "words", "pairs", "bits"]


def _score_by_exchange(docs: DataFrame, tables: DataFrame, segments: int, n: int, v: int, begin: int) -> DataFrame:
    """doc_id, rk and the result's fields without any broadcast. Every batch of texts asks each segment for its
    distinct words and bigrams, packed; the segment's task answers with counts and levels; the answers meet the
    batch's texts again. A frequent word is asked for once a batch, so no segment is hot."""

    def rows(batch, segment, *binary):
        size = len(segment)
        return pa.RecordBatch.from_arrays([pa.array([batch] * size, pa.int64()), pa.array(segment, pa.int32()), *[pa.array(x if x is not None else [None] * size, pa.binary()) for x in binary]], _ASKED_NAMES)

    def ask(batches):
        for b in batches:
            if b.num_rows:
                _, word, pair, key = _batch_words(b)
                own_w, own_p = _segment(word, segments), _segment(pair, segments)
                words = [word[own_w == s].tobytes() for s in range(segments)]
                yield rows(key, range(segments), words, [pair[own_p == s].astype(np.uint32).tobytes() for s in range(segments)], None)

    def carry(batches):
        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b)
                yield rows(_batch_words(b)[3], [-1], [sink.getvalue().to_pybytes()], None, None)

    def answer(batches):
        segment, word, count, follow, filter_ = None, None, None, None, None
        for b in batches:
            for batch, s, words, pairs, bits in zip(*[b.column(c).to_pylist() for c in _ASKED_NAMES], strict=True):
                if bits is not None:  # a segment's own table comes first
                    segment, word, filter_ = s, np.frombuffer(words, np.uint64), Filter({s: bits}, segments)
                    count, follow = np.frombuffer(pairs, np.int64).reshape(2, -1)
                    continue
                if s != segment:  # nothing was learnt in this segment
                    segment, word, count, follow, filter_ = s, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), Filter({}, segments)
                wanted = np.frombuffer(words, np.uint64)
                c = np.stack([_counts(word, count, wanted), _counts(word, follow, wanted)])
                level = filter_.level_of_short(np.frombuffer(pairs, np.uint32), s)
                yield rows(batch, [s], [c.tobytes()], [level.astype(np.uint8).tobytes()], None)

    def score(batches):
        def solve(held):
            given = {s: (w, p) for s, w, p in held if s >= 0}
            for _, packed, _ in (x for x in held if x[0] < 0):
                for b in pa.ipc.open_stream(packed):
                    parts, word, pair, _ = _batch_words(b)
                    own_w, own_p = _segment(word, segments), _segment(pair, segments)
                    c, level = np.zeros((2, len(word)), np.int64), np.zeros(len(pair), np.int64)
                    for s in range(segments):
                        c[:, own_w == s] = np.frombuffer(given[s][0], np.int64).reshape(2, -1)
                        level[own_p == s] = np.frombuffer(given[s][1], np.uint8)
                    out = [_scores(at, *c[:, np.searchsorted(word, h)], level[np.searchsorted(pair, bigrams(h, at)[1])], n, v, begin) for h, at in parts]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), *_result(out)], ["doc_id", "rk", *FIELDS])

        held, last = [], None
        for b in batches:
            for batch, *row in zip(*[b.column(c).to_pylist() for c in ("batch", "segment", "words", "pairs")], strict=True):
                if last is not None and batch != last:
                    yield from solve(held)
                    held = []
                last = batch
                held.append(row)
        if held:
            yield from solve(held)

    texts = docs.select("doc_id", "rk", "text")
    own = tables.select(F.lit(None).cast("long").alias("batch"), "segment", "words", F.concat("counts", "follows").alias("pairs"), "bits")
    asked = texts.mapInArrow(ask, _ASKED).unionByName(own)
    answers = asked.repartition(segments, "segment").sortWithinPartitions("segment", F.col("batch").asc_nulls_first()).mapInArrow(answer, _ASKED)
    met = answers.unionByName(texts.mapInArrow(carry, _ASKED)).repartition(segments, "batch").sortWithinPartitions("batch", "segment")
    return met.mapInArrow(score, "doc_id long, rk long, n_tokens long, n_known long, base_score double, score double")


def _shared_tables(spark: SparkSession, tables: DataFrame, segments: int):
    """Sorted words, their counts and follow sums, and the filter, filled from one segment at a time."""
    sizes = {r["segment"]: (r["w"], r["b"]) for r in tables.select("segment", F.col("n_words").alias("w"), F.octet_length("bits").alias("b")).collect()}
    filter_ = Filter.empty({s: b for s, (_, b) in sizes.items()}, segments)
    total = sum(w for w, _ in sizes.values())
    word, count, follow = np.empty(total, np.uint64), np.empty(total, np.int64), np.empty(total, np.int64)
    at = 0
    for r in tables.select("segment", "words", "counts", "follows", "bits").toLocalIterator():
        n = sizes[r["segment"]][0]
        word[at : at + n] = np.frombuffer(r["words"], np.uint64)
        count[at : at + n] = np.frombuffer(r["counts"], np.int64)
        follow[at : at + n] = np.frombuffer(r["follows"], np.int64)
        filter_.put(r["segment"], r["bits"])
        at += n
    order = np.argsort(word)
    word = word[order]
    # Every worker holds a copy, so counts take the fewest bytes that hold them all.
    count, follow = (x[order].astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (count, follow))
    return word, count, follow, filter_


def score_texts(spark: SparkSession, docs: DataFrame, folds: int = 7, held_out: int = 2, most_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    docs = keyed(docs)
    out = crc_of_id() % folds == held_out
    train = docs.where(~out)
    size = train.agg(F.sum(F.octet_length("text"))).collect()[0][0]
    # A segment gets the tokens of about 12 MB of text.
    segments = int(max(12, -(-(size or 0) // (12 << 20))))
    counted = stored(spark, segment_tables(gather(train, segments), segments), "model-counts")
    tables = stored(spark, with_follows(counted, segments), "model-segments")
    released(spark, counted)
    v, n, begin, held = tables.agg(F.sum("n_words"), F.sum("n_tokens"), F.max("begin"), F.sum(F.octet_length("bits") + F.lit(24) * F.col("n_words"))).collect()[0]
    v, n, begin = v or 0, n or 0, begin or 0
    if (held or 0) <= most_bytes:
        shared = spark.sparkContext.broadcast((*_shared_tables(spark, tables, segments), n, v, begin))
        df, name = annotate(docs.select("doc_id", "text"), T._parse_datatype_string(RESULT), _per_batch, lambda: shared.value)
        scored = df.select("doc_id", *[f"{name}.{f}" for f in FIELDS])
    else:
        scored = _score_by_exchange(docs, tables, segments, n, v, begin)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
