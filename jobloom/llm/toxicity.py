"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of its pairs of neighbours and of its pairs with
one word between, in 2**`bits` slots. FTRL-proximal has a learning rate for each coordinate and an L1 term
that leaves most weights at exactly zero; the others are broadcast (at most 2**bits of 12 bytes).

The model is fitted in one task on a bounded sample: labelled documents in the order of a hash of their ids, the
first `sample` of them (24000), and of those as many whole ones as hold `most_features` features together (64
million, 256 MB; one document at least). Ids and labels only choose and mark training rows; a score depends on the
text alone.

Defined cases: null and empty texts get the bias alone; very long texts are scored whole; a doc_id with several
labels takes the largest, one with several texts trains with the smallest text; null labels don't train; ids with
equal hashes are taken in their order; without any label every score is 0.5 and with one class only, the fit's
own. Repeated rows get equal scores. An empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.common import ALNUM, annotate, arrow_batches, crc_of_id, word_hashes, words

BITS = 20


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of every n-gram's and skip-gram's place; not yet distinct."""
    data, start, end, at = words(data, offsets, ALNUM)
    h = word_hashes(data, start, end)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    down = np.uint64(64 - bits)
    found_doc, found = [doc], [h >> down]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[:-gap] == doc[gap:]
        pair = (h[:-gap] * np.uint64(salt) + h[gap:]) * np.uint64(0x9FB21C651E98DF25)
        found.append((pair >> down)[same])
        found_doc.append(doc[:-gap][same])
    return np.concatenate(found_doc), np.concatenate(found).astype(np.int64)


def distinct(doc: np.ndarray, slot: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.int64) << bits) | slot)
    return both >> bits, both & ((1 << bits) - 1)


class Ftrl:
    def __init__(self, size: int, alpha=1.0, beta=1.0, l1=6.0, l2=0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weights(self, slots):
        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        error = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        before = self.n[slots]
        after = before + error * error
        self.z[slots] += error - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[slots] = after


def fit(docs: DataFrame, labels: DataFrame, trains, sample: int = 24_000, most_features: int = 64_000_000, bits: int = BITS, epochs: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and values of the non-zero weights, and the bias."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & trains)
    # Bounded: `sample` ids at most.
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def featured(batches):
        for b in batches:
            for i, j, data, offsets in arrow_batches(b, "text"):
                doc, slot = distinct(*features(data, offsets, bits), bits)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                packed = [slot[edge[d] : edge[d + 1]].astype(np.uint32).tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("label").cast(pa.int32())[i:j], pa.array(packed, pa.binary())], ["doc_id", "label", "slots"])

    def trained(batches):
        seen, n = [], 0
        for b in batches:
            for y, packed in zip(b.column("label").to_pylist(), b.column("slots"), strict=True):
                n += len(packed.as_buffer()) // 4
                if seen and n > most_features:
                    break  # n stays above: no later row is taken either
                seen.append((y, packed.as_py()))  # a copy, so that the batch can go
        size = 1 << bits
        model = Ftrl(size)
        for _ in range(epochs):
            for y, packed in seen:
                model.learn(np.append(np.frombuffer(packed, np.uint32), np.uint32(size)).astype(np.int64), int(y))
        w = model.weights(np.arange(size + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["slot", "weight"])

    # The order of training rows is fixed, so a retried task learns the same weights.
    one = rows.mapInArrow(featured, "doc_id long, label int, slots binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = one.mapInArrow(trained, "slot long, weight double").toArrow()
    slot, weight = got.column("slot").to_numpy(), got.column("weight").to_numpy()
    is_bias = slot == 1 << bits
    return slot[~is_bias], weight[~is_bias], float(weight[is_bias].sum())


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> tuple[DataFrame, str]:
    """docs with a struct column (score); returns its name too."""
    shared = spark.sparkContext.broadcast(model)

    def start():
        slot, weight, bias = shared.value
        table = np.zeros(1 << bits)
        table[slot] = weight
        return table, bias

    def per_batch(batch, state):
        table, bias = state
        out = np.empty(batch.num_rows)
        for i, j, data, offsets in arrow_batches(batch, "text"):
            doc, slot = features(data, offsets, bits)
            used = table[slot] != 0
            doc, slot = distinct(doc[used], slot[used], bits)
            out[i:j] = bias + np.bincount(doc, table[slot], minlength=j - i)
        return pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))), pa.float64())], ["score"])

    return annotate(docs, T._parse_datatype_string("struct<score: double>"), per_batch, start)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> tuple[DataFrame, str]:
    return score(spark, docs, fit(docs, labels, crc_of_id() % folds != held_out))
