"""Quality classifier: a sparse rule ensemble over document statistics.

A forest of shallow trees is grown on the statistics of labelled documents; every path from a root to a
node is a conjunctive rule. A logistic regression with an L1 penalty over the rules keeps few of them. The
kept rules are compiled into one Spark column expression over the statistics, which scores all documents.

The model is fitted on a bounded sample: the `sample` labelled documents (default 20000) with the smallest
hash of their ids. Statistics of whole texts are computed in numpy over Arrow buffers.

Defined cases: null and empty texts have zero statistics and get a score from them; very long texts are counted
whole; several labels of a doc_id count as the largest, several texts as the smallest; null labels don't train;
ids with equal hashes are taken in their order; with fewer than two classes every score is the label's share, 1
without labels (nothing is rejected unseen). Repeated rows get equal scores. An empty table gives no rows; other
columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.common import SPACED, annotate, arrow_batches, crc_of_id, stored, word_hashes, words

STATISTICS = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "symbol", "exclaim", "high", "same_next", "distinct", "same_second", "lines", "line_again", "longest_word", "loud_words"]


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)  # 0: lower-case ASCII and the rest
    out[65:91] = 1
    out[48:58] = 2
    out[[ord(c) for c in ".,;:'\"-()?!"]] = 3
    out[[ord(c) for c in "#$%&*@^~|<>{}[]\\/=+_`"]] = 4
    out[[*range(9), *range(14, 32)]] = 5
    out[128:] = 6
    out[[ord("!")]] = 7
    return out


_CLASS = _classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x STATISTICS."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(doc_of * 8 + _CLASS[data], minlength=8 * n)[: 8 * n].reshape(n, 8).astype(float)
    lowered, start, end, at = words(data, offsets, SPACED)
    h = word_hashes(lowered, start, end)
    doc = np.repeat(np.arange(n), np.diff(at))
    n_words = np.diff(at).astype(float)
    some = np.maximum(n_words, 1)
    bytes_ = np.maximum(size, 1)
    length = end - start
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    first_upper = (data[start] >= 65) & (data[start] <= 90)
    last = data[end - 1] if len(end) else data[:0]
    loud = first_upper & (length > 1) & (((last >= 65) & (last <= 90)) | (last == 33))

    def share(gap):
        if len(h) <= gap:
            return np.zeros(n)
        same = (h[:-gap] == h[gap:]) & (doc[:-gap] == doc[gap:])
        return np.bincount(doc[:-gap][same], minlength=n) / some

    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n) / some
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1][size > 0], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    line_doc = doc_of[line_start] if len(data) else np.zeros(0, np.int64)
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_doc + 1])
    line = word_hashes(lowered, line_start, line_end)
    n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    pair = np.unique(np.stack([line_doc.astype(np.uint64), line]), axis=1)[0].astype(np.int64) if len(line) else np.zeros(0, np.int64)
    again = 1 - np.bincount(pair, minlength=n) / n_lines
    again[size == 0] = 0
    columns = [
        np.log1p(size), np.log1p(n_words), length_mean(doc, length, n, some), count[:, 1] / bytes_, count[:, 2] / bytes_, (count[:, 3] + count[:, 7]) / bytes_, count[:, 4] / bytes_,
        count[:, 7] / bytes_, count[:, 6] / bytes_, share(1), distinct, share(2), n_lines / some, again, longest, np.bincount(doc, loud, minlength=n) / some,
    ]
    return np.stack(columns, axis=1)


def length_mean(doc: np.ndarray, length: np.ndarray, n: int, some: np.ndarray) -> np.ndarray:
    return np.bincount(doc, length, minlength=n) / some


def with_statistics(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a struct column of statistics; returns its name too."""

    def per_batch(batch, _):
        got = [statistics(data, offsets) for _, _, data, offsets in arrow_batches(batch, "text")]
        table = np.concatenate(got) if got else np.zeros((0, len(STATISTICS)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATISTICS))], STATISTICS)

    return annotate(docs, T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]), per_batch)


Rule = tuple[tuple[str, bool, float], ...]  # statistic, whether at most, threshold


def tree_rules(forest) -> list[Rule]:
    """The path to every node but the roots, as a rule; each once."""
    found: set[Rule] = set()

    def walk(node, path: tuple) -> None:
        if path:
            # Of several bounds of one kind on a statistic the tightest holds.
            tight: dict[tuple[str, bool], float] = {}
            for name, most, t in path:
                tight[name, most] = (min if most else max)(t, tight.get((name, most), t))
            found.add(tuple(sorted((name, most, t) for (name, most), t in tight.items())))
        if node.numDescendants() > 0:
            name, t = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
            walk(node.leftChild(), (*path, (name, True, t)))
            walk(node.rightChild(), (*path, (name, False, t)))

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), ())
    return sorted(found)


def rule_column(rule: Rule, at: str = "") -> Column:
    out = F.lit(True)
    for name, most, t in rule:
        out = out & ((F.col(f"{at}{name}") <= t) if most else (F.col(f"{at}{name}") > t))
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, trains, sample: int = 20_000, trees: int = 24, depth: int = 3, penalty: float = 0.001) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with non-zero weights, and the intercept."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & trains)
    # Bounded: `sample` ids at most.
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    counted, name = with_statistics(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    train = stored(spark, counted.select("doc_id", "label", f"{name}.*"), "quality-sample").coalesce(4).cache()
    n, ones = train.agg(F.count("*"), F.sum("label")).collect()[0]
    if not n or ones in (0, n):
        train.unpersist()
        share = (ones or 0) / n if n else 1.0
        return [], float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="statistics").transform(train)
    forest = RandomForestClassifier(featuresCol="statistics", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.4", seed=7).fit(vectors)
    rules = tree_rules(forest)
    fired = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(train.select("label", *[rule_column(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)]))
    lasso = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(fired)
    train.unpersist()
    return [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6], float(lasso.intercept)


def score_column(model: tuple[list[tuple[Rule, float]], float], at: str) -> Column:
    total = F.lit(model[1])
    for rule, weight in model[0]:
        total = total + F.when(rule_column(rule, at), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[DataFrame, Column, str]:
    """docs with a struct column of statistics, the column expression of the score, the struct's name."""
    model = fit(spark, docs, labels, crc_of_id() % folds != held_out)
    counted, name = with_statistics(docs)
    return counted, score_column(model, f"{name}."), name


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """docs whose score reaches least."""
    counted, score, name = score_quality(spark, docs, labels)
    return counted.where(score >= least).drop(name)
