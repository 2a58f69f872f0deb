"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each, rows are sorted by their index on the
Hilbert curve through that grid, and the order is cut into runs of equal numbers of rows (law `rows`).
Neighbours on the curve are near each other in every dimension, so a shard covers narrow ranges of all of
them and readers can skip whole files.

A dimension is quantised by a dictionary of its values: values in their order, each in the cell in which the rows
before it end when all rows are cut into cells of equal numbers. So cells hold neighbouring values and about equal
numbers of rows, and a value with many rows has cells of its own. The dictionary comes from a count of each value,
summed up by ranges, and is joined back; it may have any size.

All rows of one text take the metadata of the copy with the smallest doc_id, so copies are neighbours.
Ranks come from a range partitioning and the partitions' row counts; only one count per partition reaches
the driver. Ties are broken by the text's crc32 and hash, doc_id and the other columns, so any group can be
cut and no task holds one whole.

Defined cases: null texts have size 1 and crc32 of an empty text; null metadata counts as the empty string, the
first of all values; very long texts only count by their size; repeated rows get their own slots; an empty table
gives no rows; columns besides doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.common import stored


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of cells (rows x dimensions, each below 2**bits) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations of the larger cubes
        low = bit - 1
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve(columns: list, bits: int):
    @F.pandas_udf(T.LongType())
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    return index(*columns)


def _ranked(spark: SparkSession, rows: DataFrame, order: list, name: str) -> tuple[DataFrame, DataFrame, int]:
    """rows sorted by order and stored, with part and row (number in it); (part, base: weight of the parts before),
    where weight is the column w if there is one, else 1 a row; and the whole weight. One row a partition reaches
    the driver and is broadcast."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    weighted = "w" in rows.columns

    def numbered(batches):
        part, n, weight = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            w = b.column("w").to_numpy() if weighted else np.ones(b.num_rows, np.int64)
            before = weight + np.cumsum(w) - w
            yield b.append_column("part", pa.array(np.full(b.num_rows, part), pa.int32())).append_column("row", pa.array(before, pa.int64()))
            n, weight = n + b.num_rows, weight + int(w.sum())

    kept = stored(spark, ranged.mapInArrow(numbered, T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType())])), name)
    sums = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.sum("w" if weighted else F.lit(1)).alias("n")).collect())
    total, bases = 0, []
    for part, n in sums:
        bases.append((part, total))
        total += n
    return kept, spark.createDataFrame(bases, "part int, base long"), total


def dictionary(spark: SparkSession, rows: DataFrame, column: str, bits: int) -> DataFrame:
    """column and cell (below 2**bits) of every value of a column without nulls."""
    counted = rows.groupBy(column).agg(F.count("*").alias("w"))
    kept, bases, total = _ranked(spark, counted, [column], f"sharding-{column}")
    cell = F.floor((F.col("base") + F.col("row")) * (1 << bits) / max(total, 1))
    return kept.join(F.broadcast(bases), "part").select(column, cell.cast("long").alias(f"{column}_cell"))


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8, bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, curve_index, shard and slot of every row of docs (doc_id, text, lang, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
    )
    # Several steps read these few columns; the texts are read once.
    rows = stored(spark, rows, "sharding-rows")
    same = ["text_hash", "text_crc32", "size"]
    first = rows.groupBy(same).agg(F.min(F.struct("doc_id", "lang", "source")).alias("first"))
    placed = rows.join(stored(spark, first.select(*same, F.col("first.lang").alias("first_lang"), F.col("first.source").alias("first_source")), "sharding-first"), same)
    # Sizes are quantised by their logarithm, in steps of a twentieth, then like the others.
    placed = placed.withColumn("step", F.floor(F.log2("size") * 20).cast("long"))
    for column in ("step", "first_lang", "first_source"):
        placed = placed.join(dictionary(spark, placed, column, bits), column)
    placed = placed.withColumn("curve_index", curve([F.col(f"{c}_cell") for c in ("step", "first_lang", "first_source")], bits))
    # One shuffle by ranges of the whole order, kept as files so that all readings see the same rows.
    order = ["curve_index", "text_crc32", "text_hash", F.col("doc_id").asc_nulls_first(), "lang", "source"]
    kept, bases, total = _ranked(spark, placed.select("doc_id", "size", "text_crc32", "text_hash", "lang", "source", "curve_index"), order, "sharding-order")
    based = kept.join(F.broadcast(bases), "part")
    rank = F.col("base") + F.col("row")
    # Shard s begins at the rank floor(s * total / shards).
    number = F.lit(0)
    start = F.lit(0).cast("long")
    for s in range(1, shards):
        cut = s * total // shards
        number = F.when(rank >= cut, s).otherwise(number)
        start = F.when(rank >= cut, F.lit(cut).cast("long")).otherwise(start)
    return based.select("doc_id", "size", "text_crc32", "curve_index", number.cast("int").alias("shard"), (rank - start).cast("long").alias("slot"))
