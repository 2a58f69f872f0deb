"""What several corpus operators share: table access, row keys, stored intermediate tables and
word or byte hashing over whole Arrow buffers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Arrow batches are bounded by bytes as well, since single texts can be long.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back: the lineage is cut and
    the result survives the loss of executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One process, as in tests: any folder is shared.
        folder = f"/tmp/jobloom-checkpoints/{spark.sparkContext.applicationId}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing reads any more: what was made from them is stored itself."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key() -> tuple[Column, Column]:
    """id (doc_id; null: the smallest number) and rk (64-bit hash of doc_id and text). Rows that agree in both are
    taken for one row: they agree in doc_id and, but for an accident of a 64-bit hash within one doc_id, in text."""
    doc = F.col("doc_id").cast("long")
    return F.coalesce(doc, F.lit(-(1 << 63))), F.xxhash64(doc, F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the row's key: id and rk. Rows that agree in doc_id and text share it; they
    get equal results. Other columns are dropped, so their names cannot clash."""
    id_, rk = row_key()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), id_.alias("id"), rk.alias("rk"))


def crc_of_id(col="doc_id"):
    """crc32 of doc_id written as text; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    at = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[at[0] : at[-1]] if raw[2] is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes; a longer single text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 result bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        x = np.full(size, base, np.uint64)
        x[0] = 1
        _powers[key] = np.multiply.accumulate(x)
    return _powers[key]


class Hashes:
    """Hash of any range of a buffer in constant time: sums of symbol values times powers of an odd number
    modulo 2**64, shifted to a common exponent and finalised. Symbols are bytes, or 64-bit hashes as they are."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.inverse = _power(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n, np.uint64)
        values = data if data.dtype == np.uint64 else _byte_values()[data]
        np.cumsum(values * _power(_BASE, n)[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))

    def windows(self, k: int) -> np.ndarray:
        """of() for every range of k symbols."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def _lower(not_word: bytes) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.ones(256, bool)
    word[list(not_word)] = False
    return lower, word


#: Words are runs of anything but white space, with only A-Z lower-cased.
SPACED = _lower(WHITESPACE)
#: Words are runs of a-z, 0-9 and everything beyond ASCII, after A-Z is lower-cased.
ALNUM = _lower(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(data: np.ndarray, offsets: np.ndarray, kind=SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and for each text the first word's index (one more
    than texts). Words do not cross texts."""
    lower, is_word = kind
    data = lower[data]
    n = len(data)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 4 << 20) -> np.ndarray:
    """Hashes of words. Buffers longer than piece, that is single long texts, are hashed piece by piece, since
    sums and powers take 16 bytes a byte."""
    if len(data) <= piece or not len(start):
        return Hashes(data).of(start, end)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + piece, "right")))
        out[i:j] = Hashes(data[base : int(end[j - 1])]).of(start[i:j] - base, end[i:j] - base)
        i = j
    return out


def arrow_batches(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) of slices of one string column of a batch."""
    data, offsets = buffers(batch.column(column))
    for i, j in slices(offsets, most):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def trimmed(task):
    """task of mapInArrow() that gives the memory that it has freed back to the system at its end. An executor keeps
    its Python workers for later tasks, and would hold that memory beside theirs."""

    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotate(docs: DataFrame, result_type, per_batch, at_start=None) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of result_type that per_batch(batch, state) gives as an Arrow
    array; state is what at_start() gives once a task. Returns the column's name too: it clashes with
    none of docs'."""
    from pyspark.sql import types as T

    name = free_name(docs, "_result")

    def task(batches):
        state = at_start() if at_start else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, per_batch(batch, state)], [*batch.schema.names, name])

    return docs.mapInArrow(task, T.StructType([*docs.schema.fields, T.StructField(name, result_type)])), name
