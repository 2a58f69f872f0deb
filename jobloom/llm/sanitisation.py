"""Information-theoretic sanitisation: personal data, and the terms that reveal it.

Personal data (addresses, numbers) are found by form; their values are the protected entities. A term reveals an
entity as far as it tells that the entity is there: the pointwise mutual information of both, estimated over all
documents, as a share of the entity's own information. A term is a word near an entity (`window` words to each side)
or the first letters of one. It discloses an entity when

    log2(N * n_et / (n_e * n_t)) >= share * log2(N / n_e),

with N documents, n_e that hold the entity, n_t that hold the term anywhere and n_et that hold it near the entity,
when n_et >= `support`, and when no single surrounding (the words 2 * `window` before and after) makes up more than
half of n_et: copies of one text or passage show that it was copied, not that its words belong to the entity.
Disclosing words are spans too, wherever they occur: generalised to their first letters where these disclose nothing, else removed.

All counts are over all documents. Only terms that can matter are counted: those with support near an entity, which a
bit table of fixed size (FILTER_BITS) lets through; other terms that pass are dropped by the join that follows, as
are words that the table of disclosing terms lets through. Both tables are gathered by an aggregation whose result
has a fixed bound.

Defined cases: null texts are empty and hold nothing; an empty table gives no rows; repeated rows count each and get
equal results; very long texts are taken whole; a null doc_id is a value like any other; extra columns stay in
sanitise() and never clash. Words are runs of a-z, 0-9 and all beyond ASCII, after A-Z is lower-cased, that no found
personal data overlaps; words and entities are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import ALNUM, arrow_batches, free_name, keyed, mix, row_key, stored, word_hashes, words

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
FILTER_BITS = 23
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match begins within a run of digits: where the whole run fails, so does its rest.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def personal_data(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) in code points of the personal data in text, sorted."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:  # from each @ outwards, since a search from the left would be quadratic in long words
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                floor = domain.end()
                found.append((start, 0, floor))
        at = text.find("@", max(at + 1, floor))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _entity(kind: int, value: str) -> int:
    """Hash of an entity: addresses without case, numbers by their digits."""
    value = value.lower() if kind < 2 else _NOT_DIGIT.sub("", value)
    return int.from_bytes(blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


class _Slice:
    """Words of a slice of texts outside of personal data: text, start and end in code points, hash, hash of the first
    letters (0: it has no more than these)."""

    def __init__(self, texts: list[str], spans: list, data: np.ndarray, offsets: np.ndarray, letters: int):
        self.spans = spans
        data, start, end, _ = words(data, offsets, ALNUM)
        lead = (data & 0xC0) != 0x80
        point = np.concatenate(([0], np.cumsum(lead)))
        doc = np.searchsorted(offsets, start, "right") - 1
        base = point[offsets[doc]]
        first, last = point[start] - base, point[end] - base
        clear = np.ones(len(start), bool)
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d, spans in enumerate(self.spans):
            for s, _, e in spans:
                a, b = np.searchsorted(last[edge[d] : edge[d + 1]], s, "right"), np.searchsorted(first[edge[d] : edge[d + 1]], e)
                clear[edge[d] + a : edge[d] + b] = False
        start, end = start[clear], end[clear]
        self.doc, self.first, self.last = doc[clear], first[clear], last[clear]
        self.word = word_hashes(data, start, end).view(np.int64)
        # Where the code point after the first letters begins.
        leads = np.append(np.flatnonzero(lead), len(data))
        cut = leads[np.minimum(point[start] + letters, len(leads) - 1)]
        self.letters = np.zeros(len(start), np.int64)
        long = np.flatnonzero(cut < end)
        self.letters[long] = mix(word_hashes(data, start[long], cut[long]) + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        self.edge = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def _slices(batch: pa.RecordBatch, letters: int, only_found: bool = False):
    """Slices of the batch's texts, or of those with personal data only."""
    if only_found:
        batch = batch.select(["text"]).filter(pa.array([bool(personal_data(x or "")) for x in batch.column("text").to_pylist()], pa.bool_()))
    column = batch.column("text")
    for i, j, data, offsets in arrow_batches(batch, "text"):
        texts = [x or "" for x in column.slice(i, j - i).to_pylist()]
        yield j - i, texts, _Slice(texts, [personal_data(x) for x in texts], data, offsets, letters)


def _contexts(texts: list[str], own: _Slice, window: int) -> np.ndarray:
    """Rows (entity, term, surrounding), one for each entity and term of a text; (entity, 0, 0) for the entity."""
    out = []
    for d, spans in enumerate(own.spans):
        if not spans:
            continue
        a, b = own.edge[d], own.edge[d + 1]
        first, word, letters = own.first[a:b], own.word[a:b], own.letters[a:b]
        gap = np.zeros(2 * window, np.int64)
        before, after = np.concatenate((gap, word))[: b - a].view(np.uint64), np.concatenate((word, gap))[2 * window :].view(np.uint64)
        around = mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + after).view(np.int64)
        entities: dict[int, list[np.ndarray]] = {}
        for s, kind, e in spans:
            at = int(np.searchsorted(first, s))
            entities.setdefault(_entity(kind, texts[d][s:e]), []).append(np.arange(max(0, at - window), min(b - a, at + window)))
        for entity, places in entities.items():
            near = np.unique(np.concatenate(places))
            terms = np.concatenate((word[near], letters[near]))
            which = np.unique(terms, return_index=True)[1]  # the first place of each
            terms, where = terms[which], np.tile(near, 2)[which]
            real = terms != 0
            rows = np.zeros((int(real.sum()) + 1, 3), np.int64)
            rows[:, 0] = entity
            rows[1:, 1], rows[1:, 2] = terms[real], around[where[real]]
            out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _bits(spark: SparkSession, terms: DataFrame):
    """Broadcast bit table of column t: 2 ** FILTER_BITS bits, whatever the number of terms."""
    slot = F.col("t").bitwiseAND((1 << FILTER_BITS) - 1)
    rows = terms.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(31).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(bits)


def _passes(bits: np.ndarray, t: np.ndarray) -> np.ndarray:
    slot = t & ((1 << FILTER_BITS) - 1)
    return ((bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)


def disclosing_terms(spark: SparkSession, docs: DataFrame, window: int = 8, support: int = 3, share: float = 0.9, letters: int = 3) -> DataFrame:
    """Terms (column t, a hash each) that disclose an entity of docs (column text)."""
    texts = docs.select("text")

    def contexts(batches):
        for batch in batches:
            for _, own_texts, own in _slices(batch, letters, only_found=True):
                rows = _contexts(own_texts, own, window)
                yield _table({"e": rows[:, 0], "t": rows[:, 1], "around": rows[:, 2]})

    near = texts.mapInArrow(contexts, "e long, t long, around long").groupBy("e", "t", "around").agg(F.count("*").alias("n"))
    near = near.groupBy("e", "t").agg(F.sum("n").alias("n_et"), F.max("n").alias("most"))
    near = stored(spark, near.where((F.col("t") == 0) | (F.col("n_et") >= support) & (2 * F.col("most") <= F.col("n_et"))).drop("most"), "contexts")
    pairs, entities = near.where("t <> 0"), near.where("t = 0").select("e", F.col("n_et").alias("n_e"))
    bits = _bits(spark, pairs)

    def counted(batches):
        n_docs = 0
        for batch in batches:
            n_docs += batch.num_rows
            for n, _, own in _slices(batch, letters):
                both = np.concatenate((own.word, own.letters))
                doc = np.tile(own.doc, 2)
                fits = np.flatnonzero((both != 0) & _passes(bits.value, both))
                terms, place = np.unique(both[fits], return_inverse=True)
                pairs_ = np.unique(place.astype(np.int64) * n + doc[fits])
                yield _table({"t": terms, "n": np.bincount(pairs_ // n, minlength=len(terms)).astype(np.int64)})
        yield _table({"t": np.zeros(1, np.int64), "n": np.array([n_docs], np.int64)})

    counts = stored(spark, texts.mapInArrow(counted, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t")), "counts")
    n = (counts.where("t = 0").agg(F.max("n_t")).first()[0] or 0) * 1.0
    told = F.log2(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    found = pairs.join(counts.where("t <> 0"), "t").join(entities, "e").where((F.col("n_e") < n) & (told >= share * F.log2(F.lit(n) / F.col("n_e"))))
    return stored(spark, found.select("t").distinct(), "disclosing")


FOUND = "doc_id long, id long, rk long, base array<struct<start: int, kind: int, end: int>>, maybe array<struct<t: long, letters: long, start: int, end: int>>"


def _structs(rows: list[np.ndarray], kinds: dict[str, pa.DataType]) -> pa.Array:
    """One list of structs for each element of rows, which have a column for each field."""
    edges = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    every = np.concatenate(rows) if rows else np.zeros((0, len(kinds)), np.int64)
    fields = [pa.field(n, t) for n, t in kinds.items()]
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(every[:, i].astype(t.to_pandas_dtype())) for i, t in enumerate(kinds.values())], fields=fields))


def find_private(spark: SparkSession, docs: DataFrame, window: int = 8, support: int = 3, share: float = 0.9, letters: int = 3) -> DataFrame:
    """doc_id, id and rk (the row's key), base (personal data: start, place in KINDS, end) and terms (disclosing words:
    start, end, generalised) of each row of docs (doc_id, text), in code points."""
    docs = keyed(docs)
    disclosing = disclosing_terms(spark, docs, window, support, share, letters)
    bits = _bits(spark, disclosing)

    def found(batches):
        for batch in batches:
            base, maybe = [], []
            for n, _, own in _slices(batch, letters):
                base += [np.array(x, np.int64).reshape(-1, 3) for x in own.spans]
                fits = np.flatnonzero(_passes(bits.value, own.word))
                rows = np.stack([own.word[fits], own.letters[fits], own.first[fits], own.last[fits]], axis=1)
                edge = np.searchsorted(own.doc[fits], np.arange(n + 1))
                maybe += [rows[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            spans = _structs(base, {"start": pa.int32(), "kind": pa.int32(), "end": pa.int32()})
            terms = _structs(maybe, {"t": pa.int64(), "letters": pa.int64(), "start": pa.int32(), "end": pa.int32()})
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "id", "rk")), spans, terms], ["doc_id", "id", "rk", "base", "maybe"])

    rows = stored(spark, docs.mapInArrow(found, FOUND), "found")
    maybe = rows.where(F.size("maybe") > 0).select("id", "rk", F.explode("maybe").alias("m")).select("id", "rk", "m.*")
    broad = disclosing.select(F.col("t").alias("letters"), F.lit(True).alias("tells"))
    hits = maybe.join(disclosing, "t", "left_semi").join(broad, "letters", "left")
    general = F.col("tells").isNull() & (F.col("letters") != 0)
    hits = hits.groupBy("id", "rk").agg(F.collect_set(F.struct("start", "end", general.alias("general"))).alias("terms"))
    empty = F.array().cast("array<struct<start: int, end: int, general: boolean>>")
    return rows.drop("maybe").join(hits, ["id", "rk"], "left").withColumn("terms", F.coalesce(F.array_sort("terms"), empty))


def _sanitised(text: str, base, terms, letters: int) -> str:
    """text with personal data replaced by their kind in brackets, overlapping ones by the first's, and words by
    their first letters and a star, or by [TERM]."""
    out, at = [], 0
    for start, end, new in sorted([(b["start"], b["end"], f"[{KINDS[b['kind']].upper()}]") for b in base] + [(t["start"], t["end"], f"{text[t['start'] : t['start'] + letters]}*" if t["general"] else "[TERM]") for t in terms]):
        if start >= at:
            out += [text[at:start], new]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(spark: SparkSession, docs: DataFrame, letters: int = 3, **how) -> DataFrame:
    """docs with sanitised texts; null texts stay null."""
    id_, rk = row_key()
    i, r, found = free_name(docs, "_id"), free_name(docs, "_rk"), free_name(docs, "_found")
    spans = find_private(spark, docs.select("doc_id", "text"), letters=letters, **how).where((F.size("base") > 0) | (F.size("terms") > 0))
    spans = spans.dropDuplicates(["id", "rk"]).select(F.col("id").alias(i), F.col("rk").alias(r), F.struct("base", "terms").alias(found))

    @F.pandas_udf("string")
    def clean(text, spans):
        import pandas as pd

        return pd.Series([t if t is None or b is None else _sanitised(t, b, x, letters) for t, b, x in zip(text, spans["base"], spans["terms"], strict=True)], dtype=object)

    joined = docs.withColumn(i, id_).withColumn(r, rk).join(spans, [i, r], "left")
    return joined.withColumn("text", clean("text", found)).select(*docs.columns)
