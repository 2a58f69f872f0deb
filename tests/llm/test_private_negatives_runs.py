"""Sanitisation, hard negatives and periodic runs against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import hard_negatives, periodic_runs, sanitisation
from jobloom.llm import queries as Q
from tests.llm.test_operators import SF, frame, pairs

# ---- sanitisation -----------------------------------------------------------------------------------

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        twice = [2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        return sum(twice) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(found + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15])


def test_personal_data_is_the_patterns():
    r = random.Random(1)
    for _ in range(60_000):
        signs = r.choice(["a@.b-", "1.2@a", "123 -+().", "12. +é", "0123456789 -", "+12()a@.", "1.25"])
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 60)))
        assert sanitisation.personal_data(text) == base_spans(text), text


def test_personal_data_in_very_long_words():
    """Neither a run of letters nor of digits makes the search quadratic."""
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "+" * 100_000 + "1" * 100_000):
        assert sanitisation.personal_data(text) == []
    assert len(sanitisation.personal_data("1." * 150_000)) == 37_500
    assert sanitisation.personal_data("x" * 100_000 + "@y.z " + "4111 1111 1111 1111")[1] == (100_005, 2, 100_024)


def disclosed(rows, window=8, support=3, share=0.9):
    """Spans of disclosing words by counting everything in plain dictionaries."""
    docs = []
    for _, t in rows:
        t = t or ""
        base = base_spans(t)
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if not any(a < m.end() and m.start() < e for a, _, e in base)]
        docs.append((t, base, words))
    terms_of = lambda w: [w, w[:3] + "*"] if len(w) > 3 else [w]
    n_t, n_e, around = Counter(), Counter(), {}
    for t, base, words in docs:
        n_t.update({x for *_, w in words for x in terms_of(w)})
        seen = {}
        for a, kind, e in base:
            value = (kind, t[a:e].lower() if kind < 2 else re.sub("[^0-9]", "", t[a:e]))
            at = sum(w[0] < a for w in words)
            for k in range(max(0, at - window), min(len(words), at + window)):
                for x in terms_of(words[k][2]):
                    seen.setdefault(value, {}).setdefault(x, set()).add(k)
            seen.setdefault(value, {})
        for value, own in seen.items():
            n_e[value] += 1
            for x, ks in own.items():
                k = min(ks)
                side = tuple(words[j][2] if 0 <= j < len(words) else "" for j in (k - 2 * window, k + 2 * window))
                around.setdefault((value, x), Counter())[side] += 1
    n, told = len(docs), set()
    for (value, x), sides in around.items():
        k = sum(sides.values())
        if k >= support and 2 * max(sides.values()) <= k and n_e[value] < n and math.log2(n * k / (n_e[value] * n_t[x])) >= share * math.log2(n / n_e[value]):
            told.add(x)
    return [sorted([(a, kind, e) for a, kind, e in base] + [(a, 4, e) for a, e, w in words if w in told]) for _, base, words in docs], told


def planted():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(240):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if i % 10 == 0:
            w.insert(len(w) // 2, "known as Ünderwoodx to kim@x.org")
        if i % 10 == 1:
            w[len(w) // 2 : len(w) // 2] = [f"zorbl{i}", "+1 (555) 123-4567"]
        if i % 7 == 3:
            w = ["quux", *w[:2], "tel 4111 1111 1111 1111", *w[2:]]
        if i % 11 == 5:
            w.insert(0, "quux 10.0.0.1 Wanda")
        rows.append((i, " ".join(w)))
    rows += [(300 + i, "a copied text of words with mail bob@y.org and many others in it") for i in range(20)]
    return [*rows, (400, None), (401, ""), (402, "  "), (403, "é" * 5), (10, rows[10][1]), (10, rows[10][1]), (None, "kim@x.org"), (404, "word " * 30_000 + "kim@x.org")]


def test_sanitisation_is_brute_force(spark):
    rows = planted()
    want, told = disclosed(rows)
    assert "Ünderwoodx" in told and "copied" not in told
    found = sanitisation.find_private(spark, frame(spark, rows, extra=True)).collect()
    got = sorted(((r["doc_id"], sorted([(b["start"], b["kind"], b["end"]) for b in r["base"]] + [(t["start"], 4, t["end"]) for t in r["terms"]])) for r in found), key=repr)
    assert got == sorted(((d, own) for (d, _), own in zip(rows, want, strict=True)), key=repr)


def test_sanitised_texts_hold_no_personal_data(spark):
    rows = planted()
    df = frame(spark, rows, extra=True)
    out = sanitisation.sanitise(spark, df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[400] is None and texts[401] == "" and texts[300] == "a copied text of words with mail [EMAIL] and many others in it"
    assert not any(base_spans(t or "") for t in texts.values()) and "Ünderwoodx" not in texts[0]
    assert sanitisation.sanitise(spark, df.limit(0)).count() == 0


def test_sanitisation_query(spark):
    got = {r["doc_id"]: r for r in Q.op11_sanitisation(spark, SF).collect()}
    rows = pairs(spark)
    want, _ = disclosed(rows)
    names = (*sanitisation.KINDS, "term")
    for (doc, _), own in zip(rows, want, strict=True):
        r, written = got[doc], [f"{names[k]}:{a}:{e}" for a, k, e in own]
        assert r["spans"] == ",".join(written) and [r[f"n_{x}"] for x in sanitisation.KINDS] == [sum(k == i for _, k, _ in own) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(x for x in written if not x.startswith("term")).encode()).hexdigest()


# ---- hard negatives ---------------------------------------------------------------------------------


def mined(rows, every=10, n_positives=5, k=10):
    good = {(i, label, tuple(v)) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in good]
    out = []
    for i, label, v in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in whole if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            fits = [(j, -t) for t, j, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(i, p, rank + 1, j, -s, t) for rank, (j, t) in enumerate(fits)]
    return sorted(out)


def vectors(seed=0, n=160):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(0, 1, 8).round(1)], int(r.integers(0, 3))) for i in range(n)]
    rows += [(i, list(rows[0][1]), 1) for i in range(n, n + 12)]  # ties
    rows += [rows[5], rows[20]]  # repeated rows
    return rows + [(500, None, 1), (501, [1.0, None] + [0.0] * 6, 1), (502, [float("nan")] * 8, 1), (510, [float("inf")] * 8, 2), (None, [1.0] * 8, 1), (520, [1.0] * 8, None), (530, [1.0, 2.0], 1), (531, [1.0, 2.5], 1), (532, [1.0, 1.5], 2), (540, [], 1), (541, [], 1), (542, [], 2), (550, [0.0] * 8, 0)]


@pytest.mark.parametrize(("anchor_block", "candidate_block"), [(1024, 32768), (4, 16)])
def test_hard_negatives_are_brute_force(spark, anchor_block, candidate_block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"akey": F.lit("x"), "dim": F.lit(1), "score": F.lit("s")})
    got = hard_negatives.mine(spark, df, F.col("vec_id") % 10 == 0, anchor_block=anchor_block, candidate_block=candidate_block).collect()
    assert sorted(map(tuple, got)) == mined(rows)
    assert hard_negatives.mine(spark, df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_hard_negatives_query(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op12_hard_negatives(spark, SF).collect())) == mined(rows, every=100)


def test_products_are_exact():
    big = np.array([[1 << 30, -(1 << 30)], [3, 5]], np.int64)
    assert hard_negatives.products(big, big).tolist() == [[1 << 61, (3 - 5) << 30], [(3 - 5) << 30, 34]]
    huge = np.array([[1 << 40, 1]], np.int64)
    with pytest.raises(OverflowError):
        hard_negatives.products(huge, huge)
    assert hard_negatives.products(huge, np.array([[1, 1 << 62]], np.int64)).tolist() == [[(1 << 40) + (1 << 62)]]


def test_slots_merge_from_the_lowest():
    """Overlapping windows from one list a slot."""
    slots = {0: [(-9, 1), (-9, 2)], 1: [(-7, 3)], 2: [(-3, 4), (-2, 5)]}
    rows = hard_negatives.merged(slots, [(10, 70), (8, 71), (4, 72)], 2, 30, 90)
    assert sorted(rows) == [(70, 1, 1, 10, 9), (70, 2, 2, 10, 9), (71, 1, 3, 8, 7), (71, 2, 4, 8, 3), (72, 1, 4, 4, 3), (72, 2, 5, 4, 2)]


# ---- periodic runs ----------------------------------------------------------------------------------


def all_runs(words, least=12):
    n, seen = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                seen.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in seen.items())


def collapsed(words, runs):
    drop = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


@pytest.mark.parametrize("kept", [1 << 15, 16])
def test_runs_are_brute_force(monkeypatch, kept):
    monkeypatch.setattr(periodic_runs, "KEPT_GRID", kept)
    periodic_runs._kept_grid.cache_clear()
    r = random.Random(5)
    for least in (12, 12, 12, 3):
        for _ in range(40):
            texts = []
            for _ in range(r.randint(1, 6)):
                k = r.choice([1, 2, 3, 5])
                own = [r.randrange(k) for _ in range(r.choice([0, 1, 5, 30, 60, 200]))]
                for _ in range(r.randint(0, 3)):
                    unit = [r.randrange(k) for _ in range(r.randint(1, 20))]
                    own += (unit * r.randint(2, 12))[: r.randint(2, 200)] + [r.randrange(9) for _ in range(r.randint(0, 5))]
                texts.append(own)
            at = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
            symbols = periodic_runs.mix(np.array([y for x in texts for y in x], np.uint64) + np.uint64(7))
            assert periodic_runs.find_runs(symbols, at, least).tolist() == [[i, *x] for i, own in enumerate(texts) for x in all_runs(own, least)]
    periodic_runs._kept_grid.cache_clear()


def test_extensions_are_exact():
    r = np.random.default_rng(3)
    sequence = np.concatenate([r.integers(0, 3, 400), np.tile(r.integers(0, 3, 7), 60), np.zeros(300, int), r.integers(0, 2, 200)]).astype(np.uint64)
    sequence = periodic_runs.mix(sequence + np.uint64(1))
    grammar = periodic_runs.Grammar(sequence)
    i = r.integers(0, len(sequence) - 1, 2000)
    j = np.minimum(i + 1 + r.integers(0, 300, 2000), len(sequence) - 1)
    i, j = i[i < j], j[i < j]
    own = sequence.tolist()

    def plain(a, b, step):
        k = 0
        while a + step * k >= 0 and b + step * k < len(own) and own[a + step * k] == own[b + step * k]:
            k += 1
        return k

    assert grammar.extension(i, j, True).tolist() == [plain(a, b, 1) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert grammar.extension(i, j, False).tolist() == [plain(a, b, -1) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(grammar.levels) < 100


SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_runs_of_odd_texts(spark):
    line = "Buy now, best price in town! "
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, line * 9), (4, line * 9), (5, "a " * 12), (6, "a " * 11), (7, "A a " * 8), (8, "é漢 🙂 x\x0b" * 7 + "end"), (None, "x y z " * 5), (9, "w " * 60_000), (10, " ".join(f"w{i % 977}" for i in range(40_000))), (11, "one two")]
    df, name = periodic_runs.periodic_runs(frame(spark, rows, extra=True))
    got = sorted(((r["doc_id"], r[name]["n_words"], [tuple(x) for x in r[name]["runs"]], r[name]["collapsed"]) for r in df.collect()), key=repr)
    want = []
    for d, t in rows:
        words = SPACED.findall(t or "")
        runs = [(0, len(words), {9: 1, 10: 977}[d])] if d in (9, 10) else all_runs(words)
        want.append((d, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(frame(spark, rows).limit(0))[0].count() == 0


def test_runs_query(spark):
    got = {r["doc_id"]: r for r in Q.op13_periodic_runs(spark, SF).collect()}
    made = 0
    for doc, text in pairs(spark):
        words = SPACED.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            made += 1
        if n > 3000:
            continue
        runs, r = all_runs(words), got[doc]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{p}\n" for s, x, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert made > 10
