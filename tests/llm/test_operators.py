import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.llm import decontamination, jaccard, language_model, licenses, neighbours, packing, quality, sharding, suffix_dedup, toxicity
from jobloom.llm import queries as Q
from jobloom.llm import common
from jobloom.llm.common import keyed
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(d, t, "en", "s1", len(t or "")) for d, t in rows], DOCS)
    if extra:  # names that the operators use themselves
        for name in ("rk", "n_words", "score", "_result", "gram", "component", "label", "batch", "_rk", "_found", "_row", "_items"):
            df = df.withColumn(name, F.lit("x"))
    return df


def pairs(spark, path=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def made(seed=1, n=60):
    """Texts with copies, near copies, shared passages, periodic texts, empty, null and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéfgh") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(150))
    rows = [(None, "with no id"), (1, None), (2, ""), (3, "   \n\t "), (4, "One two"), (5, "one TWO"), (6, "ab" * 700), (7, "x" * 1000), (8, "x" * 1000)]
    base = []
    for i in range(10, 10 + n):
        kind = r.random()
        if base and kind < 0.2:
            t = r.choice(base)
        elif base and kind < 0.5:
            w = r.choice(base).split(" ")
            for _ in range(r.randint(1, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = word()
            t = " ".join(w)
        else:
            t = " ".join(word() for _ in range(r.randint(1, 400)))
            if kind > 0.8:
                t = t[: r.randrange(len(t) + 1)] + passage + t
        base.append(t)
        rows.append((i, t))
    rows += [rows[-1], rows[-1], (3, "another text under the same id " * 3)]
    return rows


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


@pytest.mark.parametrize("most", [1000, 1])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, most):
    rows = made()
    full = suffix_dedup.repeated_runs
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", 100 if most > 1 else 2)
    monkeypatch.setattr(suffix_dedup, "repeated_runs", lambda s, d, laws: full(s, d, laws, most_stretches=most))
    assert as_rows(suffix_dedup.remove_repeats(spark, frame(spark, rows, extra=True)), *SUFFIX) == sorted(plain.repeats(rows), key=repr)


def stretches_of(texts, law):
    """All stretches of texts, as a table with bodies, as if each occurred once."""
    rows = []
    for k, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        own, edge = suffix_dedup.symbols(data, np.array([0, len(data)]), law.kind)
        _, gram, _, first, last, at = suffix_dedup.anchors_of(own, edge, law.depth, law.gram)
        rows += [(law.kind, int(g), 1, k, k, int(f), int(a - f), own[f : e + law.depth].tobytes()) for g, f, e, a in zip(gram, first, last, at, strict=True)]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["law", "gram", "n", "id", "rk", "first", "left", "body"])


@pytest.mark.parametrize("law", [suffix_dedup.Law(suffix_dedup.BYTES, 40, 8), suffix_dedup.Law(suffix_dedup.WORDS, 9, 3)])
def test_digits_find_exactly_the_repeated_windows(law):
    r = random.Random(4)
    some = lambda n: "".join(r.choice("ab ") for _ in range(n))
    passages = [some(120) for _ in range(5)]
    texts = []
    for _ in range(60):
        p = r.choice(passages)
        texts.append(some(r.randint(0, 60)) + p[r.randint(0, 50) : r.randint(70, 120)] + some(r.randint(0, 60)))
    parts = [tuple(t.encode()) if law.kind == suffix_dedup.BYTES else tuple(plain.spaced(t)) for t in texts]
    seen = {}
    for k, t in enumerate(parts):
        for i in range(len(t) - law.depth + 1):
            seen.setdefault(t[i : i + law.depth], set()).add((k, i))
    want = {x for own in seen.values() if len(own) > 1 for x in own}
    s = suffix_dedup.Stretches(stretches_of(texts, law), law.kind)
    got = suffix_dedup.repeated_in(s, law).to_pylist()
    assert {(x["id"], i) for x in got for i in range(x["first"], x["last"] + 1)} == want and len(want) > 300
    # Windows that share a wider digit include all that are equal.
    digits = {}
    for x in suffix_dedup.parts_of(s, law).to_pylist():
        for i, h in enumerate(np.frombuffer(x["windows"], np.int64).tolist()):
            digits.setdefault((x["digit"], h), set()).add((x["id"], x["place"] + i))
    assert {x for own in digits.values() if len(own) > 1 for x in own} == want


def test_suffix_dedup_on_table(spark):
    assert as_rows(Q.op1_suffix_dedup(spark, SF), *SUFFIX) == sorted(plain.repeats(pairs(spark)), key=repr)


JACCARD = ("doc_id", "n_shingles", "component_id")


@pytest.mark.parametrize(("most", "seed"), [(4000, 1), (3, 1), (2, 2)])
def test_jaccard_is_brute_force(spark, most, seed):
    rows = made(seed)
    assert as_rows(jaccard.near_duplicates(spark, frame(spark, rows, extra=True), most), *JACCARD) == sorted(plain.jaccard_components(rows), key=repr)


def test_jaccard_copies_texts_a_few_times(spark, monkeypatch):
    """Documents made of shared lines: candidate components of many chunks, in which much stays apart. Each text goes
    once to a chunk that its own meets, not once for every shared shingle."""
    r = random.Random(11)
    lines = [" ".join(f"w{r.randrange(4000)}" for _ in range(9)) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(lines[(i % 6) * 8 : (i % 6) * 8 + 20]) for _ in range(r.randint(5, 9)))) for i in range(240)]
    copies = []

    def counted(*given, own=jaccard._meetings):
        ours, theirs = own(*given)
        copies.append(ours.count() + theirs.count())
        return ours, theirs

    monkeypatch.setattr(jaccard, "_meetings", counted)
    assert as_rows(jaccard.near_duplicates(spark, frame(spark, rows), 24), *JACCARD) == sorted(plain.jaccard_components(rows), key=repr)
    assert 0 < sum(copies) <= 24 * len(rows)


def test_jaccard_on_table(spark):
    assert as_rows(Q.op3_jaccard_join(spark, SF), *JACCARD) == sorted(plain.jaccard_components(pairs(spark)), key=repr)


def test_jaccard_tree_finds_every_link():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(300):
        if sets and r.random() < 0.6:
            old = sets[r.integers(len(sets))]
            keep = old[r.random(len(old)) < r.uniform(0.7, 1)]
            new = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, max(1, len(old) - len(keep)), dtype=np.uint64)]))
        else:
            new = np.unique(r.integers(0, 1 << 63, r.integers(1, 300), dtype=np.uint64))
        sets.append(new)
    want = list(range(300))
    for i in range(300):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n) and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    got = jaccard.classes_of(sets)
    assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_jaccard_keeps_one_of_each(spark):
    rows = made()
    kept = jaccard.keep_first(spark, frame(spark, rows)).select("doc_id", "text").collect()
    alone = {c for d, n, c in plain.jaccard_components(rows) if n}
    assert len([r for r in kept if plain.spaced(r["text"])]) == len({(c if c is not None else "none") for c in alone})
    assert frame(spark, rows).columns == jaccard.keep_first(spark, frame(spark, rows)).columns


ITEMS = [(1, "alpha beta gamma"), (2, " ".join(f"w{i}" for i in range(30))), (10, None), (11, ""), (12, "Alpha, BETA gamma!"), (None, " ".join(f"w{i}" for i in range(5, 19)))]


@pytest.mark.parametrize("most", [500_000, 20])
def test_decontamination_is_brute_force(spark, most):
    w = [f"w{i}" for i in range(30)]
    rows = [(1, None), (2, ""), (3, "alpha-beta gamma"), (4, "x " * 200 + " ".join(w[3:20]) + " y" * 300), (5, " ".join(w)), (6, " ".join(w[:12])), (7, "ÄLPHA beta gamma alpha beta"), (5, " ".join(w)), (8, "alpha beta " + "gamma " * 500)]
    rows += [(20 + k, " ".join(w[k:])) for k in range(10)]
    docs = frame(spark, rows, extra=True)
    df, name = decontamination.find_benchmark(spark, docs, spark.createDataFrame(ITEMS, "item_id long, text string"), most_windows=most)
    ids = F.sha2(F.array_join(F.array_sort(f"{name}.items"), ",").cast("binary"), 256)
    got = df.select("doc_id", F.col(f"{name}.n_words").alias("a"), decontamination.hit_words(name).alias("b"), F.size(f"{name}.items").alias("c"), ids.alias("d"), decontamination.contaminated(name).alias("e"))
    assert as_rows(got, *got.columns) == sorted(plain.contamination(rows, ITEMS), key=repr)


def test_decontamination_on_table(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Q.op4_decontamination(spark, SF)
    assert as_rows(got, *got.columns) == sorted(plain.contamination(pairs(spark), items), key=repr)


def test_decontamination_with_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(spark, frame(spark, [(1, "a b"), (2, None)]), none).count() == 2


@pytest.mark.parametrize("query", [Q.op5_toxicity, Q.op6_quality])
def test_classifiers_hold_out(spark, query):
    path = "/root/testdata/sf0.01"
    column = {"op5_toxicity": "toxic", "op6_quality": "quality"}[query.__name__]
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = query(spark, path).collect()
    assert len(got) == spark.read.parquet(f"{path}/documents.parquet").count()
    for r in got:
        m = plain.crc(r["doc_id"])
        assert r["held_out"] == (m % 4 == 2 if column == "toxic" else m % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(labels[r["doc_id"]], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    ones, zeros = [s for y, s in held if y], [s for y, s in held if not y]
    area = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert area > 0.85


def test_toxicity_is_plain_ftrl(spark):
    r = random.Random(3)
    texts = {i: " ".join(r.choice("good fine bad vile boat sail".split()) for _ in range(r.randint(0, 9))) for i in range(80)}
    labels = {i: int("vile" in t) for i, t in texts.items()}
    docs = frame(spark, list(texts.items()), extra=True)
    given = spark.createDataFrame([(i, y, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    slots, weights, bias = toxicity.fit(docs, given, F.lit(True))
    order = [x["doc_id"] for x in docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    one = lambda w: int(common.Hashes(np.frombuffer(w.encode(), np.uint8)).of(np.array([0]), np.array([len(w)]))[0])
    cut = lambda x: (x & ((1 << 64) - 1)) >> (64 - toxicity.BITS)

    def features(t):
        h = [one(w) for w in plain.alnum(t)]
        pairs = {cut((a * salt + b) * 0x9FB21C651E98DF25) for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)) for a, b in zip(h, h[gap:], strict=False)}
        return sorted({cut(x) for x in h} | pairs)

    want = plain.ftrl([(features(texts[i]), labels[i]) for i in order])
    assert bias == pytest.approx(want.pop("bias", 0.0)) and len(want) > 2
    assert dict(zip(slots.tolist(), weights.tolist(), strict=True)) == pytest.approx(want)
    assert toxicity.fit(docs, given, F.lit(True), most_features=1)[0].size == 0  # one document is too little for any weight


def test_quality_statistics_and_rules_are_the_plain_ones(spark):
    rows = [r for r in made() + pairs(spark)[:60] if r[1] is None or len(r[1]) < 20_000] + [(900, "AB! CD ab\nab\n\nx\n"), (901, "\n"), (902, "Ünï çödé 123 #$ !!")]
    docs = frame(spark, rows, extra=True)
    df, name = quality.with_statistics(docs)
    got = df.select("text", f"{name}.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r[s] for s in quality.STATISTICS] == pytest.approx(plain.statistics(r["text"]))
    labels = spark.createDataFrame([(d, int("e" in (t or "")), 0) for d, t in rows if d is not None], "doc_id long, quality int, toxic int")
    rules, intercept = quality.fit(spark, docs, labels, F.lit(True))
    assert rules and all(len(r) == len({(s, most) for s, most, _ in r}) for r, _ in rules)
    scored = df.select("text", quality.score_column((rules, intercept), f"{name}.").alias("score")).collect()
    for r in scored:
        own = dict(zip(quality.STATISTICS, plain.statistics(r["text"]), strict=True))
        total = intercept + sum(w for rule, w in rules if all((own[s] <= t) == most for s, most, t in rule))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-6 or any(abs(own[s] - t) < 1e-9 for rule, _ in rules for s, _, t in rule)


def test_classifiers_without_labels(spark):
    docs = frame(spark, [(1, None), (2, "a b c"), (3, "")], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df, name = toxicity.score_toxicity(spark, docs, none)
    assert {r[0] for r in df.select(f"{name}.score").collect()} == {0.5}
    assert quality.keep_good(spark, docs, none).count() == 3
    one = spark.createDataFrame([(2, 1, 1), (3, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df, name = toxicity.score_toxicity(spark, docs, one)
    assert all(0 <= r[0] <= 1 for r in df.select(f"{name}.score").collect())
    assert quality.keep_good(spark, docs, one).count() == 3


def test_sharding_law(spark):
    rows = made()
    docs = frame(spark, rows, extra=True)
    got = sharding.shard(spark, docs).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"]) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d)
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and sum(map(len, by.values())) == len(rows)
    assert sharding.shard(spark, docs.limit(0)).count() == 0


def plain_hilbert(point, bits):
    """Index of a point, bit by bit: in each cube the state is a permutation of axes and a set of reversed ones."""
    n = len(point)
    entry = lambda w: 0 if w == 0 else (lambda i: i ^ (i >> 1))(2 * ((w - 1) // 2))
    ones = lambda i: 0 if not i & 1 else 1 + ones(i >> 1)
    direction = lambda w: 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
    turn = lambda x, k: ((x >> k) | (x << (n - k))) & ((1 << n) - 1)
    index, e, d = 0, 0, 0
    for b in range(bits - 1, -1, -1):
        cube = sum(((x >> b) & 1) << j for j, x in enumerate(point))
        code = turn(cube ^ e, (d + 1) % n)
        w = 0
        while w ^ (w >> 1) != code:
            w += 1
        index = (index << n) | w
        e ^= turn(entry(w), (n - d - 1) % n)
        d = (d + direction(w) + 1) % n
    return index


def test_hilbert_order_is_the_plain_one():
    """The same curve as the bitwise construction, up to the naming and reversal of axes and ends: consecutive
    points touch, start and end lie on one edge, and each cube is filled before the next."""
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    want = [plain_hilbert(c.tolist(), 3) for c in cells]
    path = cells[np.argsort(want)]
    assert sorted(want) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    own = cells[np.argsort(sharding.hilbert_index(cells, 3))]
    for some in (path, own):
        cubes = [tuple(c // 4) for c in some]
        assert [len(set(cubes[k : k + 64])) for k in range(0, 512, 64)] == [1] * 8
        assert np.abs(some[0] - some[-1]).tolist().count(7) == 1 and np.abs(some[0] - some[-1]).sum() == 7


def test_sharding_prunes(spark):
    """How many of the 8 shards a filter on one value touches."""
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = sharding.shard(spark, docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    touched = {c: {} for c in ("lang", "source", "large")}
    sizes = sorted(r["size"] for r in got)
    for r in got:
        for c, v in (("lang", r["lang"]), ("source", r["source"]), ("large", r["size"] > sizes[len(sizes) * 9 // 10])):
            touched[c].setdefault(v, set()).add(r["shard"])
    mean = lambda c: sum(map(len, touched[c].values())) / len(touched[c])
    assert mean("lang") <= 5.5 and mean("source") <= 6.5 and len(touched["large"][True]) <= 6


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    index = sharding.hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(d, t) for d, t in pairs(spark) + made() if d is not None and d != 3][:220]
    rows += [(9001, None), (9002, ""), (9003, "a  b\n\n  c \t é漢字🙂 ‍ it's 12345   "), (9004, "word " * 9000), (9005, " \n "), (9006, "x <|endoftext|> y<|endoftext|>")]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = packing.pack(frame(spark, rows, extra=True).coalesce(2), with_ids=True, most_open=8).collect()
    texts = dict(rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = []
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == len(ids)
            ids += r["ids"]
        assert ids == [*real.encode(texts[doc] or "", add_special_tokens=False).ids, 1] and {r["doc_tokens"] for r in own} == {len(ids)}
    padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padded += at < 2048
    assert padded <= 1


def test_token_ids_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.encoder(packing.default_vocabulary())
    r = random.Random(2)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "word", "é", "漢", "🙂", "'s", "123", "\t", "<|", "|>", "\x00", "\u200d", "İ", " \n "]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        assert own.encode(text, allowed_special="all") == real.encode(text, add_special_tokens=False).ids
    assert 50256 in own.encode("x <|endoftext|> y", allowed_special="all")


def test_packing_is_the_plain_rule():
    """Each rest goes where the sum of squares gets smallest, against trying all levels."""
    r = random.Random(8)
    window = 50
    packer = packing.Packer(window, 0, 1 << 30)
    levels = [0] * (window + 1)
    for doc in range(3000):
        size = r.choice([r.randint(1, 49), 17, 25, 33])
        best = None
        for h in range(window - size, -1, -1):  # the fuller level first
            if h and not levels[h]:
                continue
            after = list(levels)
            after[h] -= h > 0
            after[h + size] += h + size < window
            total = sum(x * x for x in after)
            if best is None or total < best[0]:
                best = (total, after)
        levels = best[1]
        packer.add(doc, np.zeros(size, np.uint32))
        assert packer.level.tolist() == levels
    whole = len(packer.take())
    packer.finish()
    assert whole > 0.9 * 3000 and len({x[2] for x in packer.take()}) > 1


def test_packing_dissolves_few_pieces(spark):
    """In many small tasks nearly all pieces still lie where the rule put them."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(32)
    got = packing.pack(docs)
    n, dissolved, part = got.agg(F.count("*"), F.count_if("dissolved"), F.countDistinct(F.shiftright("sequence_id", 33))).first()
    assert part > 20 and dissolved < 0.1 * n
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("last"))
    assert full.where("n < 2048").count() <= 1 and full.where("n > 2048").isEmpty()


def test_packing_opens_few_windows():
    """On the table's texts memory's bound is far: the rule alone places the pieces."""
    import pyarrow.parquet as pq

    encode = packing.encoder(packing.default_vocabulary()).encode
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    packer = packing.Packer(packing.WINDOW, 0, 4096)
    most = 0
    for doc, text in enumerate(texts):
        packer.add(doc, np.zeros(len(encode(text or "", allowed_special="all")) + 1, np.uint32))
        most = max(most, packer.n_open)
    assert most < 1024


def test_licenses_base_places(spark):
    rows = [(1, None), (2, ""), (3, "CC BY cc-by, ccby. All rights RESERVED all rights"), (4, "x General\nPublic   License general public license"), (5, "éall rights reserved"), (6, "cc by cc by"), (7, "This work is licensed under the GNU General Public License, version 3."), (8, "a\nReleased under the MIT License.\nb"), (8, "a\nReleased under the MIT License.\nb")]
    got = licenses.scan_licenses(spark, frame(spark, rows, extra=True)).collect()
    want = {}
    for doc, t in rows:
        w = plain.alnum(t)
        at = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
        every = sorted(i for v in at.values() for i in v)
        want[doc] = (len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in at.items() if v)))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[7] == "gpl,gpl-3.0" and labels[8] == "mit"


def plain_templates(text, templates, threshold):
    """The best containment of each template over all blocks of a text."""
    w, found = plain.alnum(text), {}
    for t in templates:
        wanted = set(t.text.split())
        for i in range(len(w)):
            own = set(w[i : i + t.span])
            if set(t.marks) <= own and not own & set(t.without) and len(own & wanted) >= t.need(threshold):
                found[t.label] = max(found.get(t.label, 0), len(own & wanted) / len(wanted))
    return found


def test_license_templates_are_brute_force(spark):
    """Notices wrapped over lines, with words lost and put in, and look-alikes, among prose."""
    r = random.Random(12)
    prose = lambda n: [r.choice("the a of this under license version public is software copy mit gnu free use boat sail wind".split()) for _ in range(n)]
    rows = []
    for i in range(150):
        w = r.choice(licenses.TEMPLATES).text.split()
        w = [x for x in w if r.random() > 0.06]
        for _ in range(r.randint(0, 4)):
            w.insert(r.randrange(len(w) + 1), r.choice(["boat", "lesser", "2", "noncommercial"]))
        w = prose(r.randint(0, 30)) + w + prose(r.randint(0, 30))
        rows.append((i, "".join(x.title() + r.choice([" ", " ", "\n * ", ", "]) for x in w)))
    given = [(500, "Released under the BSD license."), (501, "Licensed under CC BY 4.0."), (502, "Licensed under the Mozilla Public License, version 2.0."), (503, "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following\n# conditions are met:")]
    rows += given + [(504, "released under a tree far away from here by someone the mit of old lost its license"), (505, None), (506, "")]
    want = {d: plain_templates(t, licenses.TEMPLATES, licenses.THRESHOLD) for d, t in rows}
    texts = licenses.scanned(spark, keyed(frame(spark, rows, extra=True)), licenses.TEMPLATES)
    got = {}
    for x in licenses.template_matches(spark, texts, licenses.TEMPLATES).collect():
        got.setdefault(x["id"], {})[x["label"]] = x["containment"]
    assert got == {d: f for d, f in want.items() if f} and len(got) > 50
    assert "mit" not in want[500] and "cc-by-nc" not in want[501] and "apache-2.0" not in want[502] and want[503] == {"bsd": 1.0} and not want[504]
    assert {k for f in got.values() for k in f} == {t.label for t in licenses.TEMPLATES}


def test_neighbours_are_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(1, 160)]
    rows += [(0, rows[3][1]), (200, rows[3][1]), (201, rows[3][1]), (202, None), (203, [0.0] * 8), (204, [float("nan")] * 8), (205, [None, *[1.0] * 7]), (206, [float("inf")] * 8), (250, [1.0, 2.0]), (None, [1.0] * 8), (300, [2.0 * x for x in rows[3][1]]), (7, rows[6][1])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x")).withColumn("qb", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, query_block=2, candidate_block=50)
    want = plain.nearest(list(dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows)))
    key = lambda x: [(q, k, v, round(s, 12)) for q, k, v, s in sorted(x)]
    assert key(as_rows(got, "query_id", "rank", "vec_id", "score")) == key(want)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_language_model_base_and_both_ways(spark):
    rows = made()
    docs = frame(spark, rows, extra=True)
    want = sorted(plain.base_scores(rows), key=repr)
    scores = []
    for most in (1 << 30, 0):
        got = as_rows(language_model.score_texts(spark, docs, most_bytes=most), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want])
        scores.append([g[6] for g in got])
    assert np.allclose(*scores) and max(scores[0]) <= 0


def test_language_model_scores_are_the_plain_ones(spark):
    """The filter's false hits can only raise a count, and do so seldom."""
    rows = [r for r in made() if r[0] is not None]
    want = dict(plain.bigram_scores(list(dict(rows).items())))
    docs = frame(spark, list(dict(rows).items()))
    got = {r["doc_id"]: r for r in language_model.score_texts(spark, docs).collect()}
    assert all(got[d]["score"] >= w - 1e-9 for d, w in want.items())
    gap = sum(got[d]["score"] - w for d, w in want.items()) / sum(r["n_tokens"] for r in got.values())
    assert gap < 0.05 and sum(abs(got[d]["score"] - w) < 1e-9 for d, w in want.items()) > 5


def test_language_model_is_a_probability():
    """After every word, the probabilities of all words and of an unknown one add up to 1, but for false hits."""
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{min(x, 300)}" for x in r.zipf(1.3, r.integers(1, 120))) for _ in range(150)]
    data, offsets = common.buffers(pa.array(texts))
    h, at = language_model.tokens(data, offsets)
    before, pair = language_model.bigrams(h, at)
    word, c = np.unique(h, return_counts=True)
    distinct, place, n = np.unique(pair, return_index=True, return_counts=True)
    own = language_model._segment(distinct, 3).astype(int)
    filter_ = language_model.Filter({s: language_model.filter_of(distinct[own == s].astype(np.uint32), n[own == s]).tobytes() for s in range(3)}, 3)
    first, follow = language_model._sum(language_model._top(before[place]), language_model.count_at(language_model.level_of(n)))
    mass, times = [], []
    for w, k in zip([language_model.BEGIN, *word], [len(texts), *c], strict=True):
        level = filter_.level(common.mix(np.full(len(word), w) * language_model._A + word * language_model._B))
        total = language_model._counts(first, follow, language_model._top(np.array([w])))[0]
        p = (c + 1) / (len(h) + len(word) + 1)
        mass.append(float(((language_model.count_at(level) + language_model.MU * p) / (total + language_model.MU)).sum()) + language_model.MU / (len(h) + len(word) + 1) / (total + language_model.MU))
        times.append(k)
    assert 0.99 < min(mass) and np.average(mass, weights=times) < 1.05


def test_language_model_beats_its_base(spark):
    got = Q.op10_language_model(spark, SF).where("held_out").agg(F.sum("base_score"), F.sum("score")).collect()[0]
    assert got[1] > got[0]


def test_bloom_levels():
    r = np.random.default_rng(1)
    pair = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64))
    count = r.geometric(0.2, len(pair))
    part = language_model._segment(pair, 3).astype(int)
    parts = {s: language_model.filter_of(pair[part == s].astype(np.uint32), count[part == s]).tobytes() for s in range(3)}
    level = language_model.Filter(parts, 3).level(pair)
    assert (level >= language_model.level_of(count)).all() and (level == language_model.level_of(count)).mean() > 0.9
    assert (language_model.Filter(parts, 3).level(r.integers(0, 1 << 63, 5000, dtype=np.uint64)) == 0).mean() > 0.9


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, jaccard.near_duplicates, jaccard.keep_first, licenses.scan_licenses, language_model.score_texts, sharding.shard])
def test_empty_tables(spark, run):
    assert run(spark, frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_classifiers_and_packing_of_no_documents(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(spark, none, labels)[0].count() == 0
    assert quality.keep_good(spark, none, labels).count() == 0
    assert packing.pack(none).count() == 0


@pytest.fixture(scope="module")
def long_texts(spark):
    """A text of 3 MB twice, one with a single word of 1 MB, and a short one."""
    r = random.Random(9)
    some = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(4000)]
    text = " ".join(r.choice(some) for _ in range(500_000))
    return [(1, text), (2, text), (3, "x" * 1_000_000), (4, "a short one")]


def test_long_texts_are_taken_whole(spark, long_texts):
    docs = frame(spark, long_texts, extra=True).repartition(2)
    size = {d: len(t) for d, t in long_texts}
    removed = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark, docs).collect()}
    assert [removed[d]["n_removed"] for d in (1, 2, 3, 4)] == [size[1], size[2], size[3], 0] and removed[1]["n_passage_words"] == 500_000
    assert {r["doc_id"]: r["size"] for r in sharding.shard(spark, docs).collect()} == {d: n + 1 for d, n in size.items()}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark, docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    items = spark.createDataFrame([(1, " ".join(long_texts[0][1].split()[-13:]))], "item_id long, text string")
    df, name = decontamination.find_benchmark(spark, docs, items)
    assert {r["doc_id"]: (r["n"], r["hit"]) for r in df.select("doc_id", F.col(f"{name}.n_words").alias("n"), decontamination.hit_words(name).alias("hit")).collect()} == {1: (500_000, 13), 2: (500_000, 13), 3: (1, 0), 4: (3, 0)}
    assert {r["doc_id"]: r["n_words"] for r in licenses.scan_licenses(spark, docs).collect()} == {1: 500_000, 2: 500_000, 3: 1, 4: 3}
    scores = {r["doc_id"]: r for r in language_model.score_texts(spark, docs).collect()}
    assert [scores[d]["n_tokens"] for d in (1, 2, 3, 4)] == [500_001, 500_001, 2, 4] and scores[1]["score"] == scores[2]["score"]
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for df, score in ((x[0], f"{x[1]}.score") for x in [toxicity.score_toxicity(spark, docs, labels)]):
        assert all(0 <= r[0] <= 1 for r in df.select(score).collect())
    assert quality.keep_good(spark, docs, labels).count() <= 4
    lengths = {}
    for r in packing.pack(docs).collect():
        lengths.setdefault(r["doc_id"], [r["doc_tokens"], 0])[1] += r["length"]
    assert set(lengths) == {1, 2, 3, 4} and all(a == b for a, b in lengths.values())


def test_keys_of_equal_rows(spark):
    assert keyed(frame(spark, [(1, None), (1, ""), (1, "a")])).select("rk").distinct().count() == 2


def test_long_texts_are_hashed_in_pieces():
    data = np.frombuffer("".join(random.Random(1).choices("ab \n", k=5000)).encode(), np.uint8)
    lowered, start, end, _ = common.words(data, np.array([0, len(data)]))
    whole = common.Hashes(lowered).of(start, end)
    for piece in (1, 7, 100, 4999):
        assert (common.word_hashes(lowered, start, end, piece) == whole).all()
    rows = [r for r in made() if r[1] and len(r[1]) > 900][:12]
    assert rows
    for _, text in rows:  # the pieces' windows are the text's
        data = np.frombuffer(text.encode(), np.uint8)
        windows = np.zeros(max(len(data) - 399, 0), int)
        for begin, own, offsets in suffix_dedup._pieces(data, np.array([0, len(data)]), 400, 500):
            *_, first, last, _ = suffix_dedup.anchors_of(own, offsets)
            for a, b in zip(first + begin, last + begin, strict=True):
                windows[a : b + 1] += 1
        assert (windows == 1).all()
