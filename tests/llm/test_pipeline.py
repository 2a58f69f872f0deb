"""Each stage against a brute-force version on its own input, and the whole run."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_operators import DOCS, made

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Inputs and outputs of all stages, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def plain_words(text):
    return (text or "").split()


def test_columns(stages):
    for df in stages[:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()


def test_quality_keeps_good(stages, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in rows(stages[1])}
    good = [d in kept for d, q in labels.items() if q == 1]
    assert sum(good) / len(good) > 0.9 and kept <= {d for d, _ in rows(stages[0])}


def test_one_of_each_group(stages):
    given = rows(stages[1])
    want = {c for _, n, c in plain.jaccard_components(given) if n} | {d for d, t in given if not plain.spaced(t)}
    assert sorted(d for d, _ in rows(stages[2])) == sorted(want)


def test_repeats_go(stages):
    given = sorted(rows(stages[2]))
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in stages[3].collect())
    want = plain.without_repeats([t for _, t in given])
    assert [(d, t) for d, t, _ in got] == [(d, t) for (d, _), t in zip(given, want, strict=True)]
    assert all(n == len(t) for (_, t, n), (_, old) in zip(got, given, strict=True) if t != old) and any(t != old for (_, t, _), (_, old) in zip(got, given, strict=True))


def test_contaminated_go(stages, spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [d for d, *_, bad in plain.contamination(rows(stages[3]), items) if not bad]
    assert sorted(d for d, _ in rows(stages[4])) == sorted(want)


def test_packed_whole(stages):
    lengths = {}
    for r in stages[5].collect():
        lengths.setdefault(r["doc_id"], [r["doc_tokens"], 0])[1] += r["length"]
    assert set(lengths) == {d for d, _ in rows(stages[4])} and all(a == b for a, b in lengths.values())


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in made()], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        more = docs.selectExpr("*", "1 AS _rk", "2 AS _found", "3 AS _result", "4 AS _row")
        assert stage(spark, more, SF).columns == more.columns
        assert stage(spark, more, SF).count() > 0 and stage(spark, docs.limit(0), SF).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, more, SF).collect()
    whole = {}
    for r in pieces:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    assert set(whole) == {d for d, _ in made()} and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_short_passages_of_51_words_go(spark):
    """Repeated passages of 51 words under 400 bytes go, against brute force over words; those of 50 stay."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    some = lambda n: [word() for _ in range(n)]
    long, short = some(51), some(50)
    assert len(" ".join(long)) < 400
    texts = [" ".join(some(r.randint(0, 90)) + (long if i % 3 == 0 else short if i % 3 == 1 else []) + some(r.randint(0, 90))) for i in range(30)]
    texts += ["\n".join(long), " ".join(long[:50]), " ".join(long[:25]), " ".join(long[25:]), "é " + "  ".join(long) + " é", "", None]
    seen = Counter(tuple(w[i : i + 51]) for w in (plain_words(t) for t in texts) for i in range(len(w) - 50))
    want = {}
    for doc, t in enumerate(texts):
        w = plain_words(t)
        gone = {j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        want[doc] = [x for j, x in enumerate(w) if j not in gone]
    assert want[0] and want[30] == [] and want[34] == ["é", "é"] and len(want[1]) >= 50 and len(want[31]) == 50
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, SF).collect()}
    assert {d: plain_words(r["text"]) for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.values())
