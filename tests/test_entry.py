"""The registered queries against their oracles on the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SQL = {n: s for n, s in E.oracle_sql().items() if not n.startswith(("op", "pipeline"))}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert got == sorted((tuple(plain(row[order.index(c)]) for c in columns) for row in result.fetchall()), key=repr)


#: Queries that SQL does not express; each is held against a plain version below.
WITHOUT_SQL = {"b38_parse_sections", "b42_description_html"}


def test_all_others_have_sql():
    assert {n for n in E.queries() if n not in E.oracle_sql() and not n.startswith(("op", "pipeline"))} == WITHOUT_SQL


def test_resolve_batch_on_table(spark):
    from jobloom.operators import scoring
    from jobloom.plans.catalog import Views
    from tests.test_operators import folded

    accepted = scoring.enrich(Views(spark, SF).postings).where("reject_stage is null").orderBy("seq").collect()
    rows = [(r["seq"], r["source"], r["external_job_id"], r["dedup_hash"], r["normalized_title"], r["normalized_company_name"], r["city"]) for r in accepted]
    got = {r["seq"]: (r["leader"], r["level"]) for r in E.queries()["h05_resolve_batch"](spark, SF).collect()}
    assert got == folded(rows) and len(got) > 50


@pytest.mark.parametrize(("name", "tiers"), [("i06_sliding_admission", None), ("i08_token_bucket", None), ("i06_tier_admission", {"login": 10, "refresh": 30, "public": 120})])
def test_limiters_on_table(spark, name, tiers):
    from jobloom.operators import limits

    events = sorted(((r["ts"], r["event_id"], r["user_id"]) for r in spark.read.parquet(f"{SF}/events.parquet").collect()))
    state, want, window = {}, {}, 4 * 3600 * 1_000_000
    for ts, i, user in events:
        kind = ("login", "refresh", "public")[user % 3]
        key = (kind, user % 7) if tiers else user
        t = [int(ts.timestamp() * 1_000_000)]
        if name == "i08_token_bucket":
            want[i] = limits.take(t, 2, 12 * window, state.setdefault(key, []))[0]
        else:
            want[i] = limits.admit(t, tiers[kind] if tiers else 3, window * (60 if tiers else 1), state.setdefault(key, []))[0]
    got = {r["id"]: r["admitted"] for r in E.queries()[name](spark, SF).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_sections_on_table(spark):
    """Each section's items, put together again, are the text between its header and the next."""
    from jobloom.functions import rules
    from jobloom.plans.catalog import Views

    texts = {r["seq"]: r["description"] for r in Views(spark, SF).postings.select("seq", "description").collect()}
    squeeze = lambda s: re.sub(r"[\s.:]+", "", s).lower()
    header = re.compile(rf"(?i)(?:^|(?<=[.!?\s]))\s*({rules.SECTION_HEADERS})\s*[:\-—–]", re.A)
    for r in E.queries()["b38_parse_sections"](spark, SF).collect():
        text = re.sub(r"\.([A-Z])", r". \1", texts[r["seq"]])
        found = header.split(re.sub(r"\s+", " ", text, flags=re.A).strip())
        chunks = [("overview", found[0]), *zip(found[1::2], found[2::2], strict=True)]
        want = [(h.lower(), squeeze(b)) for h, b in chunks if squeeze(b)]
        got = [(s["heading"].lower(), squeeze("".join(s["items"]))) for s in r["sections"]]
        assert len({h for h, _ in want}) < len(want) or got == want


def test_description_html_on_table(spark):
    """All words of a description are in its HTML, in their order, and only the allowed elements."""
    from jobloom.plans.catalog import Views

    texts = {r["seq"]: r["description"] for r in Views(spark, SF).postings.select("seq", "description").collect()}
    entities = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
    for r in E.queries()["b42_description_html"](spark, SF).collect():
        assert set(re.findall(r"</?([^>]*)>", r["html"])) <= {"h3", "p", "ul", "li"}
        plain_text = re.sub("|".join(entities), lambda m: entities[m[0]], re.sub(r"</?(?:h3|p|ul|li)>", " ", r["html"]))
        assert re.findall(r"[^\W_]+", plain_text) == re.findall(r"[^\W_]+", texts[r["seq"]])


def test_flagship(spark):
    got = E.entry(spark)
    assert got.columns == ["place", "id"]
    assert [r["place"] for r in got.orderBy("place").collect()] == list(range(1, 101))
    assert E.queries()["c06_filter_jobs_multi"](spark, SF).count() > 100


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
