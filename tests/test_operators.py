"""Operators that SQL does not express, and facts about the others."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.operators import dedup, limits, scoring, search
from jobloom.sources import feeds, pages
from jobloom.streaming import ingest


@pytest.mark.parametrize(("title", "rejected"), [("Tower Crane Rigger", True), ("Night Forklift Crew", True), ("HVAC Fitter", True), ("Scaffolder, Oil Rigs", True), ("Pastry Chef", True), ("Crane Software Developer", False), ("SAP Lead for Construction Firms", False), ("Web Shop Developer", False), (" ", True)])
def test_hard_reject(spark, title, rejected):
    df = spark.createDataFrame([(title, "Dubai", "AE", "text")], "t string, l string, c string, d string")
    assert df.select(scoring.hard_reject("t", "l", "c", "d")).collect()[0][0] is rejected


def test_scores(spark):
    df = spark.createDataFrame([("Harbour Pilot", 0), ("Cloud Developer", 1), ("Senior\nPlatform Engineer", 9)], "t string, n int")
    got = [(r["s"], {x["rule"] for x in r["r"]}) for r in df.select(scoring.relevance_reasons("t", F.lit(None).cast("string"), "n").alias("r")).select("r", scoring.relevance_score("r").alias("s")).collect()]
    assert got[0][0] < rules.MIN_SCORE <= got[1][0] and got[2] == (65, {"tech_domain_title", "tech_footprint_9"})


def _jobs(spark, rows):
    return spark.createDataFrame([(i, t, d, None, c, 0, True) for i, t, d, c in rows], "id long, title string, description string, requirements string, created_at timestamp, salary int, is_active boolean").withColumns({"salary_min": F.col("salary"), "salary_max": F.col("salary")})


def test_orders(spark):
    day = dt.datetime(2024, 1, 10)
    old, new = (1, "data platform engineer data", "x" * 400 + " data", day - dt.timedelta(days=20)), (2, "Engineer", "y" * 400 + " data", day)
    thin, full = (3, "Thin", "short", day), (4, "Full", "z" * 400, day - dt.timedelta(days=1))
    ids = lambda rows, *a: [r["id"] for r in search.page(_jobs(spark, rows), search.job_order(*a)).collect()]
    assert ids([old, new], "newest", "data") == [2, 1] and ids([old, new], "date_asc", "data") == [1, 2]
    assert ids([old, new], "other", "data") == [1, 2] and ids([thin, full], "newest") == [4, 3] and ids([thin, full], "") == [4, 3]


def test_trigrams(spark):
    assert abs(spark.range(1).select(dedup.trigram_similarity(F.lit("word"), F.lit("two words"))).collect()[0][0] - 4 / 11) < 1e-9


def test_unique_slugs(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "base string, seq long")
    taken = spark.createDataFrame([("a",), ("a-2",), ("b-1",)], "slug string")
    assert {r["seq"]: r["slug"] for r in dedup.assign_unique_slugs(new, taken).collect()} == {1: "a-1", 2: "a-3", 3: "a-4", 4: "b"}


def test_unique_slugs_are_the_first_free(spark):
    """Against trying number after number, with one base that holds most rows."""
    r = random.Random(6)
    new = [(r.choice("aaaab"), i) for i in range(300)]
    taken = {r.choice("ab") + (f"-{n}" if (n := r.randint(0, 250)) else "") for _ in range(160)} | {"a-7-2", "c"}
    used, want = set(taken), {}
    for base, seq in new:
        slug = next(s for k in range(10_000) if (s := f"{base}-{k}" if k else base) not in used)
        used.add(slug)
        want[seq] = slug
    got = dedup.assign_unique_slugs(spark.createDataFrame(new, "base string, seq long"), spark.createDataFrame([(t,) for t in sorted(taken)], "slug string"))
    assert {x["seq"]: x["slug"] for x in got.collect()} == want


POST = "seq long, external_source string, external_job_id string, dedup_hash string, normalized_title string, normalized_company_name string, city string"


def folded(rows, least=0.85):
    """The batch taken row by row."""
    grams = lambda t: {f"  {w} "[k : k + 3] for w in re.findall(r"[^\W_]+", (t or "").lower()) for k in range(len(w) + 1)}
    ids, hashes, kept, want = {}, {}, [], {}
    for seq, s, i, h, t, c, city in rows:
        own = grams(t)
        near = [(-len(own & o) / len(own | o), k) for o, where, k in kept if where == (c.lower(), city.lower()) and own | o] if c is not None and city is not None and own else []
        best = min(near, default=(0, None))
        leader = (ids.get((s, i)) if i else None, "L1")
        leader = leader if leader[0] is not None else (hashes.get(h) if h else None, "L2")
        leader = leader if leader[0] is not None else ((best[1], "L3") if -best[0] >= least else (None, "NONE"))
        if leader[0] is None:
            leader = (seq, "NONE")
            if i:
                ids.setdefault((s, i), seq)
            if h:
                hashes.setdefault(h, seq)
            if c is not None and city is not None:
                kept.append((own, (c.lower(), city.lower()), seq))
        want[seq] = leader
    return want


def resolved(spark, rows, **given):
    return {r["seq"]: (r["leader"], r["level"]) for r in dedup.resolve_batch(spark.createDataFrame(rows, POST), **given).collect()}


@pytest.mark.parametrize("small", [20_000, 0])
def test_resolve_batch_is_a_fold(spark, small):
    r = random.Random(4)
    titles = ["Boat Builder", "Boat Builders", "Boat Builder II", "Cook", "Sail Maker and Mender", "Sail Maker and Menders", "Sail Makers and Menders", "!", None]
    rows = [(i, "s", r.choice([None, "1", "2", "3", "4", "5", "6"]), r.choice([None, *(f"h{k}" for k in range(20))]), r.choice(titles), r.choice(["A", "B", "a", None]), r.choice(["Dubai", "Dubai", None])) for i in range(90)]
    want = folded(rows)
    assert {x[1] for x in want.values()} == {"L1", "L2", "L3", "NONE"}
    assert resolved(spark, rows, small=small) == want


@pytest.mark.parametrize(("n", "small"), [(200, 20_000), (24, 0)])
def test_resolve_batch_follows_long_chains(spark, n, small):
    """A path of employers, each linked to the next by an id or a hash, given in an order that makes it long."""
    rows = [(i, "s", str(i // 2), f"h{(i + 1) // 2}", "Cook", f"c{i}", "Dubai") for i in range(n)]
    assert resolved(spark, rows, small=small) == folded(rows)


def test_tiers_have_their_own_limits(spark):
    rows = [(tier, "1.1.1.1", k * 1000 + i, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=100 * i)) for k, tier in enumerate(("login", "refresh", "public")) for i in range(150)]
    got = limits.tier_admission(spark.createDataFrame(rows, "tier string, ip string, id long, ts timestamp")).where("admitted").groupBy("tier").count().collect()
    assert {r["tier"]: r["count"] for r in got} == {"login": 10, "refresh": 30, "public": 120}


def test_upsert_reactivates(spark):
    schema = "id long, external_source string, external_job_id string, dedup_hash string, normalized_title string, normalized_company_name string, city string, is_active boolean, apply_url string, publisher string, linkedin_easy_apply boolean, last_seen_at timestamp, duplicate_source_count int, expires_at timestamp"
    jobs = spark.createDataFrame([(1, "s", "x", "h", "T", "C", "D", False, "old", "p", None, None, 0, dt.datetime(2020, 1, 1))], schema)
    batch = spark.createDataFrame([(9, "s", "x", "h2", "T", "C", "D", True, " ", None, True, None, 0, None), (10, "s", "y", "h3", "Z", "C", "D", True, "u", "q", None, None, 0, None)], schema).withColumn("seq", F.col("id"))
    got = {r["id"]: r for r in dedup.upsert_postings(jobs, dedup.resolve(batch, jobs), "2024-01-01 00:00:00").collect()}
    assert set(got) == {1, 10} and got[1]["is_active"] and got[1]["apply_url"] == "old" and got[1]["publisher"] == "p"
    assert got[1]["linkedin_easy_apply"] and got[1]["duplicate_source_count"] == 1 and got[1]["expires_at"] == dt.datetime(2020, 1, 1)


def _events(spark, n=400):
    r = random.Random(2)
    t, rows = {}, []
    for i in range(n):
        k = r.choice("aab")
        t[k] = t.get(k, 0) + r.choice([0, 1, 5, 20, 60, 200])
        rows.append((k, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t[k])))
    return rows, spark.createDataFrame(rows, "key string, id long, ts timestamp")


def _fold(rows, step, start):
    state, out = {}, {}
    for k, i, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        out[i] = step([int(ts.timestamp() * 1_000_000)], state.setdefault(k, start()))[0]
    return out


def test_limiters_equal_a_fold(spark):
    rows, events = _events(spark)
    sliding = _fold(rows, lambda t, s: limits.admit(t, 3, 60_000_000, s), list)
    assert {r["id"]: r["admitted"] for r in limits.sliding_admission(events, 3, 60).collect()} == sliding
    bucket = _fold(rows, lambda t, s: limits.take(t, 3, 60_000_000, s), list)
    assert {r["id"]: r["admitted"] for r in limits.token_bucket(events, 3, 60).collect()} == bucket
    assert 0 < sum(sliding.values()) < len(rows)
    burst = spark.createDataFrame([("k", i, dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(11)], "key string, id long, ts timestamp")
    assert sorted(r["id"] for r in limits.sliding_admission(burst, 10, 60).where("not admitted").collect()) == [10]


def test_limiters_hold_no_whole_run(spark):
    """One key without a silence, in batches far smaller than its run: none sees more rows than a batch."""
    rows = [("k", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(500)] + [(None, 500 + i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i)) for i in range(50)]
    events = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for df, step, start in ((limits.sliding_admission(events, 3, 60), lambda t, s: limits.admit(t, 3, 60_000_000, s), list), (limits.token_bucket(events, 3, 60), lambda t, s: limits.take(t, 3, 60_000_000, s), list)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
            assert {r["id"]: r["admitted"] for r in df.collect()} == _fold(rows, step, start)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _land(spark, df, path, parts):
    for k in range(parts):
        df.where(F.col("id") % parts == k if parts > 1 else F.lit(True)).coalesce(1).write.mode("append").parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    rows, events = _events(spark, 120)
    half = sorted(rows, key=lambda x: x[2])
    for part in (half[:60], half[60:]):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, build, batch in (("sliding", ingest.sliding_admission_stream, limits.sliding_admission), ("bucket", ingest.token_bucket_stream, limits.token_bucket)):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = build(stream, 3, 60).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {r["id"]: r["admitted"] for r in spark.table(name).collect()} == {r["id"]: r["admitted"] for r in batch(events, 3, 60).collect()}


def test_ingest_stream_runs_once(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.lit("x"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    merge = lambda batch, number: seen.append((number, batch.count()))
    for _ in range(2):
        ingest.ingest_stream(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/ck", merge)
    assert seen == [(0, 10)]


PAGES = "page_id long, url string, html string"


def test_pages(spark):
    micro = f"<html><head><title>x</title></head><body><h1 itemprop='title'>Data Engineer</h1><div itemprop='description'>{'Build pipelines. ' * 9}</div><span itemprop='addressLocality'>Dubai, UAE</span><script>var a='<p>'</script></body></html>"
    og = "<html><head><title>IT Lead | Acme Careers</title><meta property='og:description' content='The Lead runs IT'><meta content='Acme' property='og:site_name'></head></html>"
    ld = '<script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">[{"@type":"JobPosting","title":"QA","description":"&lt;p&gt;Test","hiringOrganization":{"name":"B"},"jobLocation":{"address":{"addressRegion":"Ajman"}}}]</script>'
    rows = [(1, "https://careers.etisalat.com/1", micro), (2, "https://x.example/", og), (3, "https://y.example/", ld), (4, "https://jobs.du.ae/", "<p>Loading"), (5, "https://z.example/", None)]
    got = {r["page_id"]: r for r in pages.postings_from_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[1]["title"], got[1]["company_name"], got[1]["location_uae"], got[1]["complete"]) == ("Data Engineer", "Etisalat", "Dubai", True)
    assert (got[2]["title"], got[2]["company_name"], got[2]["description"]) == ("IT Lead", "Acme", "The Lead runs IT")
    assert (got[3]["title"], got[3]["company_name"], got[3]["location_uae"]) == ("QA", "B", "Ajman")
    assert got[4]["company_name"] == "Du" and not got[4]["complete"] and not got[5]["complete"]


def test_linkedin_page(spark):
    page = """<h1 class="top-card-layout__title">Senior Java Developer</h1><a class="topcard__org-name-link">Acme</a><span class="topcard__flavor topcard__flavor--bullet">Ras al-Khaimah, UAE</span>
    <div class="show-more-less-html__markup">Java and Spring Boot</div><h3 class="description__job-criteria-subheader">Seniority level</h3><span class="description__job-criteria-text">Mid-Senior level</span><div class="salary">AED 10,000 - 15,000</div>"""
    r = pages.linkedin_fields(spark.createDataFrame([(1, "https://ae.linkedin.com/jobs/view/java-at-acme-4012345678?x=1", page)], PAGES)).collect()[0]
    assert (r["linkedin_id"], r["title"], r["company_name"], r["location_uae"]) == ("4012345678", "Senior Java Developer", "Acme", "Ras Al Khaimah")
    assert (r["salary_min"], r["salary_max"], r["job_type"], r["experience_level"]) == (10000, 15000, "full_time", "senior") and r["skills"] == ["Java", "Spring Boot"]


def test_feed_edges(spark):
    raw = lambda *p: spark.createDataFrame([(x,) for x in p], "payload string")
    assert feeds.postings_from_remoteok(raw('[{"legal":"x"},{"id":7,"position":"Dev","url":"u","description":"<b>a</b>","salary_min":100}]')).collect()[0]["salary_min"] == 367
    j = feeds.postings_from_jsearch(raw('{"status":"ERROR","data":[{"job_id":"1","job_title":"t","job_apply_link":"u"}]}', '{"status":"OK","data":[{"job_id":"2","job_title":"t","apply_options":[{"apply_link":"v","publisher":"P"}],"job_highlights":{"Benefits":["Visa"]},"job_location":"Dubai • via X","job_posted_at_timestamp":86400}]}')).collect()
    assert len(j) == 1 and (j[0]["apply_url"], j[0]["publisher"], j[0]["description"], j[0]["location_uae"], str(j[0]["posted_at"])) == ("v", "P", "Benefits: Visa.", "Dubai, AE", "1970-01-02 00:00:00")
    for name, feed in feeds.FEEDS.items():
        assert feed(raw("not json", "{}", "[]", None)).count() == 0, name
