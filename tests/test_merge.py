"""Versioned snapshots, the merging stream, templated titles and hot keys of the limiters."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from jobloom.operators import dedup, limits
from jobloom.sources.snapshots import Snapshots
from jobloom.streaming.ingest import JOBS, merge_postings
from tests.test_operators import POST, folded


def _bytes(path) -> int:
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_update_writes_touched_buckets_only(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/t", _parse_datatype_string("id long, v string"), width=200)
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v"))
    table.publish(0, rows)
    change = lambda old: old.withColumn("v", F.when(F.col("id") == 19_950, "changed").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(20_100, "new")], "id long, v string"))
    ids = spark.createDataFrame([(19_950,), (20_100,)], "id long")
    assert table.update(1, ids, change) == 2
    assert table.update(1, ids, change) == 0 and table.latest() == 1
    assert _bytes(f"{tmp_path}/t/data/version=1") < 0.02 * _bytes(f"{tmp_path}/t/data/version=0")
    got = {r["id"]: r["v"] for r in table.read().collect()}
    want = {r["id"]: r["v"] for r in rows.collect()} | {19_950: "changed", 20_100: "new"}
    assert got == want and table.read(0).count() == 20_000


def test_unpublished_version_is_not_seen(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/t", _parse_datatype_string("id long, v string"))
    assert table.latest() == -1 and table.read().count() == 0
    table.publish(0, spark.createDataFrame([(1, "a")], "id long, v string"))
    spark.createDataFrame([(2, "b", 0)], "id long, v string, _bucket long").write.partitionBy("_bucket").parquet(f"{tmp_path}/t/data/version=1")
    assert [r["id"] for r in table.read().collect()] == [1]
    table.publish(1, spark.createDataFrame([(3, None)], "id long, v string"), {0})
    assert [(r["id"], r["v"]) for r in table.read().collect()] == [(3, None)]


def test_merging_twice_changes_nothing(spark, tmp_path):
    schema = "seq long, external_job_id string, source string, publisher string, title string, company_name string, description string, requirements string, location_uae string, emirate string, salary_min int, salary_max int, apply_url string, remote_uae boolean, linkedin_easy_apply boolean"
    text = "We use Java, Spring Boot and Kafka on AWS in Dubai. Senior engineer for data platform and cloud."
    row = lambda i, job, title, url: (i, job, "s", None, title, "Acme", text, None, "Dubai", "dubai", None, None, url, None, None)
    table = Snapshots(spark, f"{tmp_path}/t", _parse_datatype_string(JOBS), width=10)
    table.publish(0, table.read())
    first = spark.createDataFrame([row(1, "a", "Java Developer", "u1"), row(2, "a", "Python Developer", "u2")], schema)
    second = spark.createDataFrame([row(11, "a", "Cloud Architect", "u3"), row(12, "b", "Java Developer", None), row(13, "b", "Data Engineer", "u4"), row(14, None, "DevOps Engineer", None)], schema)
    assert merge_postings(table, first, 0, "2024-01-01") == 1
    assert merge_postings(table, second, 1, "2024-01-02") == 2
    assert merge_postings(table, second, 1, "2024-01-03") == 0
    got = {r["id"]: (r["apply_url"], r["duplicate_source_count"]) for r in table.read().collect()}
    assert got == {1: ("u3", 3), 13: ("u4", 0), 14: (None, 0)}


def test_templated_titles_meet_leaders_only(spark):
    """Titles of one kind in one block, most of them near each other: equal to a fold, in chunks."""
    rows = [(i, "s", None, None, f"Senior Software Engineer for Cloud Platform {i * 7919 % 1000}", "Acme", "Dubai") for i in range(900)]
    rows += [(900 + i, "s", str(i % 50), None, f"Cook number {i}", "Acme", "Dubai") for i in range(100)]
    got = {r["seq"]: (r["leader"], r["level"]) for r in dedup.resolve_batch(spark.createDataFrame(rows, POST), first=100).collect()}
    assert got == folded(rows)


def test_similar_titles_are_all_found(spark):
    r = random.Random(9)
    words = ["senior", "engineer", "data", "cloud", "lead", "a", "qa", "42", "43", "é"]
    titles = [(r.choice("xy"), " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for _ in range(160)]
    ours, theirs = (spark.createDataFrame(sorted(set(t)), "b string, title string") for t in (titles[:90], titles[60:]))
    cross = ours.join(theirs.withColumnRenamed("title", "other"), "b").withColumn("like", dedup.trigram_similarity("title", "other"))
    for least in (0.5, 0.85):
        for hot in (3, 20_000):
            got = {tuple(x) for x in dedup.similar_titles(ours, theirs, ["b"], least, hot).collect()}
            assert got == {tuple(x) for x in cross.where(F.col("like") >= least).select("b", "title", "other", "like").collect()}


@pytest.mark.parametrize("gap", [1, 40])
def test_hot_key_is_spread_over_parts(spark, gap):
    """One key with nine of ten events, over many ranges; at gap 1 it never rests, so that folds keep their phase."""
    r, t, rows = random.Random(2), 0, []
    for i in range(3000):
        t += r.choice([0, 1, 1, 2, gap])
        rows.append(("hot" if r.random() < 0.9 else r.choice(["a", None]), i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)))
    events = spark.createDataFrame(rows, "key string, id long, ts timestamp")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for build, limiter in ((limits.sliding_admission, limits.sliding(5, 30_000_000)), (limits.token_bucket, limits.bucket(5, 30_000_000))):
            state, want = {}, {}
            for k, i, ts in rows:
                want[i] = limiter.step([int(ts.timestamp() * 1_000_000)], state.setdefault(k, []))[0]
            assert {x["id"]: x["admitted"] for x in build(events, 5, 30).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_jumps_equal_single_steps():
    """Refused events are passed over; visiting each gives the same."""
    r = random.Random(5)
    for _ in range(200):
        times, t = [], 0
        for _ in range(r.randint(0, 60)):
            t += r.choice([0, 1, 3, 10, 35])
            times.append(t)
        for step, capacity, window in ((limits.admit, r.randint(1, 4), 20), (limits.take, r.randint(1, 4), 20)):
            whole, held, state = step(times, capacity, window, []), [], []
            single = []
            for t in times:
                if step is limits.admit:
                    held = [x for x in held if x > t - window]
                    single.append(len(held) < capacity)
                    held += [t] * single[-1]
                else:
                    left, last = state or (capacity * window, t)
                    left = min(capacity * window, left + (t - last) * capacity)
                    single.append(left >= window)
                    state = [left - window * single[-1], t]
            assert whole == single


def test_pages_by_cursor_are_pages_by_offset(spark):
    """Nulls, ties and both directions; a deep page as well as the first."""
    from jobloom.operators import search

    r = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, r.choice([None, 1, 2, 3]), r.choice([None, 2, 5]), r.choice([None, day, day + dt.timedelta(days=1)]), r.choice(["", "x" * 400])) for i in range(150)]
    jobs = spark.createDataFrame(rows, "id long, salary_min int, salary_max int, created_at timestamp, description string").coalesce(1)
    for sort in ("newest", "date_asc", "salary_desc", "salary_asc"):
        keys = search.sort_keys(sort)
        want = [x["id"] for x in jobs.orderBy(*search.order_of(keys)).collect()]
        cursor, got = None, []
        while part := search.page_after(jobs, keys, cursor, 37).collect():
            cursor = part[-1][search.CURSOR]
            got += [x["id"] for x in part]
        assert got == want


def test_late_failures_are_dropped(spark):
    import __spark_entry__ as E

    got = E.queries()["i11_login_failures_windowed"](spark, "/root/testdata/sf0.001").agg(F.sum("failures")).first()[0]
    failed = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type not in ('click', 'view', 'purchase') and event_id % 9 <> 0").count()
    assert 0.9 * 24 * failed < got < 24 * failed
