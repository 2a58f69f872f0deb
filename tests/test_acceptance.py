"""Whether a posting is accepted, without the score: the same as by the score, with less work."""

import random

from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions import text as X
from jobloom.operators import scoring
from jobloom.plans.catalog import Views

WORDS = ["Java", "Kafka", "qa", "DATA", "Cloud", "security", "Engineer", "staff", "senior", "chef", "clerk", "AWS", "python", "Kafka", "\n", "eur", "90k / year eur", "Europe", "€", "location: emea", "Location", "Dubai", "authorize to work in the UK", "authorized", "GBP", "neuro"]


def _postings(spark, n=600):
    rng = random.Random(7)
    some = lambda least, most: " ".join(rng.choices(WORDS, k=rng.randint(least, most)))
    rows = [(i, some(0, 3) if i % 9 else None, some(0, 40) if i % 11 else None, some(0, 3) if i % 2 else None) for i in range(n)]
    base = spark.createDataFrame(rows, "seq long, title string, description string, requirements string")
    return base.select("*", F.lit("Acme").alias("company_name"), F.lit("Dubai").alias("location_uae"), F.lit(None).cast("string").alias("emirate"), F.lit(None).cast("boolean").alias("remote_uae"), F.lit("u").alias("publisher"), F.lit("u").alias("apply_url"))


def test_acceptance_is_that_of_the_score(spark):
    text = F.lower(F.concat_ws(" ", X.safe("title"), X.safe("description"), X.safe("requirements")))
    rows = scoring.enrich(_postings(spark)).withColumn("relevant", scoring.is_relevant("title", "description", text)).select("reject_stage", "reject_reason", "relevance_score", "relevant").collect()
    assert all(r["relevant"] == (r["relevance_score"] >= rules.MIN_SCORE) for r in rows)
    assert all(r["reject_stage"] == ("hard" if r["reject_reason"] else None if r["relevant"] else "score") for r in rows)
    assert {r["reject_stage"] for r in rows} == {"hard", "score", None}


def test_scope_is_found_in_parts(spark):
    found = X.occurs("description", F.lower(X.safe("description")), rules.EU_SCOPES)
    rows = _postings(spark).select(found.alias("a"), X.matches("description", rules.EU_SCOPE).alias("b")).distinct().collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(False, False), (True, True)]


def test_acceptance_needs_no_score(spark, sf001):
    plan = scoring.enrich(Views(spark, sf001).postings).select("seq", "reject_stage")._jdf.queryExecution().optimizedPlan().toString()
    assert "technologies" not in plan and "tech_footprint" not in plan
    assert Views(spark, sf001).enriched("seq", "reject_stage").columns == ["seq", "reject_stage"]


def test_resolving_stores_no_texts(spark, sf001, monkeypatch):
    import __spark_entry__ as E
    from jobloom.sources import tables

    seen, stored = {}, tables.stored
    monkeypatch.setattr(tables, "stored", lambda s, df, name: stored(s, seen.setdefault(name, df), name))
    assert E.queries()["h05_resolve_batch"](spark, sf001).count() == 101
    assert not {"description", "requirements", "technologies", "relevance_score"} & set(seen["enriched"].columns)
