"""Countries and places in long texts: searched for in parts, with the same result as by the whole patterns."""

import random

from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions import text as X
from jobloom.operators import scoring
from jobloom.plans.catalog import Views

WORDS = ["Dubai", "ABU  Dhabi", "abudhabi", "U.A.E", "UAE", "uaed", "United Arab Emirates", "ras\tal khaimah", "khaimah", "India", "Indiana", "sri lanka", "USA", "usage", "UK", "duk", "€", "Europe", "eur", "Location: EMEA", "oman", "Roman", "ümm al Quwain", "DUBAİ"]


def _rows(spark):
    rng = random.Random(11)
    rows = [(i, "Java Developer", rng.choice(["Dubai", "Remote (UAE-friendly)", None]), " ".join(rng.choices(WORDS, k=rng.randint(0, 4))) if i % 50 else None) for i in range(1500)]
    return spark.createDataFrame(rows, "seq long, title string, place string, description string")


def test_reasons_are_those_of_the_whole_patterns(spark):
    desc, remote = F.lower(X.safe("description")), F.lower(X.safe("place")) == rules.GENERIC_REMOTE
    foreign, uae = X.matches(desc, rules.OTHER_COUNTRY), X.matches(desc, rules.UAE_PLACE)
    want = F.when(remote & foreign & ~uae, "foreign_remote").when(X.matches("description", rules.EU_SCOPE) & ~X.matches("description", rules.UAE_PLACE), "eu_scope")
    got = _rows(spark).select(scoring.reject_reason("title", "place", F.lit("AE"), "description").alias("got"), want.alias("want")).distinct().collect()
    assert {tuple(r) for r in got} == {(None, None), ("foreign_remote",) * 2, ("eu_scope",) * 2}


def test_long_texts_are_not_searched_for_whole_patterns(spark, sf001):
    reason = scoring.reject_reason("title", "location_uae", F.lit("AE"), "description")
    plan = Views(spark, sf001).postings.select(reason.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    # Once for the short location alone.
    assert plan.count(rules.UAE_PLACE) == 1
