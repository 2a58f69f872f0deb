"""Long texts are read once for each thing that is looked for in them."""

from pyspark.sql import functions as F

from jobloom.functions import text as X
from jobloom.operators import scoring


def test_scores_search_a_text_once(spark):
    reasons = str(scoring.relevance_reasons("title", "description", F.col("n_found")))
    # Before, both were worked out four times.
    assert reasons.count("regexp_count(") == 1 and reasons.count("n_found") == 1
    assert "split(" not in str(X.extract_technologies("description"))
    rows = spark.createDataFrame([("Senior QA", "Java, software and data; gopher, Go. İT Kafka kafka", 1), ("Cook", None, 2)], "title string, description string, seq long")
    scored = rows.select("seq", scoring.relevance_score(scoring.relevance_reasons("title", "description", F.size(X.extract_technologies("description")))).alias("score"))
    assert {r["seq"]: r["score"] for r in scored.collect()} == {1: 40 + 24 + 2 + 10, 2: 0}


def test_ingest_columns_work_a_text_out_once(spark):
    once = lambda c: str(c).count("description")
    # Before, a text was put together and lowered again for every pattern that it was searched for.
    assert once(X.classify_seniority("title", "description")) == 1
    assert once(X.classify_work_mode("title", "description", "remote_uae")) == 1
    assert str(X.normalize_title("title")).count("title") <= 3


def test_categories_lower_a_text_once(spark):
    assert str(X.classify_category("title", "description")).count("description") == 1
