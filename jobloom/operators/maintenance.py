"""Keyword rotation, run tallies and jobs that run by the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.activity import ago, now


def rotation_score(as_of):
    stale = F.when(F.col("last_run_at").isNull(), 1.5).when(F.col("last_run_at") < ago(as_of, "24 HOURS"), 1.25).otherwise(1.0)
    return F.col("weight").cast("double") * (1 + F.ln(1 + F.col("inserted"))) / (1 + F.col("duplicates")) * stale


def pick_keywords(keywords: DataFrame, picks: dict[int, int], as_of) -> DataFrame:
    """The best active keywords of each tier: picks gives how many; ties go to the one that waits longest."""
    order = Window.partitionBy("tier").orderBy(F.desc("score"), F.col("last_run_at").asc_nulls_first(), "id")
    most = F.create_map(*[F.lit(x) for pair in picks.items() for x in pair])[F.col("tier")]
    ranked = keywords.where("active").withColumn("score", rotation_score(as_of)).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= F.coalesce(most, F.lit(0)))


def keywords_by_tier(keywords: DataFrame) -> DataFrame:
    return keywords.orderBy("tier", "keyword", "id")


def run_tally(outcomes: DataFrame) -> DataFrame:
    """Per source and keyword: rows by outcome; whatever could not be stored counts as rejected."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return outcomes.groupBy("source", "keyword").agg(
        F.count("*").alias("fetched"), n("rejected_hard", "error").alias("rejected_hard"), n("rejected_score").alias("rejected_score"), n("L1").alias("duplicates_l1"), n("L2").alias("duplicates_l2"), n("L3").alias("duplicates_l3"), n("inserted").alias("inserted")
    )


def keyword_counters(keywords: DataFrame, tally: DataFrame, as_of) -> DataFrame:
    """keywords with the totals of a run (keyword, inserted, duplicates) added."""
    run = tally.groupBy("keyword").agg(F.sum("inserted").alias("_i"), F.sum("duplicates").alias("_d"))
    joined = keywords.join(run, "keyword", "left")
    ran = F.col("_i").isNotNull()
    return joined.withColumns({"inserted": F.col("inserted") + F.coalesce("_i", F.lit(0)), "duplicates": F.col("duplicates") + F.coalesce("_d", F.lit(0)), "last_run_at": F.when(ran, now(as_of)).otherwise(F.col("last_run_at"))}).select(keywords.columns)


def jobs_per_source(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source").agg(F.count("*").alias("n"))


def ingest_report_total(tally: DataFrame) -> DataFrame:
    return tally.agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"))


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "id").limit(min(max(n, 1), 50))


def expire_jobs(jobs: DataFrame, as_of) -> DataFrame:
    due = F.col("is_active") & (F.col("expires_at") < now(as_of))
    return jobs.withColumns({"updated_at": F.when(due, now(as_of)).otherwise(F.col("updated_at")), "is_active": F.col("is_active") & ~due})


def refresh_long_running(jobs: DataFrame, as_of) -> DataFrame:
    old = F.col("is_active") & (F.col("updated_at") < ago(as_of, "7 DAYS"))
    return jobs.withColumn("updated_at", F.when(old, now(as_of)).otherwise(F.col("updated_at")))


def close_stale_runs(runs: DataFrame, as_of) -> DataFrame:
    stale = F.col("finished_at").isNull() & (F.col("started_at") < ago(as_of, "10 MINUTES"))
    return runs.withColumns({"error": F.when(stale, "Run did not finish"), "finished_at": F.when(stale, now(as_of)).otherwise(F.col("finished_at"))})


def purge_tokens(tokens: DataFrame, as_of) -> DataFrame:
    return tokens.where(~(F.col("revoked") | (F.col("expires_at") < now(as_of))))


def purge_source(jobs: DataFrame, source: str) -> DataFrame:
    return jobs.where(~F.col("source").eqNullSafe(source))


def backfill_columns(jobs: DataFrame) -> DataFrame:
    """raw_title, normalized_title, normalized_company_name and city where they are missing."""
    blank_null = lambda c: F.nullif(F.trim(c), F.lit(""))
    return jobs.withColumns({"raw_title": F.col("title"), "normalized_title": F.col("title"), "normalized_company_name": F.col("company_name"), "city": F.coalesce(blank_null(F.split_part("location_uae", F.lit(","), F.lit(1))), F.col("emirate"))})


def view_counts(jobs: DataFrame, views: DataFrame) -> DataFrame:
    """id and n of views of active jobs."""
    return views.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n")).join(jobs.where("is_active").select("id"), "id", "left_semi")
