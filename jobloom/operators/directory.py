"""Publishers and the company directory, built by aggregating jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions import text as X


def active_publishers(jobs: DataFrame, min_count: int = 0) -> DataFrame:
    """key, label, cnt of publishers of active jobs; a LinkedIn job without that tag counts there too."""
    active = jobs.where("is_active")
    lower, bare = F.lower("publisher"), F.trim("publisher")
    cases = [(lower.contains(k), k, label) for k, label in rules.PUBLISHERS]
    named = active.where(F.col("publisher").isNotNull() & (F.col("publisher") != "") & ~lower.contains("remoteok"))
    named = named.select(X.first_match([(c, k) for c, k, _ in cases], F.lower(bare)).alias("key"), X.first_match([(c, label) for c, _, label in cases], bare).alias("label"))
    untagged = active.where(F.col("linkedin_url").isNotNull() & ~F.coalesce(lower, F.lit("")).contains("linkedin")).select(F.lit("linkedin").alias("key"), F.lit("LinkedIn").alias("label"))
    return named.unionByName(untagged).groupBy("key", "label").agg(F.count("*").alias("cnt")).where(F.col("cnt") > min_count)


def company_name_valid(column="company_name"):
    return F.col(column).isNotNull() & (F.trim(column) != "") & ~F.lower(column).isin("unknown", "confidential")


def aggregator_url(column, wide: bool = False):
    return X.matches(column, rules.AGGREGATORS_WIDE if wide else rules.AGGREGATORS)


def company_stats(jobs: DataFrame) -> DataFrame:
    """Per company: newest non-empty link and domain, most frequent place and category (ties: the smallest), count."""
    # Ties in time go to the larger id, so that the result does not depend on the order of rows.
    at = F.struct("created_at", "id")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), at))
    return jobs.where(company_name_valid()).groupBy("company_name").agg(
        newest("apply_url").alias("apply_url"), newest("company_domain").alias("domain"), F.mode("emirate", True).alias("top_emirate"), F.mode("job_category", True).alias("top_category"), F.count("*").alias("job_count")
    )


def directory_from_jobs(jobs: DataFrame) -> DataFrame:
    stats = company_stats(jobs)
    site = F.concat(F.lit("https://"), F.col("domain"))
    own = F.col("apply_url").isNotNull() & ~aggregator_url("apply_url")
    rows = stats.where(own | F.col("domain").isNotNull()).select(
        F.col("company_name").alias("name"),
        X.directory_slug("company_name").alias("slug"),
        X.directory_category("top_category").alias("category"),
        X.directory_city("top_emirate").alias("city"),
        F.coalesce(F.when(own, F.nullif(F.regexp_extract("apply_url", "^(https?://[^/]+)", 1), F.lit(""))), site).alias("careers_url"),
        site.alias("website_url"),
        X.first_match([(F.col("job_count") >= 10, "ACTIVE_HIRING"), (F.col("job_count") >= 3, "FREQUENT_HIRING")], "OCCASIONAL").alias("hiring_status"),
        F.lit("APPROVED").alias("status"),
    )
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("slug").orderBy("name"))).where("_k = 1").drop("_k")


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target and those of rows whose key it lacks, one for each key (the first by all columns)."""
    rows = rows.select(target.columns)
    fresh = rows.join(target.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("_r")).select("_r.*")
    return target.unionByName(fresh.select(target.columns))


def whitelist(companies: DataFrame, anchors: DataFrame) -> DataFrame:
    """Companies on the anchor list (slug), and all that a user submitted."""
    listed = companies.join(anchors.select("slug").distinct().withColumn("_listed", F.lit(True)), "slug", "left")
    return listed.where(F.col("_listed") | F.col("submitted_by").isNotNull()).drop("_listed")


def drop_aggregators(companies: DataFrame) -> DataFrame:
    return companies.where(~aggregator_url("careers_url", wide=True))


def filter_values(companies: DataFrame) -> DataFrame:
    """kind and value of all approved cities and categories."""
    approved = companies.where("status = 'APPROVED'")
    parts = [approved.select(F.lit(k).alias("kind"), F.col(k).alias("value")).where("value is not null") for k in ("city", "category")]
    return parts[0].unionByName(parts[1]).distinct()


def submissions_last_day(companies: DataFrame, as_of, most: int = 5) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    counted = companies.where(F.col("submitted_by").isNotNull() & (F.col("created_at") > since)).groupBy("submitted_by").agg(F.count("*").alias("n"))
    return counted.withColumn("at_limit", F.col("n") >= most)


def submission_check(new: DataFrame, companies: DataFrame) -> DataFrame:
    """new whose name (in any case) and slug are both unknown."""
    free = new.join(companies.select(F.lower("name").alias("_name")), F.lower("name") == F.col("_name"), "left_anti")
    return free.join(companies.select(F.col("slug").alias("_slug")), F.col("slug") == F.col("_slug"), "left_anti")


def apply_patches(target: DataFrame, patch: DataFrame, key: str, optional: list[str]) -> DataFrame:
    """Non-null fields of patch replace target's; blank ones clear optional fields."""
    fields = [c for c in patch.columns if c != key]
    joined = target.join(patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    new = {c: F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.when(X.is_blank(F.col(f"_{c}").cast("string")), F.lit(None)).otherwise(F.col(f"_{c}")) if c in optional else F.col(f"_{c}")) for c in fields}
    return joined.withColumns(new).select(target.columns)


def new_keywords(suggested: DataFrame, existing: DataFrame) -> DataFrame:
    """keyword, category and status (added, existing, invalid) of suggestions; of several spellings in any
    case only the first is added."""
    valid = ~X.is_blank("keyword") & (F.length("keyword") <= 255)
    category = F.when(F.col("category").isin("role", "skill", "location", "company"), F.col("category")).otherwise("role")
    rows = suggested.withColumn("_key", F.lower(F.trim("keyword")))
    known = existing.select(F.lower("keyword").alias("_key")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "_key", "left").withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy("keyword", "category")))
    status = X.first_match([(~valid, "invalid"), (F.col("_known") | (F.col("_k") > 1), "existing")], "added")
    return rows.select("keyword", category.alias("category"), status.alias("status"))


def skill_suggestions(jobs: DataFrame, q: str, most: int = 10) -> DataFrame:
    """The first skills of jobs whose skills hold q anywhere."""
    hit = F.lower(F.to_json("skills")).contains(q.lower())
    return jobs.where(hit).select(F.explode("skills").alias("skill")).distinct().orderBy("skill").limit(most)


def sitemap_entries(jobs: DataFrame, companies: DataFrame, base: str, cap: int = 5000) -> DataFrame:
    """loc, lastmod, changefreq, priority of fixed pages, the newest active jobs and approved companies."""
    spark = jobs.sparkSession
    kind = "loc string, lastmod date, changefreq string, priority string"
    fixed = spark.createDataFrame([(f"{base}/", None, "daily", "1.0"), (f"{base}/jobs", None, "hourly", "0.9"), (f"{base}/companies", None, "weekly", "0.7")], kind)
    newest = jobs.where("is_active").orderBy(F.desc("created_at"), "id").limit(cap)
    entry = lambda df, path, key, at, often, weight: df.select(F.concat(F.lit(f"{base}/{path}/"), F.col(key).cast("string")).alias("loc"), F.to_date(at).alias("lastmod"), F.lit(often).alias("changefreq"), F.lit(weight).alias("priority"))
    return fixed.unionByName(entry(newest, "jobs", "id", "updated_at", "daily", "0.8")).unionByName(entry(companies.where("status = 'APPROVED'"), "companies", "slug", "created_at", "weekly", "0.6"))
