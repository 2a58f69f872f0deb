"""Aggregations and set queries (groups E and H of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.operators import activity, directory, maintenance
from jobloom.plans.adapters import AS_OF, EVENTS_AS_OF, EVENTS_NOW, NOW
from jobloom.plans.catalog import Views, query


@query("e01_public_stats", "SELECT count(*) FILTER (WHERE is_active) AS active_jobs, count(DISTINCT CASE WHEN is_active THEN company_name END) AS companies, (SELECT count(*) FROM users) AS users FROM jobs")
def public(v: Views):
    return activity.public_stats(v.jobs, v.users)


@query("e02_admin_stats", "SELECT count(*) AS users, count(*) FILTER (WHERE user_type = 'job_seeker') AS job_seeker, count(*) FILTER (WHERE user_type = 'hr') AS hr, count(*) FILTER (WHERE user_type = 'admin') AS admin, 499 * count(*) FILTER (WHERE user_type = 'hr') AS revenue, (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM applications) AS applications FROM users")
def admin(v: Views):
    return activity.admin_stats(v.users, v.jobs, v.applications)


_SINCE = lambda c, d: f"count(*) FILTER (WHERE {c} > {AS_OF} - INTERVAL {d} DAY)"


@query("e03_user_activity", f"SELECT count(*) AS total, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE NOT verified) AS pending, {_SINCE('last_login', 1)} AS active_1d, {_SINCE('last_login', 7)} AS active_7d, {_SINCE('last_login', 30)} AS active_30d, count(*) FILTER (WHERE last_login IS NULL) AS never_logged_in, {_SINCE('created_at', 7)} AS new_7d, {_SINCE('created_at', 30)} AS new_30d FROM users")
def users(v: Views):
    return activity.user_activity(v.users, NOW)


@query("e04_active_sessions", f"SELECT count(*) AS active_sessions FROM tokens WHERE NOT revoked AND expires_at > {EVENTS_AS_OF}")
def sessions(v: Views):
    return activity.active_sessions(v.tokens, EVENTS_NOW)


@query("e05_login_health", f"SELECT count(*) AS attempts, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, CASE WHEN count(*) = 0 THEN 0.0 ELSE floor(1000 * count(*) FILTER (WHERE success) / count(*) + 0.5) / 10 END AS success_rate FROM login_attempts WHERE created_at >= date_trunc('day', {EVENTS_AS_OF})")
def health(v: Views):
    return activity.login_health(v.login_attempts, EVENTS_NOW)


@query("e06_failure_breakdown", "SELECT failure_reason, count(*) AS n FROM login_attempts WHERE NOT success AND created_at > TIMESTAMP '2024-01-05 00:00:00' GROUP BY failure_reason")
def breakdown(v: Views):
    return activity.failure_breakdown(v.login_attempts, "2024-01-05 00:00:00")


@query("e07_repeated_failures", f"SELECT user_id, count(*) AS failures FROM login_attempts WHERE NOT success AND user_id IS NOT NULL AND created_at > {EVENTS_AS_OF} - INTERVAL 20 DAY GROUP BY user_id HAVING count(*) >= 3")
def repeated(v: Views):
    return activity.repeated_failures(v.login_attempts, activity.ago(EVENTS_NOW, "20 DAYS"))


@query("e08_top_countries", "SELECT country, count(*) AS n FROM users WHERE trim(country) <> '' GROUP BY country ORDER BY n DESC, country LIMIT 8")
def countries(v: Views):
    return activity.top_countries(v.users)


_CASE = lambda out: "CASE " + " ".join(f"WHEN contains(lower(publisher), '{k}') THEN '{(k, label)[out]}'" for k, label in rules.PUBLISHERS)


@query("e09_active_publishers", f"SELECT key, label, count(*) AS cnt FROM (SELECT {_CASE(0)} ELSE lower(trim(publisher)) END AS key, {_CASE(1)} ELSE trim(publisher) END AS label FROM jobs WHERE is_active AND publisher IS NOT NULL AND publisher <> '' AND NOT contains(lower(publisher), 'remoteok') UNION ALL SELECT 'linkedin', 'LinkedIn' FROM jobs WHERE is_active AND linkedin_url IS NOT NULL AND NOT contains(lower(coalesce(publisher, '')), 'linkedin')) GROUP BY key, label HAVING count(*) > 5")
def publishers(v: Views):
    return directory.active_publishers(v.jobs, 5)


_VALID = "company_name IS NOT NULL AND trim(company_name) <> '' AND lower(company_name) NOT IN ('unknown', 'confidential')"


def _newest(c: str) -> str:
    return f"max_by({c}, ROW(created_at, id)) FILTER (WHERE {c} IS NOT NULL AND {c} <> '')"


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM jobs m WHERE m.company_name = j.company_name AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


_STATS = f"SELECT company_name, {_newest('apply_url')} AS apply_url, {_newest('company_domain')} AS domain, {_mode('emirate')} AS top_emirate, {_mode('job_category')} AS top_category, count(*) AS job_count FROM jobs j WHERE {_VALID} GROUP BY company_name"


@query("e10_company_stats", _STATS)
def stats(v: Views):
    return directory.company_stats(v.jobs)


_MAP = lambda c, names, other: f"CASE lower(coalesce({c}, '')) " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in names.items()) + f" ELSE {other} END"
_OWN = f"(apply_url IS NOT NULL AND NOT regexp_matches(apply_url, '(?i){rules.AGGREGATORS}'))"


@query("e11_directory_from_jobs", f"WITH s AS ({_STATS}), d AS (SELECT company_name AS name, trim(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {_MAP('top_category', rules.DIRECTORY_CATEGORIES, 'NULL')} AS category, {_MAP('top_emirate', rules.DIRECTORY_CITIES, chr(39) + 'UAE-wide' + chr(39))} AS city, coalesce(CASE WHEN {_OWN} THEN nullif(regexp_extract(apply_url, '^(https?://[^/]+)', 1), '') END, 'https://' || domain) AS careers_url, 'https://' || domain AS website_url, CASE WHEN job_count >= 10 THEN 'ACTIVE_HIRING' WHEN job_count >= 3 THEN 'FREQUENT_HIRING' ELSE 'OCCASIONAL' END AS hiring_status, 'APPROVED' AS status FROM s WHERE {_OWN} OR domain IS NOT NULL) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY slug ORDER BY name) = 1")
def from_jobs(v: Views):
    return directory.directory_from_jobs(v.jobs)


@query("e12_jobs_per_source", "SELECT source, count(*) AS n FROM jobs GROUP BY source")
def per_source(v: Views):
    return maintenance.jobs_per_source(v.jobs)


_N = lambda *o: f"count(*) FILTER (WHERE outcome IN ({', '.join(repr(x) for x in o)}))"
_TALLY = f"SELECT source, keyword, count(*) AS fetched, {_N('rejected_hard', 'error')} AS rejected_hard, {_N('rejected_score')} AS rejected_score, {_N('L1')} AS duplicates_l1, {_N('L2')} AS duplicates_l2, {_N('L3')} AS duplicates_l3, {_N('inserted')} AS inserted FROM runs GROUP BY source, keyword"


@query("e13_run_tally", _TALLY)
def tally(v: Views):
    return maintenance.run_tally(v.runs)


@query("e14_keyword_counters", f"SELECT k.id, k.inserted + coalesce(r.i, 0) AS inserted, k.duplicates + coalesce(r.d, 0) AS duplicates, CASE WHEN r.i IS NOT NULL THEN {AS_OF} ELSE k.last_run_at END AS last_run_at FROM keywords k LEFT JOIN (SELECT p_name AS keyword, sum(l_linenumber) AS i, count(*) AS d FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_name) r ON r.keyword = k.keyword")
def counters(v: Views):
    run = v.lineitem.join(v.part, F.col("p_partkey") == F.col("l_partkey"))
    run = run.groupBy(F.col("p_name").alias("keyword")).agg(F.sum("l_linenumber").alias("inserted"), F.count("*").alias("duplicates"))
    return maintenance.keyword_counters(v.keywords, run, NOW).select("id", "inserted", "duplicates", "last_run_at")


@query("e15_directory_filter_values", "SELECT DISTINCT 'city' AS kind, city AS value FROM companies WHERE status = 'APPROVED' UNION ALL SELECT DISTINCT 'category', category FROM companies WHERE status = 'APPROVED'")
def values(v: Views):
    return directory.filter_values(v.companies)


@query("e16_skill_suggestions", "SELECT DISTINCT unnest(split(skills_text, ',')) AS skill FROM jobs WHERE contains(skills_text, 'java') ORDER BY skill LIMIT 10")
def skills(v: Views):
    return directory.skill_suggestions(v.jobs.withColumn("skills", F.split("skills_text", ",")), "java")


@query("e17_submissions_last_day", f"SELECT submitted_by, count(*) AS n, count(*) >= 5 AS at_limit FROM companies WHERE submitted_by IS NOT NULL AND created_at > {AS_OF} - INTERVAL 24 HOUR GROUP BY submitted_by")
def submitted(v: Views):
    return directory.submissions_last_day(v.companies, NOW)


@query("e18_applications_per_job", "SELECT job_id, count(*) AS n FROM applications GROUP BY job_id")
def per_job(v: Views):
    return activity.applications_per_job(v.applications)


@query("e19_ingest_report_total", "SELECT count(*) AS inserted FROM runs WHERE outcome = 'inserted'")
def total(v: Views):
    return maintenance.ingest_report_total(maintenance.run_tally(v.runs))


_DAYS = f"CAST(floor((epoch_us({EVENTS_AS_OF}) - epoch_us(created_at)) / 86400000000) AS BIGINT)"
_WAIT = f"'Waiting for ' || CAST({_DAYS} AS STRING) || ' days'"
_NEVER = f"verified AND last_login IS NULL AND created_at < {EVENTS_AS_OF} - INTERVAL 3 DAY"


FRICTION_SQL = f"SELECT m.id AS user_id, 'REPEATED_FAILURES' AS signal, CASE WHEN f.n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 0 AS days, CAST(f.n AS STRING) || ' failed sign-ins in 24 hours' AS message, 'RESET_PASSWORD' AS action FROM members m JOIN (SELECT user_id, count(*) AS n FROM login_attempts WHERE NOT success AND user_id IS NOT NULL AND created_at > {EVENTS_AS_OF} - INTERVAL 1 DAY GROUP BY user_id HAVING count(*) >= 3) f ON f.user_id = m.id UNION ALL SELECT id, 'EMPLOYER_INACTIVE', CASE WHEN {_DAYS} >= 7 THEN 'HIGH' ELSE 'MEDIUM' END, {_DAYS}, {_WAIT}, 'SEND_WELCOME' FROM members WHERE {_NEVER} AND user_type = 'hr' UNION ALL SELECT id, 'VERIFIED_NEVER_LOGIN', 'LOW', {_DAYS}, {_WAIT}, 'SEND_WELCOME' FROM members WHERE {_NEVER} AND user_type <> 'hr' UNION ALL SELECT id, 'STUCK_PENDING_LONG', CASE WHEN {_DAYS} >= 7 THEN 'HIGH' WHEN {_DAYS} >= 3 THEN 'MEDIUM' ELSE 'LOW' END, {_DAYS}, {_WAIT}, 'RESEND_VERIFICATION' FROM members WHERE NOT verified AND created_at < {EVENTS_AS_OF} - INTERVAL 2 DAY"


@query("h02_friction_signals", FRICTION_SQL)
def friction(v: Views):
    return activity.order_friction(activity.friction_signals(v.members, v.login_attempts, EVENTS_NOW))


@query("a18_sitemap_entries", "SELECT * FROM (VALUES ('https://jobs.example/', NULL::DATE, 'daily', '1.0'), ('https://jobs.example/jobs', NULL, 'hourly', '0.9'), ('https://jobs.example/companies', NULL, 'weekly', '0.7')) AS f(loc, lastmod, changefreq, priority) UNION ALL SELECT * FROM (SELECT 'https://jobs.example/jobs/' || CAST(id AS STRING), CAST(updated_at AS DATE), 'daily', '0.8' FROM jobs WHERE is_active ORDER BY created_at DESC, id LIMIT 5000) UNION ALL SELECT 'https://jobs.example/companies/' || slug, CAST(created_at AS DATE), 'weekly', '0.6' FROM companies WHERE status = 'APPROVED'")
def sitemap(v: Views):
    return directory.sitemap_entries(v.jobs, v.companies, "https://jobs.example")
