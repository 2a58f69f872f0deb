"""Search, order and set queries (groups A, C, D, F, G, H of the inventory)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions import text as X
from jobloom.operators import activity, dedup, directory, limits, maintenance, scoring, search
from jobloom.plans.adapters import AS_OF, EVENTS_AS_OF, EVENTS_NOW, NOW
from jobloom.plans.catalog import Views, query
from jobloom.plans.stats_queries import FRICTION_SQL
from jobloom.plans.text_queries import ENRICHED
from jobloom.sources.tables import shared_folder, stored

_LISTED = "lower(coalesce(publisher, '') || chr(10) || coalesce(apply_url, ''))"
MULTI = dict(emirates=["dubai", "abu_dhabi", "sharjah"], levels=["senior_5_plus", "mid_3_5_yrs"], job_types=["part_time", "internship"], after="1992-03-01 00:00:00", salary_min=200, salary_max=6000, publishers=["linkedin", "bayt", "naukri"], mode="external")
MULTI_SQL = f"""is_active AND emirate IN ('dubai', 'abu_dhabi', 'sharjah') AND experience_level IN ('senior_5_plus', 'mid_3_5_yrs') AND job_type IN ('part_time', 'internship') AND coalesce(posted_at, created_at) >= TIMESTAMP '1992-03-01 00:00:00'
    AND coalesce(salary_min, salary_max) >= 200 AND coalesce(salary_min, salary_max) <= 6000 AND (contains({_LISTED}, 'linkedin') OR contains({_LISTED}, 'bayt') OR contains({_LISTED}, 'naukri') OR linkedin_url IS NOT NULL) AND (apply_url IS NOT NULL OR linkedin_url IS NOT NULL)"""
NEWEST_SQL = "created_at - CASE WHEN length(coalesce(description, '')) < 300 THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END"


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("a01_read_table", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns FROM {t}" for t in _TABLES))
def read(v: Views):
    tables = {t: getattr(v, t) for t in _TABLES}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(len(df.columns)).cast("long").alias("n_columns")) for t, df in tables.items()])


def _first_page(df, *columns):
    """The first hundred rows, newest first, with their places."""
    order = search.job_order("newest")
    # At most 100 rows: the page.
    return search.page(df, order, 0, 100).select(F.row_number().over(Window.orderBy(*order)).alias("place"), *columns)


def _page_sql(columns: str, where: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {NEWEST_SQL} DESC, created_at DESC, id) AS place, {columns} FROM jobs WHERE {where} QUALIFY place <= 100"


@query("c05_filter_jobs", _page_sql("id, title", "is_active AND job_type = 'contract' AND emirate = 'dubai' AND NOT remote_uae AND list_contains(split(skills_text, ','), 'python')"))
def filter_single(v: Views):
    jobs = v.jobs.withColumn("skills", F.split("skills_text", ","))
    return _first_page(search.filter_jobs(jobs, job_type="contract", emirate="dubai", remote=False, skill="python"), "id", "title")


@query("c06_filter_jobs_multi", f"SELECT id, title, company_name, emirate FROM jobs WHERE {MULTI_SQL}")
def filter_multi(v: Views):
    return search.filter_jobs_multi(v.jobs, **MULTI).select("id", "title", "company_name", "emirate")


@query("g01_order_jobs_newest", _page_sql("id", MULTI_SQL))
def order_newest(v: Views):
    return _first_page(search.filter_jobs_multi(v.jobs, **MULTI), "id")


for _sort, _sql in {"date_asc": "created_at ASC, created_at DESC, id", "salary_desc": "coalesce(salary_max, salary_min) DESC NULLS LAST, created_at DESC, id", "salary_asc": "coalesce(salary_min, salary_max) ASC NULLS LAST, created_at DESC, id"}.items():

    @query(f"g01_order_jobs_{_sort}", f"SELECT id, created_at FROM jobs WHERE is_active ORDER BY {_sql} LIMIT 60 OFFSET 60")
    def order_other(v: Views, sort=_sort):
        return search.page(search.filter_jobs_multi(v.jobs), search.job_order(sort), 1, 60).select("id", "created_at")


@query("g03_page", "SELECT id FROM jobs ORDER BY created_at DESC, id LIMIT 100 OFFSET 200")
def third_page(v: Views):
    return search.page(v.jobs, [F.desc("created_at"), "id"], 2, 1000).select("id")


@query("g03_page_after", f"SELECT id, title FROM jobs WHERE is_active ORDER BY coalesce(salary_max, salary_min) DESC NULLS LAST, created_at DESC, id LIMIT 40 OFFSET 80")
def page_by_cursor(v: Views):
    """The third page, by the cursors of the two before it."""
    jobs, keys, cursor = v.jobs.where("is_active"), search.sort_keys("salary_desc"), None
    for _ in range(2):
        cursor = search.page_after(jobs, keys, cursor, 40).select(search.CURSOR).collect()[-1][0]  # 40 rows
    return search.page_after(jobs, keys, cursor, 40).select("id", "title")


@query("c07_posted_after", "SELECT id FROM jobs WHERE coalesce(posted_at, created_at) >= TIMESTAMP '1997-01-01 00:00:00'")
def posted(v: Views):
    return v.jobs.where(search.posted_after("1997-01-01 00:00:00")).select("id")


@query("c08_salary_between", "SELECT id FROM jobs WHERE coalesce(salary_min, salary_max) BETWEEN 1000 AND 1500")
def salary(v: Views):
    return v.jobs.where(search.salary_between(1000, 1500)).select("id")


@query("c09_publisher_match", f"SELECT id FROM jobs WHERE contains({_LISTED}, 'bayt') OR contains({_LISTED}, 'firm3')")
def publishers(v: Views):
    return v.jobs.where(search.publisher_match(["bayt", "Firm3"])).select("id")


@query("c10_apply_mode", "SELECT id FROM jobs WHERE apply_url IS NULL AND linkedin_url IS NULL")
def mode(v: Views):
    return v.jobs.where(search.apply_mode("easy")).select("id")


_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_TOKENS = (
    "list_transform(list_filter(split(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(requirements, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (" + _STOP + ")), "
    "lambda w: regexp_replace(regexp_replace(w, '^(.{3,}?)(ies)$', '\\1y'), '^(.{3,}?)(?:ing|ed|es|s)$', '\\1'))"
)


@query("c11_full_text_match", f"SELECT id FROM (SELECT id, {_TOKENS} AS t FROM jobs) WHERE list_contains(t, 'engineer') AND list_contains(t, 'platform')")
def full_text(v: Views):
    return v.jobs.where(search.full_text_match("the engineers platforms")).select("id")


@query("g02_rank_text", f"SELECT id, round(list_sum(list_transform(['engineer', 'platform'], lambda w: len(list_filter(t, lambda x: x = w)) / (len(list_filter(t, lambda x: x = w)) + 1))), 6) AS rank FROM (SELECT id, {_TOKENS} AS t FROM jobs) WHERE list_contains(t, 'engineer') AND list_contains(t, 'platform')")
def rank(v: Views):
    q = "engineers platform"
    return v.jobs.where(search.full_text_match(q)).select("id", F.round(search.text_rank(q), 6).alias("rank"))


@query("c12_admin_search", _page_sql("id", "(contains(lower(title), 'data') OR contains(lower(company_name), 'data')) AND is_active"))
def admin(v: Views):
    return _first_page(search.admin_search(v.jobs, "DATA", True), "id")


@query("c13_directory_search", "SELECT id, name FROM companies WHERE status = 'APPROVED' AND contains(lower(name), '0') AND city = 'Dubai'")
def directory_hits(v: Views):
    return search.directory_search(v.companies, "0", "Dubai").select("id", "name")


@query("c14_users_by_email", "SELECT id FROM users WHERE contains(lower(email), '00001')")
def by_email(v: Views):
    return search.users_by_email(v.users, "00001").select("id")


@query("c15_aggregator_url", f"SELECT id, regexp_matches(coalesce(careers_url, ''), '(?i){rules.AGGREGATORS}') AS narrow, regexp_matches(coalesce(careers_url, ''), '(?i){rules.AGGREGATORS_WIDE}') AS wide FROM companies")
def aggregators(v: Views):
    return v.companies.select("id", directory.aggregator_url("careers_url").alias("narrow"), directory.aggregator_url("careers_url", True).alias("wide"))


@query("c16_company_name_valid", "SELECT company_name, count(*) AS n FROM jobs WHERE company_name IS NOT NULL AND trim(company_name) <> '' AND lower(company_name) NOT IN ('unknown', 'confidential') GROUP BY company_name")
def names(v: Views):
    return v.jobs.where(directory.company_name_valid()).groupBy("company_name").agg(F.count("*").alias("n"))


_SUGGESTED = "SELECT CASE WHEN id % 3 = 0 THEN upper(keyword) WHEN id % 3 = 1 THEN CONCAT(keyword, ' x') ELSE ' ' END AS keyword, category FROM keywords"


@query(
    "d12_new_keywords",
    f"WITH s AS ({_SUGGESTED}), k AS (SELECT *, lower(trim(keyword)) AS w, row_number() OVER (PARTITION BY lower(trim(keyword)) ORDER BY keyword, category) AS r FROM s) SELECT keyword, CASE WHEN category IN ('role', 'skill', 'location', 'company') THEN category ELSE 'role' END AS category, "
    "CASE WHEN trim(keyword) = '' OR length(keyword) > 255 THEN 'invalid' WHEN r > 1 OR w IN (SELECT lower(keyword) FROM keywords WHERE id % 2 = 0) THEN 'existing' ELSE 'added' END AS status FROM k",
)
def suggestions(v: Views):
    keywords = v.keywords
    new = keywords.select(F.when(F.col("id") % 3 == 0, F.upper("keyword")).when(F.col("id") % 3 == 1, F.concat("keyword", F.lit(" x"))).otherwise(" ").alias("keyword"), "category")
    return directory.new_keywords(new, keywords.where("id % 2 = 0"))


@query("c17_suggestion_valid", "SELECT id FROM keywords WHERE trim(keyword) <> '' AND length(keyword) <= 25")
def valid_suggestions(v: Views):
    return v.keywords.where(~X.is_blank("keyword") & (F.length("keyword") <= 25)).select("id")


# ---- joins ------------------------------------------------------------------------------------------


@query("d05_applicants", "SELECT a.id, a.job_id, a.user_id, u.email, p.headline, p.years_experience FROM applications a JOIN users u ON u.id = a.user_id LEFT JOIN profiles p ON p.user_id = a.user_id")
def all_applicants(v: Views):
    return activity.applicants(v.applications, v.users, v.profiles).select("id", "job_id", "user_id", "email", "headline", "years_experience")


@query("d06_applications_of_user", "SELECT a.id, a.user_id, a.status, j.title, j.company_name FROM applications a JOIN jobs j ON j.id = a.job_id")
def of_users(v: Views):
    return activity.applications_of_users(v.applications, v.jobs).select("id", "user_id", "status", "title", "company_name")


@query("d07_jobs_with_applied_flag", "SELECT id, id IN (SELECT job_id FROM applications WHERE user_id = 7) AS applied FROM jobs")
def applied(v: Views):
    return activity.with_applied_flag(v.jobs, v.applications, 7).select("id", "applied")


@query("d08_apply_url_exists", "SELECT seq FROM postings WHERE apply_url IN (SELECT apply_url FROM jobs WHERE apply_url IS NOT NULL)")
def url_exists(v: Views):
    return dedup.apply_url_exists(v.postings, v.jobs).select("seq")


@query("d09_linkedin_fragment_exists", "SELECT seq FROM postings WHERE CAST(seq AS STRING) IN (SELECT CAST(id AS STRING) FROM jobs WHERE linkedin_url IS NOT NULL AND is_active)")
def fragment(v: Views):
    """Postings whose LinkedIn link, written with a title in front of the number, is that of a known job."""
    link = F.concat(F.lit("https://www.linkedin.com/jobs/view/some-title-at-"), F.col("company_name").substr(1, 2), F.lit("-"), F.col("seq").cast("string"))
    return dedup.linkedin_known(v.postings.select("seq", F.lower(F.regexp_replace(link, " ", "")).alias("linkedin_url")), v.jobs).select("seq")


@query("d10_owned", "SELECT a.id, j.posted_by_id AS owner_id FROM applications a JOIN jobs j ON j.id = a.job_id")
def owners(v: Views):
    return activity.owned(v.applications, v.jobs).select("id", "owner_id")


@query("d13_directory_whitelist", "SELECT id FROM companies WHERE slug IN (SELECT slug FROM companies WHERE id % 2 = 0) OR submitted_by IS NOT NULL")
def listed(v: Views):
    companies = v.companies
    return directory.whitelist(companies, companies.where("id % 2 = 0")).select("id")


@query("d14_friction_user_lookup", f"SELECT m.id, m.email, f.n AS failures FROM (SELECT user_id, count(*) AS n FROM login_attempts WHERE NOT success AND user_id IS NOT NULL AND created_at > {EVENTS_AS_OF} - INTERVAL 1 DAY GROUP BY user_id HAVING count(*) >= 3) f JOIN members m ON m.id = f.user_id")
def failing_users(v: Views):
    found = activity.repeated_failures(v.login_attempts, activity.ago(EVENTS_NOW, "1 DAYS"))
    return found.join(v.members, F.col("user_id") == F.col("id")).select("id", "email", "failures")


@query("d15_apply_patches", "SELECT id, CASE WHEN id % 2 = 0 THEN CONCAT(name, ' Ltd') ELSE name END AS name, CASE WHEN id % 3 = 0 THEN NULL ELSE city END AS city, status FROM companies")
def patched(v: Views):
    companies = v.companies
    patch = companies.select("id", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" Ltd"))).alias("name"), F.when(F.col("id") % 3 == 0, " ").alias("city"))
    return directory.apply_patches(companies, patch, "id", ["city"]).select("id", "name", "city", "status")


@query("d16_directory_submission_check", "SELECT upper(name) AS name FROM companies WHERE lower(name) NOT IN (SELECT lower(name) FROM companies WHERE id % 2 = 0) AND slug NOT IN (SELECT slug FROM companies WHERE id % 3 = 0)")
def submissions(v: Views):
    companies = v.companies
    known = companies.select("id", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise("-").alias("name"), F.when(F.col("id") % 3 == 0, F.col("slug")).otherwise("-").alias("slug"))
    return directory.submission_check(companies.select(F.upper("name").alias("name"), "slug"), known).select("name")


# ---- windows, top lists -----------------------------------------------------------------------------


@query("f01_first_per_key", "SELECT apply_url, min(seq) AS seq FROM postings WHERE apply_url IS NOT NULL GROUP BY apply_url")
def first(v: Views):
    return dedup.first_per_key(v.postings.where("apply_url is not null"), ["apply_url"], ["seq"]).select("apply_url", "seq")


_SCORE = f"weight * (1 + ln(1 + inserted)) / (1 + duplicates) * CASE WHEN last_run_at IS NULL THEN 1.5 WHEN last_run_at < {AS_OF} - INTERVAL 24 HOUR THEN 1.25 ELSE 1.0 END"


@query("f02_pick_keywords", f"SELECT id, tier, place FROM (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY {_SCORE} DESC, last_run_at ASC NULLS FIRST, id) AS place FROM keywords WHERE active) WHERE place <= CASE tier WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 0 END")
def picks(v: Views):
    return maintenance.pick_keywords(v.keywords, {1: 20, 2: 10, 3: 5, 4: 0}, NOW).select("id", "tier", "place")


@query("f03_current_subscription", "SELECT u.id AS user_id, coalesce(s.tier, 'free') AS tier FROM users u LEFT JOIN (SELECT user_id, tier, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS r FROM subscriptions WHERE is_active) s ON s.user_id = u.id AND s.r = 1")
def subscription(v: Views):
    return activity.current_subscription(v.subscriptions, v.users)


@query(
    "f04_assign_unique_slugs",
    "WITH n AS (SELECT id AS seq, CONCAT('job-', CAST(id % 97 AS STRING), 'x') AS base, row_number() OVER (PARTITION BY id % 97 ORDER BY id) AS k FROM jobs), "
    "u AS (SELECT DISTINCT CONCAT('job-', CAST(id % 97 AS STRING), 'x') AS base, CASE WHEN id % 7 = 0 THEN 0 ELSE CAST(id % 31 AS INT) END AS n FROM jobs WHERE id % 97 < 40), "
    "f AS (SELECT base, i, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM (SELECT base, unnest(range(0, max(k) + 32)) AS i FROM n GROUP BY base) WHERE (base, i) NOT IN (SELECT base, n FROM u)) "
    "SELECT n.seq, CASE WHEN f.i = 0 THEN n.base ELSE CONCAT(n.base, '-', CAST(f.i AS STRING)) END AS slug FROM n JOIN f ON f.base = n.base AND f.k = n.k",
)
def slugs(v: Views):
    base = F.concat(F.lit("job-"), (F.col("id") % 97).cast("string"), F.lit("x"))
    number = F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("id") % 31)
    taken = v.jobs.where("id % 97 < 40").select(F.when(number == 0, base).otherwise(F.concat_ws("-", base, number.cast("string"))).alias("slug")).distinct()
    return dedup.assign_unique_slugs(v.jobs.select(F.col("id").alias("seq"), base.alias("base")), taken).select("seq", "slug")


@query("f05_subscription_quota", "WITH c AS (SELECT u.id AS user_id, coalesce(s.tier, 'free') AS tier FROM users u LEFT JOIN (SELECT user_id, tier, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS r FROM subscriptions WHERE is_active) s ON s.user_id = u.id AND s.r = 1) SELECT id, posted_by_id, n, n > CASE tier WHEN 'starter' THEN 10 WHEN 'professional' THEN 50 ELSE 1 END AS over_limit FROM (SELECT j.id, j.posted_by_id, c.tier, row_number() OVER (PARTITION BY j.posted_by_id ORDER BY j.created_at, j.id) AS n FROM jobs j JOIN c ON c.user_id = j.posted_by_id)")
def quota(v: Views):
    return activity.subscription_quota(v.jobs, activity.current_subscription(v.subscriptions, v.users)).withColumn("n", F.col("n").cast("long"))


for _name, _build, _sql in (
    ("g04_stuck_pending_top20", activity.stuck_pending, "NOT verified ORDER BY created_at, id"),
    ("g04_recent_signups_top20", activity.recent_signups, "true ORDER BY created_at DESC, id"),
    ("g04_never_returned_top20", activity.never_returned, "verified AND last_login IS NULL ORDER BY created_at, id"),
):

    @query(_name, f"SELECT id, email FROM users WHERE {_sql} LIMIT 20")
    def top20(v: Views, build=_build):
        return build(v.users).select("id", "email")


@query("g05_saved_jobs_top500", "SELECT s.id, s.user_id, j.title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, id) AS k FROM saved_jobs) s JOIN jobs j ON j.id = s.job_id WHERE s.k <= 500")
def saved_top(v: Views):
    return activity.saved_jobs_top(v.saved_jobs, v.jobs).select("id", "user_id", "title")


@query("g07_recent_runs", "SELECT id, started_at FROM runs ORDER BY started_at DESC, id LIMIT 50")
def runs(v: Views):
    return maintenance.recent_runs(v.runs, 500).select("id", "started_at")


@query("g08_keywords_by_tier", "SELECT id, tier, keyword FROM keywords")
def tiers(v: Views):
    return maintenance.keywords_by_tier(v.keywords).select("id", "tier", "keyword")


@query("g09_companies_for_sitemap", "SELECT id, name FROM companies WHERE status = 'APPROVED'")
def for_sitemap(v: Views):
    return search.directory_search(v.companies).select("id", "name")


@query("g10_jobs_of_owner", "SELECT id, created_at FROM jobs WHERE posted_by_id = 7 AND is_active")
def of_owner(v: Views):
    return activity.jobs_of_owner(v.jobs, 7, True).select("id", "created_at")


# ---- merges -----------------------------------------------------------------------------------------


@query("h03_insert_if_absent", "SELECT id, slug FROM companies WHERE id % 2 = 0 UNION ALL SELECT id, slug FROM companies WHERE id % 2 <> 0")
def insert_absent(v: Views):
    companies = v.companies.select("id", "slug")
    return directory.insert_if_absent(companies.where("id % 2 = 0"), companies, "slug")


@query("h07_track_applications", "SELECT DISTINCT l_orderkey AS job_id, l_suppkey AS user_id FROM lineitem WHERE l_orderkey IN (SELECT id FROM jobs WHERE is_active) AND (l_orderkey, l_suppkey) NOT IN (SELECT job_id, user_id FROM applications)")
def track(v: Views):
    clicks = v.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("user_id"))
    return activity.track_applications(v.applications, clicks, v.jobs)


@query("h08_save_jobs", "SELECT user_id, job_id FROM saved_jobs UNION ALL (SELECT DISTINCT user_id, job_id FROM applications EXCEPT SELECT user_id, job_id FROM saved_jobs)")
def save(v: Views):
    return activity.save_jobs(v.saved_jobs, v.applications)


@query("h08_unsave_jobs", "SELECT id FROM saved_jobs WHERE (user_id, job_id) NOT IN (SELECT user_id, job_id FROM applications)")
def unsave(v: Views):
    return activity.unsave_jobs(v.saved_jobs, v.applications).select("id")


@query("h09_drop_by_predicate", f"SELECT id FROM companies WHERE NOT regexp_matches(coalesce(careers_url, ''), '(?i){rules.AGGREGATORS_WIDE}')")
def dropped(v: Views):
    return directory.drop_aggregators(v.companies).select("id")


@query("h10_purge_source", "SELECT id FROM jobs WHERE source <> 'demo'")
def purged(v: Views):
    return maintenance.purge_source(v.jobs, "demo").select("id")


@query("h11_advance_application_status", "SELECT a.id, CASE WHEN a.id % 3 = 0 AND a.id % 2 = 0 THEN 'reviewed' ELSE a.status END AS status FROM applications a JOIN jobs j ON j.id = a.job_id")
def advanced(v: Views):
    owned = activity.owned(v.applications, v.jobs)
    changes = owned.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("owner_id")).otherwise(-1).alias("owner_id"), F.lit("reviewed").alias("new_status"))
    return activity.advance_application_status(v.applications, v.jobs, changes).select("id", "status")


@query("h12_backfill_columns", "SELECT id, title AS raw_title, title AS normalized_title, company_name AS normalized_company_name, coalesce(nullif(trim(split_part(location_uae, ',', 1)), ''), emirate) AS city FROM jobs")
def backfilled(v: Views):
    return maintenance.backfill_columns(v.jobs).select("id", "raw_title", "normalized_title", "normalized_company_name", "city")


# ---- clock ------------------------------------------------------------------------------------------


@query("i02_expire_jobs", f"SELECT id, is_active AND NOT expires_at < {AS_OF} AS is_active, CASE WHEN is_active AND expires_at < {AS_OF} THEN {AS_OF} ELSE updated_at END AS updated_at FROM jobs")
def expired(v: Views):
    return maintenance.expire_jobs(v.jobs, NOW).select("id", "is_active", "updated_at")


@query("i03_refresh_long_running", f"SELECT id, CASE WHEN is_active AND updated_at < {AS_OF} - INTERVAL 7 DAY THEN {AS_OF} ELSE updated_at END AS updated_at FROM jobs")
def refreshed(v: Views):
    return maintenance.refresh_long_running(v.jobs, NOW).select("id", "updated_at")


@query("i04_close_stale_runs", f"SELECT id, CASE WHEN finished_at IS NULL AND started_at < {EVENTS_AS_OF} - INTERVAL 10 MINUTE THEN {EVENTS_AS_OF} ELSE finished_at END AS finished_at, CASE WHEN finished_at IS NULL AND started_at < {EVENTS_AS_OF} - INTERVAL 10 MINUTE THEN 'Run did not finish' END AS error FROM runs")
def closed(v: Views):
    return maintenance.close_stale_runs(v.runs, EVENTS_NOW).select("id", "finished_at", "error")


@query("i05_purge_tokens", f"SELECT id FROM tokens WHERE NOT (revoked OR expires_at < {EVENTS_AS_OF})")
def tokens_left(v: Views):
    return maintenance.purge_tokens(v.tokens, EVENTS_NOW).select("id")


@query("i07_sliding_count", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n FROM events")
def rolling(v: Views):
    return v.events.select(F.col("event_id").alias("id"), limits.sliding_count("user_id", "ts", 3600).alias("n"))


def _fold_sql(key: str, columns: str, start: str, seen: str, ok: str, after: str) -> str:
    """Events of a key taken one after the other: each step of the recursion decides the k-th event of all keys. held
    is the state; seen what is left of it at the event, after what it becomes."""
    return f"""WITH RECURSIVE o AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS k, {key} AS owner FROM events),
    f(owner, k, event_id, held, last, admitted) AS (SELECT owner, k - 1, event_id, {start}, t, false FROM o WHERE k = 1
        UNION ALL SELECT owner, k, event_id, CASE WHEN ok THEN {after} ELSE h END, t, ok FROM (SELECT *, {ok} AS ok FROM (SELECT o.owner, o.k, o.event_id, o.t, o.user_id, {seen} AS h FROM f JOIN o ON o.owner = f.owner AND o.k = f.k + 1)))
    SELECT {columns}, f.admitted FROM f JOIN o USING (owner, k)"""


def _window_sql(key: str, columns: str, limit: str, seconds: int) -> str:
    return _fold_sql(key, columns, "CAST([] AS BIGINT[])", f"list_filter(f.held, lambda x: x > o.t - {seconds * 1_000_000})", f"len(h) < {limit}", "list_append(h, t)")


def _bucket_sql(key: str, columns: str, capacity: int, seconds: int) -> str:
    """Tokens are counted in parts of the period, so all is in whole numbers."""
    period = seconds * 1_000_000
    return _fold_sql(key, columns, f"CAST({capacity * period} AS BIGINT)", f"least({capacity * period}, f.held + (o.t - f.last) * {capacity})", f"h >= {period}", f"h - {period}")


@query("i06_sliding_admission", _window_sql("user_id", "CAST(o.user_id AS STRING) AS key, o.event_id AS id, o.ts", "3", 4 * 3600))
def admission(v: Views):
    return limits.sliding_admission(v.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts"), 3, 4 * 3600)


@query("i08_token_bucket", _bucket_sql("user_id", "CAST(o.user_id AS STRING) AS key, o.event_id AS id, o.ts", 2, 48 * 3600))
def bucket(v: Views):
    return limits.token_bucket(v.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts"), 2, 48 * 3600)


@query("i09_classify_endpoint", "SELECT event_id AS id, CASE WHEN event_id % 4 IN (0, 1) THEN 'login' WHEN event_id % 4 = 2 THEN 'refresh' ELSE 'public' END AS tier, CASE WHEN event_id % 2 = 0 THEN CONCAT('10.0.0.', CAST(user_id % 256 AS STRING)) ELSE 'peer' END AS ip FROM events")
def endpoints(v: Views):
    uri = F.element_at(F.array(*[F.lit(f"/api/v1/{u}") for u in ("auth/login", "auth/register", "auth/refresh", "jobs")]), (F.col("event_id") % 4 + 1).cast("int"))
    forwarded = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("203.0.113.9, 10.0.0."), (F.col("user_id") % 256).cast("string")))
    return v.events.select(F.col("event_id").alias("id"), X.classify_endpoint(uri).alias("tier"), X.client_ip(forwarded, F.lit("peer")).alias("ip"))


@query("i10_view_counts", "SELECT a.job_id AS id, count(*) AS n FROM applications a WHERE a.job_id IN (SELECT id FROM jobs WHERE is_active) GROUP BY a.job_id")
def views(v: Views):
    return maintenance.view_counts(v.jobs, v.applications)


#: Login attempts land in five files, of which the third and the fifth bring late ones.
_LANDED = "CASE WHEN created_at < TIMESTAMP '2024-01-10 00:00:00' THEN CASE WHEN id % 10 = 0 THEN 2 ELSE 0 END WHEN created_at < TIMESTAMP '2024-01-20 00:00:00' THEN CASE WHEN id % 10 = 1 THEN 4 ELSE 1 END ELSE 3 END"


@query(
    "i11_login_failures_windowed",
    f"""WITH f AS (SELECT *, {_LANDED} AS batch FROM login_attempts WHERE NOT success AND user_id IS NOT NULL),
    b AS (SELECT b, (SELECT max(created_at) FROM f WHERE batch <= b - 2) - INTERVAL 1 HOUR AS watermark FROM range(5) AS r(b)),
    w AS (SELECT batch, user_id, date_trunc('hour', created_at) + h * INTERVAL 1 HOUR AS window_end FROM f, generate_series(1, 24) AS g(h))
    SELECT user_id, window_end, count(*) AS failures FROM w JOIN b ON b.b = w.batch WHERE watermark IS NULL OR window_end > watermark GROUP BY user_id, window_end""",
)
def windowed(v: Views):
    """A stream of landed files, one a batch: failures in sliding windows, as they change. What comes for a window that
    the watermark has passed is dropped, late rows for open windows count."""
    from jobloom.streaming.ingest import windowed_failures

    landed, out = shared_folder(v.spark, "attempts"), shared_folder(v.spark, "failures")
    attempts = v.login_attempts.withColumn("batch", F.expr(_LANDED)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    schema = attempts.drop("batch").schema
    for batch in range(5):
        attempts.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(landed)
    stream = windowed_failures(v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")  # noqa: E731  a repeated batch replaces itself
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    changed = v.spark.read.schema("user_id long, window_end timestamp, failures long").parquet(out)
    return changed.groupBy("user_id", F.col("window_end").cast("timestamp_ntz").alias("window_end")).agg(F.max("failures").alias("failures"))


@query("i12_daily_login_health", "SELECT date_trunc('day', created_at)::TIMESTAMP AS day, count(*) AS attempts, count(*) FILTER (WHERE success) AS successes, floor(1000 * count(*) FILTER (WHERE success) / count(*) + 0.5) / 10 AS success_rate FROM login_attempts GROUP BY 1")
def daily(v: Views):
    return activity.daily_login_health(v.login_attempts)


# ---- ingest -----------------------------------------------------------------------------------------


def _job_table(enriched: DataFrame) -> DataFrame:
    """Postings with an even number play the table, the others the batch that comes in: between them they are
    all postings."""
    return enriched.where("seq % 2 = 0").select(
        F.col("seq").alias("id"), "seq", "external_source", "external_job_id", "dedup_hash", "normalized_title", "normalized_company_name", "city", (F.col("seq") % 6 != 0).alias("is_active"), "apply_url", "publisher", "linkedin_easy_apply",
        F.lit(None).cast("timestamp").alias("last_seen_at"), F.lit(0).alias("duplicate_source_count"), F.lit(NOW).cast("timestamp").alias("expires_at"),
    )


@query("d01_match_external_id", "SELECT p.seq, min(o.seq) AS l1_id FROM (SELECT * FROM postings WHERE seq % 2 = 1) p LEFT JOIN (SELECT * FROM postings WHERE seq % 2 = 0) o ON o.source = p.source AND o.external_job_id = p.external_job_id GROUP BY p.seq")
def l1(v: Views):
    old = v.postings.where("seq % 2 = 0").select(F.col("seq").alias("id"), F.col("source").alias("external_source"), "external_job_id")
    return dedup.match_external_id(v.postings.where("seq % 2 = 1").withColumnRenamed("source", "external_source"), old).select("seq", "l1_id")


_CLEAN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_HASH = f"sha256(lower({_CLEAN('company_name')} || '|' || {_CLEAN('title')} || '|' || {_CLEAN('location_uae')}))"


@query("d02_match_hash", f"WITH h AS (SELECT seq, {_HASH} AS x FROM postings) SELECT p.seq, p.x AS dedup_hash, min(o.seq) AS l2_id FROM h p LEFT JOIN h o ON o.x = p.x AND o.seq % 2 = 0 WHERE p.seq % 2 = 1 GROUP BY p.seq, p.x")
def l2(v: Views):
    hashed = v.postings.select("seq", X.dedup_hash("company_name", "title", "location_uae").alias("dedup_hash"))
    return dedup.match_hash(hashed.where("seq % 2 = 1"), hashed.where("seq % 2 = 0").withColumnRenamed("seq", "id")).select("seq", "dedup_hash", "l2_id")


_GRAMS = lambda c: f"list_distinct(flatten(list_transform(list_filter(split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("d04_trigram_similarity", f"SELECT a, b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity FROM (SELECT p.p_name AS a, q.p_name AS b, {_GRAMS('p.p_name')} AS x, {_GRAMS('q.p_name')} AS y FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)")
def similarity(v: Views):
    part = v.part
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    pairs = part.join(other, "p_partkey").select(F.col("p_name").alias("a"), "b")
    return pairs.select("a", "b", F.round(dedup.trigram_similarity("a", "b"), 6).alias("similarity"))


_NAMED = "SELECT id AS seq, created_at, is_active, location_uae AS city, lower(company_name) AS company, title || ' ' || CAST(coalesce(salary_min, 5) % 4 AS STRING) AS title FROM jobs"


@query(
    "d03_match_fuzzy",
    f"WITH t AS ({_NAMED}), n AS (SELECT *, {_GRAMS('title')} AS x FROM t WHERE created_at >= TIMESTAMP '1999-01-01 00:00:00'), o AS (SELECT company, city, title, min(seq) AS id, any_value({_GRAMS('title')}) AS x FROM t WHERE created_at < TIMESTAMP '1999-01-01 00:00:00' AND is_active GROUP BY ALL), "
    "s AS (SELECT n.seq, o.id, len(list_intersect(n.x, o.x)) / (len(n.x) + len(o.x) - len(list_intersect(n.x, o.x))) AS s FROM n JOIN o ON o.city = n.city AND o.company = n.company) "
    "SELECT n.seq, b.id AS l3_id FROM n LEFT JOIN (SELECT seq, id, row_number() OVER (PARTITION BY seq ORDER BY s DESC, id) AS r FROM s WHERE s >= 0.85) b ON b.seq = n.seq AND b.r = 1",
)
def l3(v: Views):
    """Later jobs against earlier active ones."""
    title = F.concat("title", F.lit(" "), (F.coalesce("salary_min", F.lit(5)) % 4).cast("string"))
    named = v.jobs.select(F.col("id").alias("seq"), "created_at", "is_active", F.col("location_uae").alias("city"), F.col("company_name").alias("normalized_company_name"), title.alias("normalized_title"))
    early = F.col("created_at") < F.lit("1999-01-01 00:00:00").cast("timestamp")
    return dedup.match_fuzzy(named.where(~early).drop("is_active"), named.where(early).withColumnRenamed("seq", "id")).select("seq", "l3_id")


_SIMILAR = f"""SELECT a.title, a.company, a.place, b.id, len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) AS s
    FROM (SELECT DISTINCT normalized_title AS title, lower(normalized_company_name) AS company, lower(city) AS place, {_GRAMS('normalized_title')} AS x FROM n) a
    JOIN (SELECT min(id) AS id, normalized_title AS title, lower(normalized_company_name) AS company, lower(city) AS place, any_value({_GRAMS('normalized_title')}) AS x FROM o WHERE is_active GROUP BY ALL) b ON a.company = b.company AND a.place = b.place"""


_UPSERT_SQL = f"""WITH e AS ({ENRICHED}),
    o AS (SELECT seq AS id, source AS external_source, external_job_id, dedup_hash, normalized_title, normalized_company_name, city, seq % 6 <> 0 AS is_active, apply_url, publisher, linkedin_easy_apply FROM e WHERE seq % 2 = 0),
    n AS (SELECT * FROM e WHERE seq % 2 = 1 AND accepted), s AS ({_SIMILAR}),
    l3 AS (SELECT title, company, place, id FROM (SELECT *, row_number() OVER (PARTITION BY title, company, place ORDER BY s DESC, id) AS r FROM s WHERE s >= 0.85) WHERE r = 1),
    l1 AS (SELECT external_source, external_job_id, min(id) AS id FROM o WHERE external_job_id IS NOT NULL GROUP BY ALL), l2 AS (SELECT dedup_hash, min(id) AS id FROM o GROUP BY dedup_hash),
    m AS (SELECT n.*, coalesce(l1.id, l2.id, l3.id) AS match_id FROM n LEFT JOIN l1 ON l1.external_source = n.source AND l1.external_job_id = n.external_job_id LEFT JOIN l2 ON l2.dedup_hash = n.dedup_hash
        LEFT JOIN l3 ON l3.title = n.normalized_title AND l3.company = lower(n.normalized_company_name) AND l3.place = lower(n.city)),
    h AS (SELECT match_id, count(*) AS k, arg_max(apply_url, seq) FILTER (WHERE trim(coalesce(apply_url, '')) <> '') AS u, arg_max(publisher, seq) FILTER (WHERE publisher IS NOT NULL) AS p, arg_max(linkedin_easy_apply, seq) FILTER (WHERE linkedin_easy_apply IS NOT NULL) AS q FROM m WHERE match_id IS NOT NULL GROUP BY match_id)
    SELECT o.id, external_source, external_job_id, dedup_hash, normalized_title, normalized_company_name, city, is_active OR k IS NOT NULL AS is_active, coalesce(u, apply_url) AS apply_url, coalesce(p, publisher) AS publisher, coalesce(q, linkedin_easy_apply) AS linkedin_easy_apply,
        CASE WHEN k IS NOT NULL THEN {AS_OF} END AS last_seen_at, CAST(coalesce(k, 0) AS INT) AS duplicate_source_count, {AS_OF} AS expires_at FROM o LEFT JOIN h ON h.match_id = o.id
    UNION ALL SELECT seq + 10000000, source, external_job_id, dedup_hash, normalized_title, normalized_company_name, city, true, apply_url, publisher, linkedin_easy_apply, {AS_OF}, 0, {AS_OF} + INTERVAL 30 DAY FROM m WHERE match_id IS NULL"""


#: What tells copies apart, and whether a posting is accepted.
_MATCHED = ("seq", "source", "external_job_id", "dedup_hash", "normalized_title", "normalized_company_name", "city", "reject_stage")


def _batch_of_postings(v: Views):
    """The table, and the accepted postings of a batch with the jobs that they match."""
    # All postings are worked out once; each side is read by three matchers.
    enriched = v.enriched(*_MATCHED, "apply_url", "publisher", "linkedin_easy_apply").withColumn("external_source", F.col("source"))
    jobs, new = _job_table(enriched), enriched.where("seq % 2 = 1 and reject_stage is null")
    batch = dedup.resolve(new, jobs)
    return jobs, batch.withColumns({"id": F.col("seq") + 10_000_000, "is_active": F.lit(True), "last_seen_at": F.lit(NOW).cast("timestamp"), "duplicate_source_count": F.lit(0), "expires_at": F.lit(NOW).cast("timestamp") + F.expr("INTERVAL 30 DAYS")})


@query("h04_upsert_postings", _UPSERT_SQL)
def upsert(v: Views):
    jobs, new = _batch_of_postings(v)
    return dedup.upsert_postings(jobs, new, NOW).drop("seq")


@query("h04_upsert_buckets", _UPSERT_SQL)
def upsert_in_buckets(v: Views):
    """The same merge into a table in buckets: only those with hits or new rows are written."""
    from jobloom.sources.snapshots import Snapshots

    jobs, new = _batch_of_postings(v)
    new = stored(v.spark, new, "upsert-batch")
    table = Snapshots(v.spark, shared_folder(v.spark, "job-buckets"), jobs.drop("seq").schema, width=1000)
    table.publish(0, jobs.drop("seq"))
    touched = new.select(F.coalesce("match_id", "id").alias("id"))
    table.update(1, touched, lambda old: dedup.upsert_postings(old, new, NOW))
    return table.read()


@query("g06_order_friction", f"SELECT row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, days DESC, user_id, signal) AS place, user_id, signal, severity, days FROM ({FRICTION_SQL}) QUALIFY place <= 100")
def friction_page(v: Views):
    """The first page of a worklist, with its places."""
    page = activity.order_friction(activity.friction_signals(v.members, v.login_attempts, EVENTS_NOW)).limit(100)
    # At most 100 rows.
    return page.select(F.row_number().over(Window.orderBy(*activity.friction_order())).alias("place"), "user_id", "signal", "severity", "days")


_TIER = "CASE user_id % 3 WHEN 0 THEN 'login' WHEN 1 THEN 'refresh' ELSE 'public' END"
_IP = "CONCAT('10.0.0.', CAST(user_id % 7 AS STRING))"


@query("i06_tier_admission", _window_sql(f"CONCAT({_TIER}, {_IP})", f"{_TIER} AS tier, {_IP} AS ip, o.event_id AS id, o.ts", "CASE user_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 120 END", 240 * 3600))
def tiers_admitted(v: Views):
    """Requests of each kind of endpoint against its own limit."""
    kind = F.element_at(F.array(*[F.lit(f"/api/v1/{u}") for u in ("auth/login", "auth/refresh", "jobs")]), (F.col("user_id") % 3 + 1).cast("int"))
    requests = v.events.select(X.classify_endpoint(kind).alias("tier"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("ip"), F.col("event_id").alias("id"), "ts")
    return limits.tier_admission(requests, window_seconds=240 * 3600)


@query("a16_write_jobs", "SELECT id, title, is_active FROM jobs")
def written(v: Views):
    from jobloom.sources.tables import read_snapshot, write_snapshot

    path = shared_folder(v.spark, "jobs")
    jobs = v.jobs.select("id", "title", "is_active")
    write_snapshot(jobs, path)
    return read_snapshot(v.spark, path, jobs.schema)


@query("a17_write_run_log", "SELECT source, keyword, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'inserted') AS inserted FROM runs GROUP BY source, keyword")
def logged(v: Views):
    from jobloom.sources.tables import append_log

    path = shared_folder(v.spark, "runs")
    tally = maintenance.run_tally(v.runs).select("source", "keyword", "fetched", "inserted")
    for source in ("adzuna", "jsearch", "careerjet"):
        append_log(tally.where(F.col("source") == source), path)
    return v.spark.read.parquet(path)


# Taken in order of arrival, a posting that matches an earlier kept one by id, hash or title counts on it. Each step
# of the recursion decides one posting from the list of those kept so far.
_FOLD = f"""e AS ({ENRICHED}), n AS (SELECT *, source || chr(31) || external_job_id AS xid, lower(normalized_company_name) AS c, lower(city) AS p, row_number() OVER (ORDER BY seq) AS k FROM e WHERE accepted),
    t AS (SELECT DISTINCT c, p, normalized_title AS title, {_GRAMS('normalized_title')} AS x FROM n WHERE c IS NOT NULL AND p IS NOT NULL),
    s AS (SELECT a.c, a.p, a.title, b.title AS other, len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) AS likeness FROM t a JOIN t b ON a.c = b.c AND a.p = b.p AND len(a.x) > 0 AND len(b.x) > 0),
    m AS (SELECT k, j, min(level) AS level, max(likeness) AS likeness FROM (
        SELECT a.k, b.k AS j, 1 AS level, NULL AS likeness FROM n a JOIN n b ON a.xid = b.xid AND b.k < a.k UNION ALL SELECT a.k, b.k, 2, NULL FROM n a JOIN n b ON a.dedup_hash = b.dedup_hash AND b.k < a.k
        UNION ALL SELECT a.k, b.k, 3, likeness FROM n a JOIN s ON s.c = a.c AND s.p = a.p AND s.title = a.normalized_title AND likeness >= 0.85 JOIN n b ON b.c = s.c AND b.p = s.p AND b.normalized_title = s.other AND b.k < a.k) GROUP BY ALL),
    near AS (SELECT k, list(j) AS js FROM m GROUP BY k),
    fold(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT fold.k + 1, CASE WHEN list_has_any(fold.kept, coalesce(near.js, [])) THEN fold.kept ELSE list_append(fold.kept, fold.k + 1) END FROM fold LEFT JOIN near ON near.k = fold.k + 1 WHERE fold.k < (SELECT count(*) FROM n)),
    kept AS (SELECT unnest(kept) AS j FROM fold WHERE k = (SELECT count(*) FROM n)),
    best AS (SELECT k, j, level FROM m JOIN kept USING (j) WHERE k NOT IN (SELECT j FROM kept) QUALIFY row_number() OVER (PARTITION BY k ORDER BY level, likeness DESC, j) = 1)"""


@query("h05_resolve_batch", f"WITH RECURSIVE {_FOLD} SELECT n.seq, coalesce(l.seq, n.seq) AS leader, CASE WHEN best.k IS NULL THEN 'NONE' ELSE 'L' || best.level END AS level FROM n LEFT JOIN best ON best.k = n.k LEFT JOIN n l ON l.k = best.j")
def same_batch(v: Views):
    """All accepted postings as one batch."""
    accepted = v.enriched(*_MATCHED).where("reject_stage is null").withColumn("external_source", F.col("source"))
    return dedup.resolve_batch(accepted).select("seq", "leader", "level")


@query(
    "i01_ingest_stream",
    f"""WITH RECURSIVE {_FOLD}, h AS (SELECT j, count(*) AS k, arg_max(apply_url, seq) FILTER (WHERE trim(coalesce(apply_url, '')) <> '') AS u, arg_max(publisher, seq) FILTER (WHERE publisher IS NOT NULL) AS p, arg_max(linkedin_easy_apply, seq) FILTER (WHERE linkedin_easy_apply IS NOT NULL) AS q FROM best JOIN n USING (k) GROUP BY j)
    SELECT n.seq AS id, n.source AS external_source, n.external_job_id, n.dedup_hash, n.normalized_title, n.normalized_company_name, n.city, true AS is_active, coalesce(u, apply_url) AS apply_url, coalesce(h.p, publisher) AS publisher, coalesce(q, linkedin_easy_apply) AS linkedin_easy_apply,
        {AS_OF} AS last_seen_at, CAST(coalesce(h.k, 0) AS INT) AS duplicate_source_count, {AS_OF} + INTERVAL 30 DAY AS expires_at FROM n JOIN kept ON kept.j = n.k LEFT JOIN h ON h.j = n.k""",
)
def streamed(v: Views):
    """Postings land in three files, in the order of arrival; each is a batch that is merged into the table of the
    batches before it, and the second is merged twice. The last version is what one fold over all postings gives."""
    from pyspark.sql.types import _parse_datatype_string

    from jobloom.sources.snapshots import Snapshots
    from jobloom.streaming.ingest import JOBS, ingest_stream, merge_postings

    spark, landed, root = v.spark, shared_folder(v.spark, "landed"), shared_folder(v.spark, "job-table")
    postings = v.postings
    cuts = postings.approxQuantile("seq", [0.3, 0.6], 0.01)
    cuts = [None, *map(int, cuts), None]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = postings.where((F.col("seq") > low if low is not None else F.lit(True)) & (F.col("seq") <= high if high is not None else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(landed)
    table = Snapshots(spark, root, _parse_datatype_string(JOBS), width=4096)
    table.publish(0, table.read())

    def merge(batch: DataFrame, number: int) -> None:
        merge_postings(table, batch, number, NOW)
        if number == 1 and merge_postings(table, batch, number, NOW):
            raise RuntimeError("a batch was merged twice")

    ingest_stream(spark, landed, postings.schema, f"{root}-checkpoint", merge, files=1)
    return table.read()
