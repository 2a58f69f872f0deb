"""Analytics over users, sign-ins, applications and runs. Every clock is a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import first_match, is_blank


def now(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def ago(as_of, interval: str) -> Column:
    return now(as_of) - F.expr(f"INTERVAL {interval}")


def whole_days(start, as_of) -> Column:
    """Whole periods of 24 hours."""
    return F.floor((F.unix_micros(now(as_of)) - F.unix_micros(F.col(start).cast("timestamp"))) / 86_400_000_000)


def public_stats(jobs: DataFrame, users: DataFrame) -> DataFrame:
    active = jobs.agg(F.count_if("is_active").alias("active_jobs"), F.count_distinct(F.when(F.col("is_active"), F.col("company_name"))).alias("companies"))
    return active.join(users.agg(F.count("*").alias("users")), F.lit(True))


def admin_stats(users: DataFrame, jobs: DataFrame, applications: DataFrame) -> DataFrame:
    kinds = users.agg(F.count("*").alias("users"), *[F.count_if(F.col("user_type") == t).alias(t) for t in ("job_seeker", "hr", "admin")])
    one = [kinds.withColumn("revenue", F.col("hr") * 499), jobs.agg(F.count("*").alias("jobs")), applications.agg(F.count("*").alias("applications"))]
    return reduce(lambda a, b: a.join(b, F.lit(True)), one)  # each has one row


def user_activity(users: DataFrame, as_of) -> DataFrame:
    since = lambda c, days: F.count_if(F.col(c) > ago(as_of, f"{days} DAYS"))
    return users.agg(
        F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("pending"), since("last_login", 1).alias("active_1d"), since("last_login", 7).alias("active_7d"),
        since("last_login", 30).alias("active_30d"), F.count_if(F.col("last_login").isNull()).alias("never_logged_in"), since("created_at", 7).alias("new_7d"), since("created_at", 30).alias("new_30d"),
    )


def active_sessions(tokens: DataFrame, as_of) -> DataFrame:
    return tokens.agg(F.count_if(~F.col("revoked") & (F.col("expires_at") > now(as_of))).alias("active_sessions"))


def success_rate(successes, attempts) -> Column:
    return F.when(attempts == 0, 0.0).otherwise(F.floor(F.try_divide(1000 * successes, attempts) + 0.5) / 10)


def login_health(attempts: DataFrame, as_of) -> DataFrame:
    """Sign-ins since UTC midnight."""
    today = attempts.where(F.col("created_at") >= F.date_trunc("DAY", now(as_of)))
    counted = today.agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))
    return counted.select("attempts", "successes", (F.col("attempts") - F.col("successes")).alias("failures"), success_rate(F.col("successes"), F.col("attempts")).alias("success_rate"))


def daily_login_health(attempts: DataFrame) -> DataFrame:
    counted = attempts.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))
    return counted.select(F.col("w.start").alias("day"), "attempts", "successes", success_rate(F.col("successes"), F.col("attempts")).alias("success_rate"))


def failure_breakdown(attempts: DataFrame, since) -> DataFrame:
    return attempts.where(~F.col("success") & (F.col("created_at") > now(since))).groupBy("failure_reason").agg(F.count("*").alias("n"))


def repeated_failures(attempts: DataFrame, since: Column, least: int = 3) -> DataFrame:
    return attempts.where(~F.col("success") & F.col("user_id").isNotNull() & (F.col("created_at") > since)).groupBy("user_id").agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def top_countries(users: DataFrame, most: int = 8) -> DataFrame:
    return users.where(~is_blank("country")).groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(most)


def friction_signals(users: DataFrame, attempts: DataFrame, as_of) -> DataFrame:
    """user_id, signal, severity, days, message, action: four kinds of users who got stuck."""
    never = users.where(F.col("verified") & F.col("last_login").isNull() & (F.col("created_at") < ago(as_of, "3 DAYS")))
    stuck = users.where(~F.col("verified") & (F.col("created_at") < ago(as_of, "2 DAYS")))
    days = whole_days("created_at", as_of)
    failing = repeated_failures(attempts, ago(as_of, "1 DAYS")).join(users, F.col("user_id") == F.col("id"))

    def signal(df, name, severity, since, message, action):
        return df.select(F.col("id").alias("user_id"), F.lit(name).alias("signal"), severity.alias("severity"), since.cast("long").alias("days"), message.alias("message"), F.lit(action).alias("action"))

    high = lambda c, most, other: F.when(c >= most, "HIGH").otherwise(other)
    waited = F.concat(F.lit("Waiting for "), days, F.lit(" days"))
    parts = [
        signal(failing, "REPEATED_FAILURES", high(F.col("failures"), 5, "MEDIUM"), F.lit(0), F.concat("failures", F.lit(" failed sign-ins in 24 hours")), "RESET_PASSWORD"),
        signal(never.where("user_type = 'hr'"), "EMPLOYER_INACTIVE", high(days, 7, "MEDIUM"), days, waited, "SEND_WELCOME"),
        signal(never.where("user_type <> 'hr'"), "VERIFIED_NEVER_LOGIN", F.lit("LOW"), days, waited, "SEND_WELCOME"),
        signal(stuck, "STUCK_PENDING_LONG", first_match([(days >= 7, "HIGH"), (days >= 3, "MEDIUM")], "LOW"), days, waited, "RESEND_VERIFICATION"),
    ]
    return reduce(DataFrame.unionByName, parts)


def friction_order() -> list[Column]:
    """High before medium before low, then who waits longest."""
    rank = first_match([(F.col("severity") == "HIGH", 0), (F.col("severity") == "MEDIUM", 1)], 2)
    return [rank, F.desc("days"), F.col("user_id"), F.col("signal")]


def order_friction(signals: DataFrame) -> DataFrame:
    return signals.orderBy(*friction_order())


def stuck_pending(users: DataFrame, most: int = 20) -> DataFrame:
    return users.where("not verified").orderBy("created_at", "id").limit(most)


def recent_signups(users: DataFrame, most: int = 20) -> DataFrame:
    return users.orderBy(F.desc("created_at"), "id").limit(most)


def never_returned(users: DataFrame, most: int = 20) -> DataFrame:
    return users.where("verified and last_login is null").orderBy("created_at", "id").limit(most)


def applicants(applications: DataFrame, users: DataFrame, profiles: DataFrame, job_id=None) -> DataFrame:
    """Applications with user and, where there is one, profile; for one job newest first."""
    own = applications if job_id is None else applications.where(F.col("job_id") == job_id)
    joined = own.join(users.select(F.col("id").alias("user_id"), "email", "country"), "user_id").join(profiles, "user_id", "left")
    return joined if job_id is None else joined.orderBy(F.desc("applied_at"), "id")


def applications_of_users(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    return applications.join(jobs.select(F.col("id").alias("job_id"), "title", "company_name"), "job_id")


def with_applied_flag(jobs: DataFrame, applications: DataFrame, user_id) -> DataFrame:
    mine = applications.where(F.col("user_id") == user_id).select(F.col("job_id").alias("id")).distinct().withColumn("applied", F.lit(True))
    return jobs.join(mine, "id", "left").withColumn("applied", F.coalesce("applied", F.lit(False)))


def owned(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """Applications with the owner of their job."""
    return applications.join(jobs.select(F.col("id").alias("job_id"), F.col("posted_by_id").alias("owner_id")), "job_id")


def advance_application_status(applications: DataFrame, jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """applications after changes (id, owner_id, new_status) of those who own the job."""
    allowed = owned(applications, jobs).join(changes, ["id", "owner_id"]).groupBy("id").agg(F.max("new_status").alias("new_status"))
    return applications.join(allowed, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def applications_per_job(applications: DataFrame) -> DataFrame:
    return applications.groupBy("job_id").agg(F.count("*").alias("n"))


def track_applications(applications: DataFrame, clicks: DataFrame, jobs: DataFrame) -> DataFrame:
    """(user_id, job_id) of clicks on active jobs without an application yet, once each."""
    live = clicks.select("user_id", "job_id").distinct().join(jobs.where("is_active").select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return live.join(applications.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti").select("user_id", "job_id")


def save_jobs(saved: DataFrame, more: DataFrame, at_once: int = 1_000_000) -> DataFrame:
    """The pairs of saved, as often as they stand there, and once each those that only more has; nulls are equal.

    Pairs are hardly ever equal within a file, so they are not summed up before they are dealt out, and dealt to so many
    tasks that each holds about `at_once` of them, however large the tables are."""
    pairs = ["user_id", "job_id"]
    both = saved.select(*pairs, F.lit(1).alias("_n")).unionByName(more.select(*pairs, F.lit(0).alias("_n")))
    counted = both.repartition(both.count() // at_once + 1, *pairs).groupBy(*pairs).agg(F.sum("_n").cast("int").alias("_n"))
    return counted.select(*pairs, F.explode(F.array_repeat(F.lit(0), F.greatest(F.lit(1), "_n")))).select(pairs)


def unsave_jobs(saved: DataFrame, gone: DataFrame) -> DataFrame:
    return saved.join(gone.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


def saved_jobs_top(saved: DataFrame, jobs: DataFrame, most: int = 500) -> DataFrame:
    """The newest saved jobs of every user."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("saved_at"), "id")
    kept = saved.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= most).drop("_k")
    return kept.join(jobs.select(F.col("id").alias("job_id"), "title"), "job_id")


def jobs_of_owner(jobs: DataFrame, owner, active: bool = False) -> DataFrame:
    out = jobs.where(F.col("posted_by_id") == owner)
    return (out.where("is_active") if active else out).orderBy(F.desc("created_at"), "id")


# Jobs that a tier may post.
TIER_LIMITS = {"free": 1, "starter": 10, "professional": 50}


def current_subscription(subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """user_id and tier of the latest active subscription; without one the tier is free."""
    latest = subscriptions.where("is_active").groupBy("user_id").agg(F.max_by("tier", F.struct("started_at", "id")).alias("tier"))
    return users.select(F.col("id").alias("user_id")).join(latest, "user_id", "left").withColumn("tier", F.coalesce("tier", F.lit("free")))


def subscription_quota(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """id, posted_by_id, n (the owner's jobs up to this one) and whether it is over the tier's limit."""
    limit = first_match([(F.col("tier") == t, n) for t, n in TIER_LIMITS.items()], 1)
    own = jobs.join(current.withColumnRenamed("user_id", "posted_by_id"), "posted_by_id")
    n = F.row_number().over(Window.partitionBy("posted_by_id").orderBy("created_at", "id"))
    return own.withColumn("n", n).select("id", "posted_by_id", "n", (F.col("n") > limit).alias("over_limit"))
