"""Rejection and relevance of postings, and the columns that the ingest adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import rules
from jobloom.functions import text as X


def reject_reason(title, location, country, description) -> Column:
    """Which rule rejects a posting; null if none does."""
    loc, desc = F.lower(X.safe(location)), F.lower(X.safe(description))
    uae = lambda c: X.matches(c, rules.UAE_PLACE)
    foreign = lambda c: X.matches(c, rules.OTHER_COUNTRY)
    # Alternatives are told apart, so that each is searched for in the long text only where it can be.
    said = lambda c, lower, pattern: X.occurs(c, lower, X.alternatives(pattern))
    everything = F.concat_ws(" ", loc, F.lower(X.safe(country)), desc)
    return X.first_match(
        [
            (X.is_blank(title), "blank_title"),
            (X.matches(title, rules.STRONG_NEGATIVE), "other_profession"),
            (X.matches(title, rules.TRADE) & ~X.matches(title, rules.TRADE_OVERRIDE), "trade"),
            (foreign(loc) & ~uae(loc), "foreign_location"),
            ((loc == rules.GENERIC_REMOTE) & X.let(desc, lambda d: said(d, d, rules.OTHER_COUNTRY) & ~said(d, d, rules.UAE_PLACE)), "foreign_remote"),
            (X.let(desc, lambda d: X.occurs(description, d, rules.EU_SCOPES) & ~said(description, d, rules.UAE_PLACE)), "eu_scope"),
            # The country is the cheaper test.
            ((F.upper(X.safe(country)) != "AE") & ~uae(everything), "not_in_uae"),
        ]
    )


def hard_reject(title, location, country, description) -> Column:
    return reject_reason(title, location, country, description).isNotNull()


def publisher_allowed(publisher, apply_url, allowed: list[str]) -> Column:
    """Any allowed name in the publisher or the link's host; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    text = F.lower(F.concat_ws("\n", X.safe(publisher), X.safe(X.host_of(apply_url))))
    return X.contains_any(text, [a.lower() for a in allowed])


REASONS = "array<struct<rule: string, delta: int>>"
#: The most that technologies and domain words of the description can add to a score.
MOST_FOOTPRINT, MOST_NAMED = 25, 20


def _domain_words(description) -> Column:
    return F.least(F.lit(MOST_NAMED), F.regexp_count(X.safe(description), F.lit("(?i)" + rules.TECH_DOMAIN)))


def relevance_reasons(title, description, n_technologies) -> Column:
    """array<struct(rule, delta)> of the rules that count."""
    reason = lambda rule, delta: F.struct(rule.alias("rule"), delta.cast("int").alias("delta"))
    # The long text is searched once for each of the two counts.
    footprint = X.let(X.col(n_technologies), lambda n: F.when(n > 0, reason(F.concat(F.lit("tech_footprint_"), n), F.least(F.lit(MOST_FOOTPRINT), n * 8))))
    named = X.let(_domain_words(description), lambda n: F.when(n > 0, reason(F.concat(F.lit("tech_domain_desc_x"), n), n)))
    return F.array_compact(
        F.array(
            F.when(X.matches(title, rules.TECH_DOMAIN), reason(F.lit("tech_domain_title"), F.lit(40))),
            footprint,
            named,
            F.when(F.lower(X.safe(title)).rlike(rules.SENIOR_SIGNAL), reason(F.lit("seniority_signal"), F.lit(10))),
            F.when(X.matches(title, rules.STRONG_NEGATIVE), reason(F.lit("strong_negative_title"), F.lit(-25))),
        )
    )


def relevance_score(reasons) -> Column:
    total = F.aggregate(X.col(reasons), F.lit(0), lambda s, r: s + r["delta"])
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def is_relevant(title, description, text) -> Column:
    """Whether relevance_score, with the technologies of text, reaches rules.MIN_SCORE. What the title gives comes first;
    the long texts are searched only where they can still decide."""
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    head = points(X.matches(title, rules.TECH_DOMAIN), 40) + points(F.lower(X.safe(title)).rlike(rules.SENIOR_SIGNAL), 10) - points(X.matches(title, rules.STRONG_NEGATIVE), 25)
    enough = lambda n: n >= rules.MIN_SCORE
    footprint = lambda t: F.least(F.lit(MOST_FOOTPRINT), F.size(X.extract_technologies(t)) * 8)
    # What `most` more could add decides nothing below the least score; what is there can't be taken away.
    step = lambda n, most, more: X.first_match([(enough(n), True), (~enough(n + most), False)], more(n))
    searched = lambda n: X.let(text, lambda t: enough(n + footprint(t)))
    named = lambda n: X.let(n + _domain_words(description), lambda m: step(m, MOST_FOOTPRINT, searched))
    return X.let(head, lambda n: step(n, MOST_NAMED + MOST_FOOTPRINT, named))


def enrich(postings: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """postings with everything that the ingest derives from a posting, and where it would be rejected. reject_stage
    doesn't read the score, so that a selection without the score and technologies leaves these out of the plan."""
    place = X.normalize_location(F.split("location_uae", ",")[0], F.concat_ws(" ", X.safe("location_uae"), X.safe("emirate")), F.lit(None).cast("string"))
    every = F.lower(F.concat_ws(" ", X.safe("title"), X.safe("description"), X.safe("requirements")))
    # A column of its own: 63 patterns read it.
    out = postings.withColumn("_every", every).withColumns(
        {
            "reject_reason": reject_reason("title", "location_uae", F.lit("AE"), "description"),
            "normalized_title": X.normalize_title("title"),
            "normalized_company_name": X.normalize_company("company_name"),
            "_place": place,
            "work_mode": X.classify_work_mode("title", "description", "remote_uae"),
            "seniority": X.classify_seniority("title", "description"),
            "technologies": X.extract_technologies("_every"),
        }
    )
    out = out.withColumns({"city": F.col("_place.city"), "country": F.col("_place.country"), "emirate": F.coalesce("_place.emirate", "emirate")}).drop("_place", "_every")
    out = out.withColumn("relevance_reasons", relevance_reasons("title", "description", F.size("technologies")))
    out = out.withColumns({"relevance_score": relevance_score("relevance_reasons"), "dedup_hash": X.dedup_hash("normalized_company_name", "normalized_title", "city")})
    stage = X.first_match(
        [(F.col("reject_reason").isNotNull(), "hard"), (~publisher_allowed("publisher", "apply_url", allowed or []), "publisher"), (~is_relevant("title", "description", every), "score")]
    )
    return out.withColumn("reject_stage", stage)


def score_filter(enriched: DataFrame, least: int = rules.MIN_SCORE) -> DataFrame:
    return enriched.where(F.col("relevance_score") >= least)


def ingest_defaults(accepted: DataFrame, as_of) -> DataFrame:
    """The columns of a new job row."""
    now = F.lit(as_of).cast("timestamp")
    return accepted.withColumns(
        {
            "raw_title": F.col("title"),
            "title": F.col("normalized_title"),
            "salary_currency": F.lit("AED"),
            "job_type": F.lit("full_time"),
            "job_category": F.coalesce(X.classify_category("normalized_title", "description"), F.lit("other")),
            "remote_uae": (F.col("work_mode") == "remote") | F.coalesce("remote_uae", F.lit(False)),
            "posted_at": now,
            "created_at": now,
            "expires_at": now + F.expr("INTERVAL 30 DAYS"),
            "last_seen_at": now,
            "duplicate_source_count": F.lit(0),
            "is_active": F.lit(True),
        }
    )
