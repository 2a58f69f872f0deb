"""Search over a job table: optional predicates, orders, pages, full text. Only predicates that are asked for
become part of the plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import safe

#: Words that full-text search ignores.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or our such that the their then there these they this to was we will with you your".split()


_ENDINGS = [(r"^(.{3,}?)(ies)$", "y"), (r"^(.{3,}?)(?:ing|ed|es|s)$", "")]


def stem(word: Column) -> Column:
    """Plural, -ing and -ed endings of words that keep three letters or more."""
    for pattern, ending in _ENDINGS:
        word = F.regexp_replace(word, pattern, f"$1{ending}")
    return word


def query_words(q: str) -> list[str]:
    """Distinct stems of the words of a query, without stop words."""
    words = [w for w in re.findall(r"[^\W_]+", q.lower()) if w not in STOP_WORDS]
    for pattern, ending in _ENDINGS:
        words = [re.sub(pattern, rf"\g<1>{ending}", w) for w in words]
    return list(dict.fromkeys(words))


def _searched() -> Column:
    return F.lower(F.concat_ws(" ", *[safe(c) for c in ("title", "description", "requirements")]))


def word_counts(q: str) -> Column:
    """How often each of query_words(q) occurs, by stem, in title, description and requirements. The text is cut
    into words once, and only words that begin as a wanted one does are stemmed."""
    wanted = query_words(q)
    words = F.split(F.regexp_replace(_searched(), r"[^\p{L}\p{N}]+", " "), " ")
    likely = F.filter(words, lambda w: reduce(lambda a, b: a | b, [w.startswith(_start(x)) for x in wanted]) & ~w.isin(STOP_WORDS))

    def times(stems: Column, wanted_word: str) -> Column:
        return F.size(F.filter(stems, lambda s: s == wanted_word))

    return F.get(F.transform(F.array(F.transform(likely, stem)), lambda stems: F.array(*[times(stems, w) for w in wanted])), F.lit(0))


def _start(stemmed: str) -> str:
    """What every word with this stem begins with."""
    return stemmed.removesuffix("y")


def full_text_match(q: str) -> Column:
    """All words of q occur in title, description or requirements; a query of stop words matches nothing. Texts
    that lack a word's beginning are not cut into words at all."""
    wanted = query_words(q)
    if not wanted:
        return F.lit(False)
    hold = reduce(lambda a, b: a & b, [_searched().contains(_start(w)) for w in wanted])
    return F.when(hold, F.forall(word_counts(q), lambda n: n > 0)).otherwise(False)


def text_rank(q: str) -> Column:
    """Sum over the query's words of tf / (tf + 1)."""
    return F.aggregate(word_counts(q), F.lit(0.0), lambda s, n: s + n / (n + 1)) if query_words(q) else F.lit(0.0)


def posted_after(ts) -> Column:
    return F.coalesce("posted_at", "created_at") >= F.to_timestamp(F.lit(ts))


def salary_between(low=None, high=None) -> Column:
    salary = F.coalesce("salary_min", "salary_max")
    bounds = [salary >= low] * (low is not None) + [salary <= high] * (high is not None)
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def publisher_match(names: list[str]) -> Column:
    """Any name occurs in publisher or apply_url; linkedin also by a link of its own."""
    text = F.lower(F.concat_ws("\n", safe("publisher"), safe("apply_url")))
    hit = F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.contains(text, n))
    return hit | F.col("linkedin_url").isNotNull() if "linkedin" in names else hit


def apply_mode(mode: str) -> Column:
    none = F.col("apply_url").isNull() & F.col("linkedin_url").isNull()
    return {"easy": none, "external": ~none}.get(mode, F.lit(True))


def _contains(column: str, text: str) -> Column:
    return F.lower(safe(column)).contains(text.lower())


def filter_jobs(jobs: DataFrame, job_type=None, level=None, location=None, skill=None, visa=None, emirate=None, joiner=None, remote=None, category=None) -> DataFrame:
    """Active jobs that meet the given single values; job_order() puts the newest first."""
    equal = {"job_type": job_type, "experience_level": level, "visa_type": visa, "emirate": emirate, "immediate_joiner": joiner, "remote_uae": remote, "job_category": category}
    out = jobs.where("is_active")
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    if location is not None:
        out = out.where(_contains("location_uae", location))
    return out if skill is None else out.where(F.array_contains("skills", skill))


def filter_jobs_multi(jobs: DataFrame, emirates=(), categories=(), levels=(), job_types=(), remote=None, joiner=None, after=None, salary_min=None, salary_max=None, q="", publishers=(), company="", mode="", easy_apply=None, visa="") -> DataFrame:
    """Active jobs that meet all given facets; lists are alternatives."""
    out = jobs.where("is_active")
    for name, values in (("emirate", emirates), ("job_category", categories), ("experience_level", levels), ("job_type", job_types)):
        if values:
            out = out.where(F.col(name).isin(list(values)))
    for name, value in (("remote_uae", remote), ("immediate_joiner", joiner), ("linkedin_easy_apply", easy_apply), ("visa_type", visa or None)):
        if value is not None:
            out = out.where(F.col(name) == value)
    conditions = [
        (after, lambda: posted_after(after)), (salary_min is not None or salary_max is not None, lambda: salary_between(salary_min, salary_max)), (q, lambda: full_text_match(q)),
        (publishers, lambda: publisher_match(list(publishers))), (company, lambda: _contains("company_name", company)), (mode, lambda: apply_mode(mode)),
    ]
    for given, condition in conditions:
        if given:
            out = out.where(condition())
    return out


THIN, THIN_DAYS = 300, 5


def sort_keys(sort: str = "newest", q: str = "") -> list[tuple[Column, bool]]:
    """Sort keys and whether they fall, nulls last: an explicit date order wins over relevance; newest ranks thin
    descriptions 5 days older."""
    sort = sort or "newest"
    thin = F.when(F.length(safe("description")) < THIN, F.expr(f"INTERVAL {THIN_DAYS} DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    keys = {"newest": [(F.col("created_at") - thin, True)], "date_asc": [(F.col("created_at"), False)]}.get(sort, [])
    if q:
        keys.append((text_rank(q), True))
    if sort == "salary_desc":
        keys.append((F.coalesce("salary_max", "salary_min"), True))
    if sort == "salary_asc":
        keys.append((F.coalesce("salary_min", "salary_max"), False))
    return [*keys, (F.col("created_at"), True), (F.col("id"), False)]


def order_of(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [k.desc_nulls_last() if falls else k.asc_nulls_last() for k, falls in keys]


def job_order(sort: str = "newest", q: str = "") -> list[Column]:
    return order_of(sort_keys(sort, q))


CURSOR = "_cursor"


def page_after(df: DataFrame, keys: list[tuple[Column, bool]], after=None, size: int = 20) -> DataFrame:
    """The page that follows a row in the order of keys, the last of which is unique, with a column _cursor; after:
    the last row's _cursor on the page before, None for the first page. Rows up to the cursor are filtered out, the
    first key's bound by itself so that it reaches the scan; so a late page costs what the first one costs, and rows
    that come or go before the cursor move nothing."""
    size = min(max(size, 1), 100)
    cursor = F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)]).alias(CURSOR)
    if after is not None:
        values = [F.lit(after[f"k{i}"]) for i in range(len(keys))]

        def behind(i: int, or_equal: bool) -> Column:
            key, falls = keys[i]
            if after[f"k{i}"] is None:  # nulls are last: only nulls are left
                return key.isNull() if or_equal else F.lit(False)
            past = (key < values[i]) if falls else (key > values[i])
            return past | key.isNull() | ((key == values[i]) if or_equal else F.lit(False))

        later, same = behind(0, False), keys[0][0].eqNullSafe(values[0])
        for i in range(1, len(keys)):
            later = later | (same & behind(i, False))
            same = same & keys[i][0].eqNullSafe(values[i])
        df = df.where(behind(0, True)).where(later)
    return df.orderBy(*order_of(keys)).limit(size).select("*", cursor)


def page(df: DataFrame, order: list, number: int = 0, size: int = 20) -> DataFrame:
    """One page of df in that order; sizes are held to 1 to 100."""
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset(max(number, 0) * size).limit(size)


def admin_search(jobs: DataFrame, q: str = "", active: bool | None = None) -> DataFrame:
    out = jobs.where(_contains("title", q) | _contains("company_name", q)) if q else jobs
    return out if active is None else out.where(F.col("is_active") == active)


def directory_search(companies: DataFrame, q="", city="", category="") -> DataFrame:
    out = companies.where(F.col("status") == "APPROVED")
    if q:
        out = out.where(_contains("name", q))
    for name, value in (("city", city), ("category", category)):
        if value:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.desc("featured"), "name", "id")


def users_by_email(users: DataFrame, q: str) -> DataFrame:
    return users.where(_contains("email", q))
