"""Landed feed payloads to postings. raw has one payload a row in the text column `payload`; rows that a feed
marks as incomplete are dropped. Every mapper gives the columns of POSTING."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import text as X

POSTING = ["external_job_id", "source", "publisher", "title", "company_name", "description", "requirements", "location_uae", "emirate", "salary_min", "salary_max", "salary_currency", "job_type", "experience_level", "apply_url", "remote_uae", "posted_at", "linkedin_easy_apply"]


def _text(c) -> Column:
    """A field's text; blank is absent."""
    return F.when(~X.is_blank(c), X.col(c))


def _posting(rows: DataFrame, **given) -> DataFrame:
    absent = {"requirements": "string", "emirate": "string", "salary_min": "int", "salary_max": "int", "posted_at": "timestamp", "linkedin_easy_apply": "boolean"}
    columns = {c: given.get(c, F.lit(None).cast(absent[c]) if c in absent else None) for c in POSTING}
    return rows.select([(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in columns.items()])


def _items(raw: DataFrame, schema: str, *paths: str) -> DataFrame:
    """One row for each element of the first of paths that is an array; `$` is the payload itself."""
    found = [F.from_json(F.col("payload") if p == "$" else F.get_json_object("payload", p), f"array<struct<{schema}>>") for p in paths]
    # A field that should be an array but is none reads as null, and the next path is tried.
    return raw.select(F.explode(F.filter(F.coalesce(*found), lambda x: x.isNotNull())).alias("j")).select("j.*")


def postings_from_adzuna(raw: DataFrame) -> DataFrame:
    schema = "id string, title string, redirect_url string, company struct<display_name: string>, location struct<display_name: string, area: array<string>>, description string, salary_min double, salary_max double, contract_time string, created string"
    rows = _items(raw, schema, "$.results")
    rows = rows.where(_text("id").isNotNull() & _text("title").isNotNull() & _text("redirect_url").isNotNull())
    place = F.coalesce("location.display_name", F.lit("United Arab Emirates"))
    description = X.strip_tags("description")
    return _posting(
        rows, external_job_id=F.col("id"), source="adzuna", publisher="Adzuna", title=F.col("title"), company_name=F.coalesce("company.display_name", F.lit("Unknown company")),
        description=F.when(X.is_blank(description), F.col("title")).otherwise(description), location_uae=place, emirate=X.infer_emirate(place, F.array_join("location.area", " "), hyphens=True),
        salary_min=X.round_half_up("salary_min"), salary_max=X.round_half_up("salary_max"), salary_currency="AED", job_type=F.when(F.col("contract_time") == "part_time", "part_time").otherwise("full_time"),
        experience_level=X.infer_experience_level("title", False), apply_url=F.col("redirect_url"), remote_uae=False, posted_at=X.posted_at("created", "instant"),
    )


def postings_from_jsearch(raw: DataFrame) -> DataFrame:
    schema = (
        "job_id string, job_title string, job_apply_link string, apply_options array<struct<apply_link: string, publisher: string>>, job_google_link string, employer_name string, job_highlights map<string, array<string>>, job_description string, "
        "job_publisher string, job_city string, job_state string, job_location string, job_country string, job_is_remote boolean, job_min_salary double, job_max_salary double, job_salary_currency string, job_employment_types array<string>, "
        "job_employment_type string, job_posted_at_datetime_utc string, job_posted_at_timestamp long"
    )
    ok = raw.where(F.coalesce(F.get_json_object("payload", "$.status"), F.lit("OK")) == "OK")
    rows = _items(ok, schema, "$.data.jobs", "$.data")
    option = lambda f: F.get("apply_options", 0)[f]
    url = X.first_non_blank("job_apply_link", option("apply_link"), "job_google_link")
    rows = rows.withColumn("_url", url).where(_text("job_id").isNotNull() & _text("job_title").isNotNull() & F.col("_url").isNotNull())
    block = X.format_highlights(F.coalesce("job_highlights", F.expr("cast(map() as map<string, array<string>>)")))
    body = _text("job_description")
    description = X.first_match([((block != "") & body.isNotNull(), F.concat(block, F.lit("\n\n"), body)), (block != "", block)], F.coalesce(body, F.col("job_title")))
    city = X.first_non_blank("job_city", "job_state", X.city_from_location("job_location"))
    stamp = F.coalesce(X.posted_at("job_posted_at_datetime_utc", "datetime"), F.when(F.col("job_posted_at_timestamp") > 0, F.timestamp_seconds("job_posted_at_timestamp")))
    return _posting(
        rows, external_job_id=F.col("job_id"), source="jsearch", publisher=X.first_non_blank("job_publisher", option("publisher")), title=F.col("job_title"), company_name=F.coalesce(_text("employer_name"), F.lit("Unknown")),
        description=description, location_uae=F.concat(X.safe(city), F.lit(", "), F.coalesce(_text("job_country"), F.lit("AE"))), emirate=X.infer_emirate(city, "job_state"), salary_min=X.round_half_up("job_min_salary"),
        salary_max=X.round_half_up("job_max_salary"), salary_currency=F.coalesce(_text("job_salary_currency"), F.lit("AED")), job_type=X.map_employment_type(F.coalesce(F.get("job_employment_types", 0), _text("job_employment_type"))),
        experience_level=X.infer_experience_level("job_title", True), apply_url=F.col("_url"), remote_uae=F.coalesce("job_is_remote", F.lit(False)), posted_at=stamp,
    )


def postings_from_careerjet(raw: DataFrame) -> DataFrame:
    rows = _items(raw, "url string, title string, company string, locations string, description string, salary string, date string", "$.jobs")
    rows = rows.withColumn("_id", F.regexp_extract(X.safe("url"), "/jobad/([a-zA-Z0-9]+)", 1)).where((F.col("_id") != "") & _text("title").isNotNull())
    return _posting(
        rows, external_job_id=F.concat(F.lit("cj_"), "_id"), source="careerjet", publisher="CareerJet", title=F.col("title"), company_name=F.coalesce(_text("company"), F.lit("Unknown")), description=F.coalesce(_text("description"), "title"),
        location_uae=X.clean_location_feed(_text("locations")), emirate=X.infer_emirate("locations"), salary_currency="AED", job_type="full_time", experience_level=X.infer_experience_level("title", True), apply_url=F.col("url"),
        remote_uae=False, posted_at=X.posted_at("date", "offset"),
    )


def postings_from_himalayas(raw: DataFrame) -> DataFrame:
    schema = "guid string, id string, title string, companyName string, company string, applicationLink string, url string, slug string, description string, excerpt string, minSalary int, maxSalary int"
    rows = _items(raw, schema, "$.jobs", "$")
    link = F.coalesce(_text(F.coalesce("applicationLink", "url")), F.concat(F.lit("https://himalayas.app/jobs/"), "slug"))
    rows = rows.withColumns({"_id": F.coalesce("guid", "id"), "_url": link}).where("_id is not null and title is not null and _url is not null")
    full, short = X.html_to_text(X.safe("description")), X.html_to_text(F.coalesce("excerpt", "title"))
    return _posting(
        rows, external_job_id=F.col("_id"), source="himalayas", publisher="Himalayas", title=F.col("title"), company_name=F.coalesce("companyName", "company", F.lit("Unknown")), description=F.when(X.is_blank(full), short).otherwise(full),
        location_uae="Remote (UAE-friendly)", salary_min=X.usd_to_aed("minSalary"), salary_max=X.usd_to_aed("maxSalary"), salary_currency="AED", job_type="full_time", experience_level=X.infer_experience_level("title", True),
        apply_url=F.col("_url"), remote_uae=True,
    )


def postings_from_remoteok(raw: DataFrame) -> DataFrame:
    rows = _items(raw, "id string, position string, company string, url string, description string, salary_min int, salary_max int", "$")
    rows = rows.where("id is not null and position is not null and url is not null")  # the first entry is a notice
    title = X.repair_mojibake("position")
    description = X.repair_mojibake(X.strip_tags(X.safe("description")))
    return _posting(
        rows, external_job_id=F.col("id"), source="remoteok", publisher="RemoteOK", title=title, company_name=X.repair_mojibake(F.coalesce("company", F.lit("Remote employer"))),
        description=F.when(X.is_blank(description), title).otherwise(description), location_uae="Remote (UAE-friendly)", salary_min=X.usd_to_aed("salary_min"), salary_max=X.usd_to_aed("salary_max"), salary_currency="AED", job_type="full_time",
        experience_level=X.infer_experience_level("position", False), apply_url=F.col("url"), remote_uae=True,
    )


def postings_from_external(raw: DataFrame) -> DataFrame:
    """Pushed batches {source, jobs: [...]}."""
    schema = "externalId string, title string, company string, description string, location string, emirate string, applyUrl string, jobType string, postedAt string, salaryMin int, salaryMax int, salaryCurrency string, remoteUae boolean, publisher string, linkedinEasyApply boolean"
    source = F.coalesce(_text(F.get_json_object("payload", "$.source")), F.lit("external"))
    jobs = F.from_json(F.get_json_object("payload", "$.jobs"), f"array<struct<{schema}>>")
    rows = raw.select(source.alias("_source"), F.explode(jobs).alias("j")).select("_source", "j.*").where("externalId is not null and title is not null and applyUrl is not null")
    return _posting(
        rows, external_job_id=F.concat_ws("_", "_source", "externalId"), source=F.col("_source"), publisher=F.coalesce("publisher", "_source"), title=F.col("title"), company_name=F.coalesce("company", F.lit("Unknown")),
        description=F.coalesce("description", "title"), location_uae=F.coalesce("location", F.lit("United Arab Emirates, AE")), emirate=F.col("emirate"), salary_min=F.col("salaryMin"), salary_max=F.col("salaryMax"),
        salary_currency=F.coalesce("salaryCurrency", F.lit("AED")), job_type=F.coalesce("jobType", F.lit("full_time")), experience_level=X.infer_experience_level("title", True), apply_url=F.col("applyUrl"),
        remote_uae=F.coalesce("remoteUae", F.lit(False)), posted_at=X.posted_at("postedAt", "day"), linkedin_easy_apply=F.col("linkedinEasyApply"),
    )


#: Feeds by name; a new feed is one more entry.
FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "adzuna": postings_from_adzuna, "jsearch": postings_from_jsearch, "careerjet": postings_from_careerjet, "himalayas": postings_from_himalayas, "remoteok": postings_from_remoteok, "external": postings_from_external,
}


def ingest(raw: DataFrame, enabled: dict[str, bool] | None = None, feeds: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Postings of raw payloads (feed, payload), each by its feed's mapper. Feeds that are switched off in enabled
    are not read; feeds without a mapper give no rows."""
    mappers = {name: f for name, f in (feeds or FEEDS).items() if (enabled or {}).get(name, True)}
    if not mappers:
        raise ValueError("no feed is enabled")
    return reduce(DataFrame.unionByName, [f(raw.where(F.col("feed") == name).select("payload")).withColumn("feed", F.lit(name)) for name, f in mappers.items()])


def route_ats_url(url, html=None) -> Column:
    """struct(ats, board, job) of a recruiting platform's link; Greenhouse also when embedded in a page."""
    page = X.safe(html) if html is not None else F.lit("")
    rules = [("lever", r"https://(?:jobs|hire)\.lever\.co/([^/]+)/([^/?#]+)"), ("ashby", r"https://jobs\.ashbyhq\.com/([^/]+)/([^/?#]+)"), ("greenhouse", r"https://boards\.greenhouse\.io/([^/]+)/jobs/(\d+)")]
    made = lambda ats, board, job: F.struct(F.lit(ats).alias("ats"), board.alias("board"), job.alias("job"))
    cases = [(X.safe(url).rlike(p), made(ats, F.regexp_extract(url, p, 1), F.regexp_extract(url, p, 2))) for ats, p in rules]
    job, board = F.regexp_extract(X.safe(url), r"[?&]gh_jid=(\d+)", 1), F.regexp_extract(page, r"boards\.greenhouse\.io/embed/job_board/js\?for=([^&\"']+)", 1)
    return X.first_match([*cases, ((job != "") & (board != ""), made("greenhouse", board, job))])


def postings_from_ats(raw: DataFrame, kind: str) -> DataFrame:
    """title, company_name, description, location_uae, apply_url, complete, message of job payloads (payload,
    url, board) of greenhouse, lever or ashby. A place outside the UAE needs a review."""
    get = lambda path: _text(F.get_json_object("payload", path))
    if kind == "greenhouse":
        title, company, link = get("$.title"), X.company_from_host("url"), F.col("url")
        description, place = X.strip_tags_entities(get("$.content")), get("$.location.name")
    elif kind == "lever":
        title, company, link = get("$.text"), F.coalesce(get("$.company"), "board"), F.coalesce(get("$.hostedUrl"), get("$.applyUrl"), "url")
        description, place = X.first_non_blank(X.strip_tags_entities(get("$.description")), get("$.descriptionPlain")), get("$.categories.location")
    elif kind == "ashby":
        own = lambda f: F.when(F.get_json_object("payload", "$.job").isNotNull(), get(f"$.job.{f}")).otherwise(get(f"$.{f}"))
        title, company, link = own("title"), F.coalesce(own("organizationName"), "board"), F.col("url")
        description, place = X.first_non_blank(X.strip_tags_entities(own("descriptionHtml")), own("descriptionPlain")), own("locationName")
    else:
        raise ValueError(f"unknown kind {kind}")
    rows = raw.select(title.alias("title"), _text(company).alias("company_name"), _text(description).alias("description"), X.safe(place).alias("_place"), link.alias("apply_url")).where("title is not null")
    city = X.infer_city("_place")
    abroad = (F.col("_place") != "") & city.isNull()
    shown = F.when(F.length("_place") > 80, F.concat(F.substring("_place", 1, 77), F.lit("…"))).otherwise(F.col("_place"))
    message = X.first_match(
        [(abroad, F.concat(F.lit("The posting names a place beyond the UAE ("), shown, F.lit("). Review it before importing."))), (F.col("description").isNull(), "Description could not be extracted. Fill it in before importing.")]
    )
    return rows.select("title", "company_name", "description", city.alias("location_uae"), "apply_url", (F.col("description").isNotNull() & ~abroad).alias("complete"), message.alias("message"))
