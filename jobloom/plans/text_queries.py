"""Row functions over whole tables (group B), feeds and pages (group A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import html, rules
from jobloom.functions import text as X
from jobloom.operators import scoring
from jobloom.plans.catalog import Views, query
from jobloom.sources import feeds, pages
from jobloom.sources.tables import stored

_Q = lambda s: s.replace("'", "''")


def _re(column: str, pattern: str) -> str:
    """RE2 spelling of a search: it has no look-around, and these stand next to word characters."""
    return f"regexp_matches(coalesce({column}, ''), '(?i){_Q(pattern.replace('(?<![\\w])', chr(92) + 'b').replace('(?![\\w])(?!script)', chr(92) + 'b').replace('(?![\\w])', chr(92) + 'b').replace('c' + chr(92) + '#', 'c#'))}')"


def _has(column: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{_Q(t)}')" for t in tokens) + ")"


def _case(cases: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v if v.startswith('(') else repr(v)}" for c, v in cases) + f" ELSE {other} END"


_STRIP = lambda c: f"regexp_replace({c}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_LOWER = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"


def _emirate(column: str) -> str:
    return _case([(f"contains(lower({column}), '{n}')", code) for n, code, _ in rules.EMIRATES])


def _level(staff: bool) -> str:
    return _case([(_has("lower(title)", ["senior", "lead", "principal"] + ["staff"] * staff), "senior_5_plus"), (_has("lower(title)", ["junior", "graduate", "entry"]), "junior_1_2_yrs"), (_has("lower(title)", ["intern"]), "fresher")], "'mid_3_5_yrs'")


_NAMES = {n: d for n, _, d in rules.EMIRATES}
_LOC = _case([(f"contains(replace(lower(coalesce(location_uae, '')), '-', ' '), '{n}')", _NAMES[n]) for n in rules.CITY_ORDER])


@query("b01_strip_tags", f"SELECT page_id, {_STRIP('''regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')''')} AS text FROM pages")
def strip_tags(v: Views):
    return v.pages.select("page_id", X.strip_tags("html").alias("text"))


@query("b02_html_to_text_breaks", f"SELECT page_id, {_STRIP('''regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>|</(?:p|li|div|h[1-6])>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM pages")
def breaks(v: Views):
    return v.pages.select("page_id", X.html_to_text("html").alias("text"))


@query("b03_strip_tags_entities", f"SELECT page_id, {_STRIP('''regexp_replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s{2,}', ' ', 'g')''')} AS text FROM pages")
def entities(v: Views):
    return v.pages.select("page_id", X.strip_tags_entities("html").alias("text"))


@query("b04_repair_mojibake", "SELECT doc_id, text AS repaired FROM documents WHERE text IS NOT NULL")
def mojibake(v: Views):
    broken = F.when(~F.col("text").rlike(r"[^\x{00}-\x{FF}]"), F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return v.documents.where("text is not null").select("doc_id", X.repair_mojibake(broken).alias("repaired"))


@query("b05_infer_emirate", f"SELECT seq, {_emirate('location_uae')} AS code FROM postings")
def emirate(v: Views):
    return v.postings.select("seq", X.infer_emirate("location_uae").alias("code"))


@query("b06_infer_uae_city", f"SELECT seq, {_LOC} AS city FROM postings")
def city(v: Views):
    return v.postings.select("seq", X.infer_city("location_uae").alias("city"))


@query("b07_infer_experience_level", f"SELECT seq, {_level(True)} AS with_staff, {_level(False)} AS without_staff FROM postings")
def level(v: Views):
    return v.postings.select("seq", X.infer_experience_level("title", True).alias("with_staff"), X.infer_experience_level("title", False).alias("without_staff"))


_KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'FULLTIME' WHEN 1 THEN 'parttime' WHEN 2 THEN 'CONTRACTOR' WHEN 3 THEN 'INTERN' WHEN 4 THEN 'x' END"


@query("b08_map_employment_type", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'internship' ELSE 'full_time' END AS kind FROM orders")
def employment(v: Views):
    return v.orders.select("o_orderkey", X.map_employment_type(F.expr(_KIND)).alias("kind"))


@query("b09_posted_at", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN date_trunc('day', o_orderdate)::TIMESTAMP WHEN o_orderkey % 5 = 1 THEN date_trunc('second', o_orderdate) - INTERVAL 4 HOUR ELSE date_trunc('second', o_orderdate) END AS at FROM orders")
def posted(v: Views):
    forms = [("instant", "yyyy-MM-dd'T'HH:mm:ss'Z'"), ("offset", "yyyy-MM-dd'T'HH:mm:ss'+04:00'"), ("datetime", "yyyy-MM-dd HH:mm:ss"), ("day", "yyyy-MM-dd'T'HH:mm:ss"), ("instant", "'soon'")]
    k = F.col("o_orderkey") % 5
    return v.orders.select("o_orderkey", X.first_match([(k == i, X.posted_at(F.date_format("o_orderdate", f), form)) for i, (form, f) in enumerate(forms)]).alias("at"))


@query("b10_usd_to_aed", "SELECT o_orderkey, CAST(floor(o_totalprice * 3.67::DOUBLE + 0.5) AS INT) AS aed FROM orders")
def aed(v: Views):
    return v.orders.select("o_orderkey", X.usd_to_aed("o_totalprice").alias("aed"))


@query("b11_city_from_location", "SELECT seq, CASE WHEN trim(location_uae) <> '' THEN trim(regexp_replace(trim(regexp_extract(location_uae, '^(.*?)(?:[•|\\-]| via |$)', 1)), '(?i),\\s*(uae|united arab emirates)\\s*$', '')) END AS city FROM postings")
def first_place(v: Views):
    return v.postings.select("seq", X.city_from_location("location_uae").alias("city"))


@query("b12_clean_location_feed", "SELECT seq, CASE location_uae WHEN 'Dubai, Dubai, United Arab Emirates' THEN 'Dubai, UAE' WHEN '' THEN 'UAE' ELSE location_uae END AS place FROM postings")
def feed_place(v: Views):
    return v.postings.select("seq", X.clean_location_feed("location_uae").alias("place"))


@query("b13_clean_location_display", "SELECT seq, trim(regexp_replace(regexp_replace(location_uae, '(?i)\\s*-\\s*United Arab Emirates\\s*\\(UAE\\)', '', 'g'), '(?i),\\s*AE\\s*$', '')) AS place FROM postings")
def shown_place(v: Views):
    return v.postings.select("seq", X.clean_location_display("location_uae").alias("place"))


@query("b14_format_highlights", "SELECT p_partkey, 'Brand: ' || trim(p_brand) || '.' || chr(10) || chr(10) || 'Type: ' || trim(p_type) || '. ' || trim(p_name) || '.' AS block FROM part")
def highlights(v: Views):
    return v.part.select("p_partkey", X.format_highlights(F.create_map(F.lit("Brand"), F.array("p_brand", F.lit(" ")), F.lit("Type"), F.array("p_type", "p_name"), F.lit("None"), F.expr("cast(array() as array<string>)"))).alias("block"))


@query("b15_first_non_blank", "SELECT id, coalesce(CASE WHEN trim(display_name) <> '' THEN display_name END, CASE WHEN trim(country) <> '' THEN country END, email) AS shown FROM users")
def non_blank(v: Views):
    return v.users.select("id", X.first_non_blank("display_name", "country", "email").alias("shown"))


@query("b16_parse_salary_range", "SELECT id, salary_min AS low, CASE WHEN salary_min IS NOT NULL THEN coalesce(salary_max, salary_min) END AS high FROM jobs")
def salary(v: Views):
    text = F.concat(F.lit("AED "), F.format_number("salary_min", 0), F.coalesce(F.concat(F.lit(" - "), F.format_number("salary_max", 0)), F.lit(" a month")))
    found = X.parse_salary_range(text)
    return v.jobs.select("id", found["low"].alias("low"), found["high"].alias("high"))


@query("b17_linkedin_job_id", "SELECT id, CASE WHEN linkedin_url IS NOT NULL THEN CAST(id AS STRING) END AS job FROM jobs")
def job_id(v: Views):
    return v.jobs.select("id", X.linkedin_job_id("linkedin_url").alias("job"))


@query("b18_linkedin_type_and_level", f"SELECT seq, {_case([(_has(_LOWER, ['part-time', 'part time']), 'part_time'), (_has(_LOWER, ['contract']), 'contract'), (_has(_LOWER, ['internship']), 'internship')], chr(39) + 'full_time' + chr(39))} AS kind, {_case([(_has(_LOWER, ['entry level', 'fresher', 'internship', 'associate', 'junior']), 'junior'), (_has(_LOWER, ['director', 'executive', 'senior']), 'senior')], chr(39) + 'mid' + chr(39))} AS level FROM postings")
def kinds(v: Views):
    text = F.concat_ws(" ", "title", "description")
    return v.postings.select("seq", X.linkedin_job_type(text).alias("kind"), X.linkedin_level(text).alias("level"))


_BARE = f"trim(regexp_replace(regexp_replace(regexp_replace(title, '(?i){rules.SENIOR_WORDS}\\s*', ' ', 'g'), '(?i){rules.PLACE_TAIL}', '', 'g'), '\\s+', ' ', 'g'))"
_WORD = f"lower(regexp_extract(title, '(?i){rules.SENIOR_WORDS}', 1))"
_PREFIX = f"CASE WHEN {_WORD} IN ('sr', 'sr.') THEN 'Senior' WHEN {_WORD} IN ('jr', 'jr.') THEN 'Junior' ELSE upper(substring({_WORD}, 1, 1)) || substring({_WORD}, 2) END"
_CANON = "CASE " + " ".join(f"WHEN regexp_matches({_BARE}, '(?i){p}') THEN '{t}'" for p, t in rules.TITLES) + " END"


@query("b19_normalize_title", f"SELECT seq, CASE WHEN {_CANON} IS NULL THEN {_BARE} ELSE trim({_PREFIX} || ' ' || {_CANON}) END AS title FROM postings")
def title(v: Views):
    return v.postings.select("seq", X.normalize_title("title").alias("title"))


_NOISE = f"regexp_replace(regexp_replace(trim(company_name), '(?i){rules.COMPANY_NOISE}', ''), '[,\\s]+$', '')"


@query("b20_normalize_company", f"SELECT seq, CASE WHEN trim({_NOISE}) = '' THEN trim(company_name) ELSE trim({_NOISE}) END AS company FROM postings")
def company(v: Views):
    return v.postings.select("seq", X.normalize_company("company_name").alias("company"))


_SPELLED = f"replace({_emirate('location_uae')}, '_', ' ')"


@query("b21_normalize_location", f"SELECT seq, CASE WHEN seq % 2 = 0 AND {_emirate('location_uae')} IS NOT NULL THEN upper(substring({_SPELLED}, 1, 1)) || substring({_SPELLED}, 2) WHEN seq % 2 = 0 THEN '' ELSE trim(location_uae) END AS city, {_emirate('location_uae')} AS emirate, CASE WHEN seq % 3 = 0 THEN 'QA' ELSE 'AE' END AS country FROM postings")
def location(v: Views):
    place = X.normalize_location(F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("location_uae")), "location_uae", F.when(F.col("seq") % 3 == 0, " qa "))
    return v.postings.select("seq", place.alias("p")).select("seq", "p.*")


@query("b22_classify_seniority", "SELECT seq, " + _case([(f"regexp_matches({_LOWER}, '\\b(?:{p})\\b')", n) for n, p in rules.SENIORITY], "'mid'") + " AS seniority FROM postings")
def seniority(v: Views):
    return v.postings.select("seq", X.classify_seniority("title", "description").alias("seniority"))


@query("b23_classify_work_mode", f"SELECT seq, CASE WHEN remote_uae THEN 'remote' WHEN regexp_matches({_LOWER}, '\\bhybrid\\b') THEN 'hybrid' WHEN regexp_matches({_LOWER}, '\\b(?:remote|work from home|wfh)\\b') THEN 'remote' ELSE 'onsite' END AS mode FROM postings")
def work_mode(v: Views):
    return v.postings.select("seq", X.classify_work_mode("title", "description", "remote_uae").alias("mode"))


_TECH = "list_filter([" + ", ".join(f"CASE WHEN {_re('description', p)} THEN '{k}' END" for k, p, _ in rules.TECHNOLOGIES) + "], lambda x: x IS NOT NULL)"


@query("b24_extract_technologies", f"SELECT seq, array_to_string({_TECH}, ',') AS technologies FROM postings")
def technologies(v: Views):
    return v.postings.select("seq", F.array_join(X.extract_technologies("description"), ",").alias("technologies"))


@query("b25_tech_flags", "SELECT seq, " + ", ".join("(" + " OR ".join(f"list_contains(t, '{k}')" for k in keys) + f") AS {flag}" for flag, keys in rules.TECH_FLAGS.items()) + f" FROM (SELECT seq, {_TECH} AS t FROM postings)")
def flags(v: Views):
    found = v.postings.select("seq", X.extract_technologies("description").alias("t"))
    return found.select("seq", *[c.alias(f) for f, c in X.tech_flags("t").items()])


_SHOWN = "CASE x " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, _, n in rules.TECHNOLOGIES) + " END"


@query("b27_skills_from_text", f"SELECT seq, CASE WHEN len(t) = 0 THEN 'General IT,Problem Solving' ELSE array_to_string(list_transform(t, lambda x: {_SHOWN}), ',') END AS skills FROM (SELECT seq, {_TECH} AS t FROM postings)")
def skills(v: Views):
    return v.postings.select("seq", F.array_join(X.skills_from_text("description", F.lit("")), ",").alias("skills"))


@query("b26_tech_display_name", "SELECT DISTINCT skill, CASE skill WHEN 'java' THEN 'Java' WHEN 'spring boot' THEN 'Spring Boot' WHEN 'sql' THEN 'Sql' WHEN 'python' THEN 'Python' WHEN 'aws' THEN 'AWS' WHEN 'react' THEN 'React' ELSE 'JavaScript' END AS shown FROM (SELECT unnest(split(skills_text, ',')) AS skill FROM jobs)")
def display(v: Views):
    skill = v.jobs.select(F.explode(F.split("skills_text", ",")).alias("skill")).distinct()
    return skill.select("skill", X.tech_display_name(F.col("skill")).alias("shown"))


_PADDED = "lower(' ' || title || ' ' || coalesce(description, '') || ' ')"
_CATEGORY = _case([(_has(_PADDED, tokens), n) for n, tokens in rules.CATEGORIES])


@query("b28_classify_category", f"SELECT seq, {_CATEGORY} AS category FROM postings")
def category(v: Views):
    return v.postings.select("seq", X.classify_category("title", "description").alias("category"))


@query("b29_valid_category_or_infer", f"SELECT seq, CASE WHEN seq % 3 = 0 THEN 'qa' ELSE coalesce({_CATEGORY}, 'other') END AS category FROM postings")
def valid_category(v: Views):
    return v.postings.select("seq", X.valid_category_or_infer(F.when(F.col("seq") % 3 == 0, "qa").otherwise("data"), "title", "description").alias("category"))


# RE2's word boundaries know ASCII only: letters beyond it are replaced by one of it.
_HITS = f"least(20, len(regexp_extract_all(regexp_replace(coalesce(description, ''), '[^\\x00-\\x7F]', 'x', 'g'), '(?i){rules.TECH_DOMAIN}')))"
_POINTS = f"""CASE WHEN {_re('title', rules.TECH_DOMAIN)} THEN 40 ELSE 0 END + least(25, 8 * len(t)) + {_HITS} + CASE WHEN regexp_matches(lower(title), '\\b(senior|lead|principal|junior|staff|intern)\\b') THEN 10 ELSE 0 END - CASE WHEN {_re('title', rules.STRONG_NEGATIVE)} THEN 25 ELSE 0 END"""


@query("b30_relevance_score", f"SELECT seq, CAST(greatest(0, least(100, {_POINTS})) AS INT) AS score FROM (SELECT *, {_TECH} AS t FROM postings)")
def relevance(v: Views):
    reasons = scoring.relevance_reasons("title", "description", F.size(X.extract_technologies("description")))
    return v.postings.select("seq", scoring.relevance_score(reasons).alias("score"))


_CLEAN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("b31_dedup_hash", f"SELECT seq, sha256(lower({_CLEAN('company_name')} || '|' || {_CLEAN('title')} || '|' || {_CLEAN('location_uae')})) AS hash FROM postings")
def hashed(v: Views):
    return v.postings.select("seq", X.dedup_hash("company_name", "title", "location_uae").alias("hash"))


_SLUG = "regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("b32_slugify", f"SELECT doc_id, CASE WHEN {_SLUG} = '' THEN 'job' ELSE {_SLUG} END AS slug FROM documents")
def slug(v: Views):
    return X.with_slug(v.documents.select("doc_id", "text"), "text").select("doc_id", "slug")


_FULL = "CASE WHEN starts_with(trim(u), 'http') THEN trim(u) ELSE 'https://' || trim(u) END"
_HOST = lambda u: f"CASE WHEN {u} IS NULL OR trim({u}) = '' THEN NULL ELSE nullif(regexp_replace(lower(regexp_extract({u}, '^https?://([^/?#]+)', 1)), '^www\\.', ''), '') END"


@query("b33_host_of", f"SELECT id, {_HOST('apply_url')} AS host FROM jobs")
def host(v: Views):
    return v.jobs.select("id", X.host_of("apply_url").alias("host"))


_KNOWN = "CASE " + " ".join(f"WHEN starts_with(trim(lower(company_name)), '{p}') THEN '{rules.EMPLOYERS[p]}'" for p in sorted(rules.EMPLOYERS, key=lambda p: (-len(p), p)))
_BEST = f"coalesce({_HOST('apply_url')}, {_HOST('linkedin_url')})"
_DOMAIN = f"CASE WHEN {_BEST} IS NOT NULL AND {_BEST} NOT IN ({', '.join(repr(h) for h in rules.NOT_EMPLOYERS)}) THEN {_BEST} ELSE {_KNOWN} ELSE CASE WHEN length(regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g')) BETWEEN 1 AND 30 THEN regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g') || '.com' END END END"


@query("b33_company_domain", f"SELECT id, {_DOMAIN} AS domain FROM jobs")
def domain(v: Views):
    return v.jobs.select("id", X.company_domain("apply_url", "linkedin_url", "company_name").alias("domain"))


@query("b34_company_logo_url", "SELECT id, 'https://www.google.com/s2/favicons?sz=128&domain=' || company_domain AS logo FROM jobs")
def logo(v: Views):
    return v.jobs.select("id", X.company_logo_url("company_domain").alias("logo"))


@query("b35_company_from_host", "SELECT id, CASE WHEN apply_url LIKE '%firm%' THEN regexp_extract(apply_url, '(firm\\d+)', 1) END AS raw, CASE WHEN apply_url LIKE '%firm%' THEN 'F' || substring(regexp_extract(apply_url, '(firm\\d+)', 1), 2) WHEN apply_url LIKE '%linkedin%' THEN 'Linkedin' ELSE '' END AS name FROM jobs")
def from_host(v: Views):
    return v.jobs.select("id", F.when(F.col("apply_url").contains("firm"), F.regexp_extract("apply_url", r"(firm\d+)", 1)).alias("raw"), X.company_from_host("apply_url").alias("name"))


@query("b36_strip_site_suffix", "SELECT id, CASE WHEN id % 3 = 0 THEN title || ' – part two' ELSE title END AS title FROM jobs")
def suffix(v: Views):
    tail = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" – part two | "), "company_name")).when(F.col("id") % 3 == 1, F.concat("title", F.lit(" — "), "company_name")).otherwise(F.col("title"))
    return v.jobs.select("id", X.strip_site_suffix(tail).alias("title"))


@query("b37_is_job_description", "SELECT seq, len(list_filter(split(lower(title), ' '), lambda w: length(w) >= 4 AND contains(lower(description), w))) > 0 AS is_description FROM postings")
def described(v: Views):
    return v.postings.select("seq", X.is_job_description("description", "title").alias("is_description"))


@query("b38_parse_sections")
def sections(v: Views):
    return v.postings.select("seq", X.parse_sections("description").alias("sections"))


_MARKED = "regexp_replace(trim(regexp_replace(regexp_replace(coalesce(description, ''), '\\.([A-Z])', '. \\1', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '(?i)(^|[.!? ]) *(" + _Q(rules.SECTION_HEADERS) + ") *[:\\-—–]', '\\1' || chr(1) || '\\2' || chr(2), 'g')"


@query(
    "b38_section_items",
    f"""WITH c AS (SELECT seq, generate_subscripts(cs, 1) AS n, unnest(cs) AS c FROM (SELECT seq, split('Overview' || chr(2) || {_MARKED}, chr(1)) AS cs FROM postings WHERE trim(coalesce(description, '')) <> '')),
    s AS (SELECT seq, n, array_to_string(list_transform(split(lower(trim(split_part(c, chr(2), 1))), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS heading, trim(split_part(c, chr(2), -1)) AS body FROM c),
    i AS (SELECT seq, n, heading, body, list_filter(list_transform(split(regexp_replace(body, '\\. +([A-Z(\\[])', '.' || chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(regexp_replace(trim(x), '\\.$', ''))), lambda x: x <> '') AS items FROM s WHERE body <> ''),
    f AS (SELECT seq, n, heading, CASE WHEN len(items) > 0 THEN items ELSE [trim(regexp_replace(body, '\\.+$', ''))] END AS items, coalesce(lag(heading) OVER (PARTITION BY seq ORDER BY n) <> heading, true) AS opens FROM i),
    g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY seq ORDER BY n) AS section FROM f),
    u AS (SELECT seq, section, heading, opens, n, generate_subscripts(items, 1) AS k, unnest(items) AS item FROM g),
    o AS (SELECT *, row_number() OVER (PARTITION BY seq, section, item ORDER BY n, k) AS again FROM u)
    SELECT seq, section, heading, row_number() OVER (PARTITION BY seq, section ORDER BY n, k) AS place, item FROM o WHERE opens OR again = 1""",
)
def section_items(v: Views):
    """The items of each section, with their places; adjacent sections of one heading are one."""
    sections = v.postings.select("seq", F.posexplode(X.parse_sections("description")).alias("n", "s"))
    items = sections.select("seq", (F.col("n") + 1).cast("long").alias("section"), F.col("s.heading").alias("heading"), F.posexplode("s.items").alias("k", "item"))
    return items.select("seq", "section", "heading", (F.col("k") + 1).cast("long").alias("place"), "item")


@query("b39_format_sections", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Requirements' || chr(10) ELSE '' END || '• ' || p_brand || chr(10) || '• ' || p_type || chr(10) || chr(10) || 'Benefits' || chr(10) || '• ' || p_name AS text FROM part")
def formatted(v: Views):
    parts = F.array(F.struct(F.when(F.col("p_size") % 2 == 0, "Requirements").otherwise("").alias("heading"), F.array("p_brand", "p_type").alias("items")), F.struct(F.lit("Benefits").alias("heading"), F.array("p_name").alias("items")))
    return v.part.select("p_partkey", X.format_sections(parts).alias("text"))


@query("b40_sections_json", "SELECT p_partkey, '[{\"heading\":\"' || p_brand || '\",\"items\":[\"' || p_type || '\",\"' || p_name || '\"]}]' AS json FROM part")
def json(v: Views):
    return v.part.select("p_partkey", X.sections_json(F.array(F.struct(F.col("p_brand").alias("heading"), F.array("p_type", "p_name").alias("items")))).alias("json"))


_LETTERS, _UPPER = "len(regexp_extract_all(title, '\\p{L}'))", "len(regexp_extract_all(title, '\\p{Lu}'))"
_NWORDS, _TITLED = "len(split(title, ' '))", "len(regexp_extract_all(title, '\\b[A-Z][a-z'']+\\b'))"


@query("b41_score_header", f"SELECT seq, CASE WHEN length(title) BETWEEN 5 AND 60 THEN 1 ELSE 0 END + CASE WHEN floor({_UPPER} * 100 / greatest({_LETTERS}, 1)) > 50 OR ({_NWORDS} BETWEEN 2 AND 8 AND floor({_TITLED} * 100 / {_NWORDS}) >= 60) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '{_Q(X.HEADER_WORDS)}') THEN 1 ELSE 0 END AS score FROM postings")
def header(v: Views):
    return v.postings.select("seq", X.score_header("title").alias("score"))


@query("b42_description_html")
def rendered(v: Views):
    return v.postings.select("seq", html.description_html("description").alias("html"))


def _sanitised() -> str:
    """Without look-ahead and back references: kept tags are marked, the other tags go, and the marks are tags again."""
    out = "regexp_replace(coalesce(html, ''), '(?i)```[a-z]*', '', 'g')"
    # The first of the dangerous elements to begin ends with its own kind, so they go in one pass.
    out = f"regexp_replace({out}, '(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}\\s*>" for t in X.DANGEROUS.split("|")) + "', '', 'g')"
    out = f"regexp_replace({out}, '(?i)<(/?)(h3|p|ul|li)\\b[^>]*>', chr(1) || '\\1\\2' || chr(2), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for tag in ("h3", "p", "ul", "li"):
        out = f"regexp_replace({out}, '(?i)' || chr(1) || '(/?){tag}' || chr(2), '<\\1{tag}>', 'g')"
        out = f"regexp_replace({out}, '<{tag}>\\s*</{tag}>', '', 'g')"
    return _STRIP(out)


@query("b43_sanitise_html", f"SELECT page_id, {_sanitised()} AS html FROM pages")
def sanitised(v: Views):
    return v.pages.select("page_id", X.sanitise_html("html").alias("html"))


@query("b44_combine_description", "SELECT id, CASE WHEN requirements IS NULL THEN trim(description) ELSE trim(description) || chr(10) || chr(10) || 'Requirements' || chr(10) || requirements END AS text FROM jobs")
def combined(v: Views):
    return v.jobs.select("id", X.combine_description("description", "requirements").alias("text"))


@query("b45_skills_to_array", "SELECT id, replace(skills_text, ',', ';') AS skills FROM jobs")
def to_array(v: Views):
    text = F.when(F.col("id") % 2 == 0, F.to_json(F.split("skills_text", ","))).otherwise(F.replace("skills_text", F.lit(","), F.lit(" , ,")))
    return v.jobs.select("id", F.array_join(X.skills_to_array(text), ";").alias("skills"))


@query("b46_display_name", "SELECT id, coalesce(CASE WHEN trim(display_name) <> '' THEN display_name END, split_part(email, '@', 1)) AS name FROM users")
def shown_name(v: Views):
    return v.users.select("id", X.display_name("display_name", "email").alias("name"))


@query("b47_schema_org_employment_type", "SELECT id, CASE job_type WHEN 'full_time' THEN 'FULL_TIME' WHEN 'part_time' THEN 'PART_TIME' WHEN 'contract' THEN 'CONTRACTOR' WHEN 'internship' THEN 'INTERN' END AS kind FROM jobs")
def schema_org(v: Views):
    return v.jobs.select("id", X.schema_org_employment_type("job_type").alias("kind"))


_PLAIN = f"{_STRIP('''regexp_replace(translate(regexp_replace(coalesce(description, ''), '<[^>]+>', ' ', 'g'), '•', ' '), '\\s+', ' ', 'g')''')}"


@query("b48_plain_text", f"SELECT seq, {_PLAIN} AS text FROM postings")
def plain(v: Views):
    return v.postings.select("seq", X.plain_text("description").alias("text"))


@query("b48_meta_description", f"SELECT seq, CASE WHEN length(p) <= 155 THEN p WHEN length(regexp_extract(substring(p, 1, 155), '(?s)^(.*) ', 1)) < 77 THEN rtrim(substring(p, 1, 154)) || '…' ELSE rtrim(regexp_extract(substring(p, 1, 155), '(?s)^(.*) ', 1)) || '…' END AS text FROM (SELECT seq, {_PLAIN} AS p FROM postings)")
def meta(v: Views):
    return v.postings.select("seq", X.meta_description("description", "title", "company_name", "location_uae").alias("text"))


_ESCAPED = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query(
    "b49_body_html",
    f"""WITH l AS (SELECT seq, unnest(string_split(replace(description, chr(13), ''), chr(10))) AS raw, generate_subscripts(string_split(replace(description, chr(13), ''), chr(10)), 1) AS i FROM postings),
    s AS (SELECT seq, i, {_STRIP('raw')} AS line FROM l), k AS (SELECT seq, i, regexp_matches(line, '^(•|- |[*] )') AS bullet, line FROM s),
    t AS (SELECT seq, i, bullet, CASE WHEN bullet THEN {_STRIP('substring(line, 2)')} ELSE line END AS text FROM k),
    u AS (SELECT *, sum(length(text)) OVER (PARTITION BY seq ORDER BY i) AS used FROM t WHERE text <> '' AND (bullet OR lower(text) <> 'overview')),
    w AS (SELECT *, coalesce(lag(bullet) OVER o, false) AS before, lead(bullet) OVER o AS behind FROM u WHERE used <= 8000 WINDOW o AS (PARTITION BY seq ORDER BY i))
    SELECT p.seq, coalesce(h.html, '') AS html FROM postings p LEFT JOIN (SELECT seq, string_agg(CASE WHEN bullet AND NOT before THEN '<ul>' WHEN before AND NOT bullet THEN '</ul>' ELSE '' END || CASE WHEN bullet THEN '<li>' ELSE '<p>' END || {_ESCAPED('text')}
    || CASE WHEN bullet THEN '</li>' ELSE '</p>' END || CASE WHEN bullet AND behind IS NULL THEN '</ul>' ELSE '' END, '' ORDER BY i) AS html FROM w GROUP BY seq) h ON h.seq = p.seq""",
)
def body(v: Views):
    return v.postings.select("seq", X.body_html("description").alias("html"))


_SHOWN_PLACE = f"{_STRIP('''regexp_replace(regexp_replace(location_uae, '(?i)\\s*-\\s*United Arab Emirates\\s*\\(UAE\\)', '', 'g'), '(?i),\\s*AE\\s*$', '', 'g')''')}"
_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
_AMOUNT = "'\"value\":{\"@type\":\"QuantitativeValue\",' || CASE WHEN salary_min IS NULL THEN '' ELSE '\"minValue\":' || CAST(salary_min AS STRING) || ',' END || CASE WHEN salary_max IS NULL THEN '' ELSE '\"maxValue\":' || CAST(salary_max AS STRING) || ',' END || '\"unitText\":\"MONTH\"}'"
_LD = (
    "'{\"@context\":\"https://schema.org/\",\"@type\":\"JobPosting\",\"title\":' || to_json(title) || ',\"description\":' || to_json(" + _PLAIN + ") || ',\"hiringOrganization\":{\"@type\":\"Organization\",\"name\":' || to_json(company_name) || '},\"jobLocation\":{\"@type\":\"Place\",\"address\":{\"@type\":\"PostalAddress\",\"addressLocality\":' || to_json("
    + _SHOWN_PLACE + ") || ',\"addressCountry\":\"AE\"}},\"employmentType\":\"' || CASE job_type WHEN 'full_time' THEN 'FULL_TIME' WHEN 'part_time' THEN 'PART_TIME' WHEN 'contract' THEN 'CONTRACTOR' ELSE 'INTERN' END || '\"' || CASE WHEN posted_at IS NULL THEN '' ELSE ',\"datePosted\":\"' || "
    + _ISO("posted_at") + " || '\"' END || ',\"validThrough\":\"' || " + _ISO("expires_at") + " || '\",\"directApply\":' || CASE WHEN trim(coalesce(apply_url, '')) = '' THEN 'true' ELSE 'false' END || CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN '' ELSE ',\"baseSalary\":{\"@type\":\"MonetaryAmount\",\"currency\":\"AED\",' || " + _AMOUNT + " || '}' END || '}'"
)


@query("b50_job_posting_jsonld", f"SELECT id, replace(replace(replace({_LD}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS json FROM jobs")
def jsonld(v: Views):
    return v.jobs.select("id", X.job_posting_jsonld("title", "description", "company_name", "location_uae", "job_type", "posted_at", "expires_at", "apply_url", "salary_min", "salary_max", F.lit("AED")).alias("json"))


_REASONS = [("trim(title) = ''", "blank_title"), (_re("title", rules.STRONG_NEGATIVE), "other_profession"), (f"{_re('title', rules.TRADE)} AND NOT {_re('title', rules.TRADE_OVERRIDE)}", "trade"), (f"{_re('location_uae', rules.OTHER_COUNTRY)} AND NOT {_re('location_uae', rules.UAE_PLACE)}", "foreign_location"), (f"lower(location_uae) = '{rules.GENERIC_REMOTE}' AND {_re('description', rules.OTHER_COUNTRY)} AND NOT {_re('description', rules.UAE_PLACE)}", "foreign_remote"), (f"{_re('description', rules.EU_SCOPE)} AND NOT {_re('description', rules.UAE_PLACE)}", "eu_scope")]
_OWN, _WIDE = "trim(split_part(location_uae, ',', 1))", "(split_part(location_uae, ',', 1) || ' ' || location_uae || ' ' || coalesce(emirate, ''))"
_EMIRATE_SPELLED = f"replace({_emirate(_WIDE)}, '_', ' ')"
_EVERY_TECH = _TECH.replace("coalesce(description,", "coalesce(lower(title || ' ' || description || ' ' || coalesce(requirements, '')),")
#: All that scoring.enrich derives from a posting and later queries read; the country is the UAE throughout.
ENRICHED = f"""SELECT *, sha256(lower({_CLEAN('normalized_company_name')} || '|' || {_CLEAN('normalized_title')} || '|' || {_CLEAN('city')})) AS dedup_hash, reason IS NULL AND greatest(0, least(100, {_POINTS})) >= {rules.MIN_SCORE} AS accepted FROM (
    SELECT seq, source, external_job_id, publisher, title, description, apply_url, remote_uae, linkedin_easy_apply, CASE WHEN {_CANON} IS NULL THEN {_BARE} ELSE trim({_PREFIX} || ' ' || {_CANON}) END AS normalized_title, CASE WHEN trim({_NOISE}) = '' THEN trim(company_name) ELSE trim({_NOISE}) END AS normalized_company_name,
    CASE WHEN {_OWN} = '' AND {_emirate(_WIDE)} IS NOT NULL THEN upper(substring({_EMIRATE_SPELLED}, 1, 1)) || substring({_EMIRATE_SPELLED}, 2) ELSE {_OWN} END AS city, {_case(_REASONS)} AS reason, {_EVERY_TECH} AS t FROM postings)"""
_NORMAL = _CATEGORY.replace("lower(' ' || title", "lower(' ' || normalized_title")
_REMOTELY = f"(remote_uae OR (NOT regexp_matches({_LOWER}, '\\bhybrid\\b') AND regexp_matches({_LOWER}, '\\b(?:remote|work from home|wfh)\\b')))"


@query("b51_ingest_defaults", f"WITH e AS ({ENRICHED}) SELECT seq, normalized_title AS title, coalesce({_NORMAL}, 'other') AS job_category, {_REMOTELY} AS remote_uae, TIMESTAMP '1998-09-02 00:00:00' AS posted_at, TIMESTAMP '1998-10-02 00:00:00' AS expires_at, true AS is_active FROM e WHERE accepted")
def defaults(v: Views):
    return scoring.ingest_defaults(v.enriched("seq", "title", "description", "normalized_title", "work_mode", "remote_uae", "reject_stage").where("reject_stage is null"), "1998-09-02 00:00:00").select("seq", "title", "job_category", "remote_uae", "posted_at", "expires_at", "is_active")


_LABEL = lambda c, names, other: f"CASE lower(coalesce({c}, '')) " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in names.items()) + f" ELSE {other} END"


@query("b52_directory_labels", f"SELECT id, {_LABEL('job_category', rules.DIRECTORY_CATEGORIES, 'NULL')} AS category, {_LABEL('emirate', rules.DIRECTORY_CITIES, chr(39) + 'UAE-wide' + chr(39))} AS city FROM jobs")
def labels(v: Views):
    return v.jobs.select("id", X.directory_category("job_category").alias("category"), X.directory_city("emirate").alias("city"))


# ---- predicates -------------------------------------------------------------------------------------

_U = lambda c: _re(c, rules.UAE_PLACE)
_O = lambda c: _re(c, rules.OTHER_COUNTRY)
_REASON = _case([("trim(title) = ''", "blank_title"), (_re("title", rules.STRONG_NEGATIVE), "other_profession"), (f"{_re('title', rules.TRADE)} AND NOT {_re('title', rules.TRADE_OVERRIDE)}", "trade"), (f"{_O('location_uae')} AND NOT {_U('location_uae')}", "foreign_location"), (f"lower(location_uae) = '{rules.GENERIC_REMOTE}' AND {_O('description')} AND NOT {_U('description')}", "foreign_remote"), (f"{_re('description', rules.EU_SCOPE)} AND NOT {_U('description')}", "eu_scope"), (f"NOT ({_U('location_uae')} OR {_U('description')})", "not_in_uae")])


@query("c01_hard_reject", f"SELECT seq, {_REASON} AS reason FROM postings")
def reject(v: Views):
    return v.postings.select("seq", scoring.reject_reason("title", "location_uae", F.lit(None).cast("string"), "description").alias("reason"))


@query("c02_publisher_allowed", f"SELECT seq FROM postings WHERE contains(lower(publisher), 'bayt') OR contains(coalesce({_HOST('apply_url')}, ''), 'acme1')")
def allowed(v: Views):
    return v.postings.where(scoring.publisher_allowed("publisher", "apply_url", ["Bayt", "acme1"])).select("seq")


@query("c03_mentions_uae", "SELECT seq FROM postings WHERE " + _has("lower(location_uae || ' ' || description || ' ' || title)", rules.UAE_MENTIONS))
def uae(v: Views):
    return v.postings.where(X.mentions_uae("location_uae", "description", "title")).select("seq")


@query("c04_score_filter", f"SELECT seq FROM (SELECT *, {_TECH.replace('coalesce(description,', 'coalesce(lower(title || ' + chr(39) + ' ' + chr(39) + ' || description || ' + chr(39) + ' ' + chr(39) + ' || coalesce(requirements, ' + chr(39) * 2 + ')),')} AS t FROM postings) WHERE {_POINTS} >= 40")
def scored(v: Views):
    # Only the score is worked out, once; see Views.enriched.
    return scoring.score_filter(stored(v.spark, scoring.enrich(v.postings).select("seq", "relevance_score"), "scores")).select("seq")


# ---- feeds and pages --------------------------------------------------------------------------------


def _payload(**fields):
    return F.to_json(F.struct(*[(c if not isinstance(c, str) else F.lit(c)).alias(k) for k, c in fields.items()]))


_SHOW = ["external_job_id", "source", "publisher", "title", "company_name", "location_uae", "emirate", "salary_min", "job_type", "experience_level", "apply_url", "remote_uae"]


@query("a02_postings_from_adzuna", f"SELECT CAST(seq AS STRING) AS external_job_id, 'adzuna' AS source, 'Adzuna' AS publisher, title, company_name, location_uae, {_emirate('location_uae')} AS emirate, salary_min, CASE WHEN seq % 2 = 0 THEN 'part_time' ELSE 'full_time' END AS job_type, {_level(False)} AS experience_level, apply_url, false AS remote_uae FROM postings WHERE apply_url <> ''")
def adzuna(v: Views):
    item = F.struct(F.col("seq").alias("id"), "title", F.col("apply_url").alias("redirect_url"), F.struct(F.col("company_name").alias("display_name")).alias("company"), F.struct(F.col("location_uae").alias("display_name")).alias("location"), "description", (F.col("salary_min") + 0.2).alias("salary_min"), F.when(F.col("seq") % 2 == 0, "part_time").otherwise("x").alias("contract_time"))
    return feeds.postings_from_adzuna(v.postings.select(_payload(results=F.array(item)).alias("payload"))).select(_SHOW)


@query("a03_postings_from_jsearch", f"SELECT CAST(seq AS STRING) AS external_job_id, 'jsearch' AS source, nullif(publisher, '') AS publisher, title, company_name, CASE WHEN trim(location_uae) = '' THEN '' ELSE location_uae END || ', AE' AS location_uae, {_emirate('location_uae')} AS emirate, salary_min, CASE WHEN seq % 2 = 0 THEN 'contract' ELSE 'full_time' END AS job_type, {_level(True)} AS experience_level, apply_url, remote_uae FROM postings WHERE apply_url <> ''")
def jsearch(v: Views):
    item = F.struct(F.col("seq").alias("job_id"), F.col("title").alias("job_title"), F.col("apply_url").alias("job_apply_link"), F.col("company_name").alias("employer_name"), F.col("description").alias("job_description"), F.col("publisher").alias("job_publisher"), F.col("location_uae").alias("job_city"), F.col("remote_uae").alias("job_is_remote"), F.col("salary_min").cast("double").alias("job_min_salary"), F.when(F.col("seq") % 2 == 0, "contractor").alias("job_employment_type"))
    flat, nested = _payload(status="OK", data=F.array(item)), _payload(status="OK", data=F.struct(F.array(item).alias("jobs")))
    return feeds.postings_from_jsearch(v.postings.select(F.when(F.col("seq") % 3 == 0, flat).otherwise(nested).alias("payload"))).select(_SHOW)


@query("a04_postings_from_careerjet", f"SELECT 'cj_' || CAST(seq AS STRING) AS external_job_id, 'careerjet' AS source, 'CareerJet' AS publisher, title, company_name, CASE location_uae WHEN 'Dubai, Dubai, United Arab Emirates' THEN 'Dubai, UAE' WHEN '' THEN 'United Arab Emirates' ELSE location_uae END AS location_uae, {_emirate('location_uae')} AS emirate, CAST(NULL AS INT) AS salary_min, 'full_time' AS job_type, {_level(True)} AS experience_level, 'https://www.careerjet.ae/jobad/' || CAST(seq AS STRING) AS apply_url, false AS remote_uae FROM postings")
def careerjet(v: Views):
    item = F.struct(F.concat(F.lit("https://www.careerjet.ae/jobad/"), "seq").alias("url"), "title", F.col("company_name").alias("company"), F.col("location_uae").alias("locations"), "description")
    return feeds.postings_from_careerjet(v.postings.select(_payload(jobs=F.array(item)).alias("payload"))).select(_SHOW)


_REMOTE = "'Remote (UAE-friendly)' AS location_uae, CAST(NULL AS STRING) AS emirate, CAST(floor(salary_min * 3.67::DOUBLE + 0.5) AS INT) AS salary_min, 'full_time' AS job_type"


@query("a05_postings_from_himalayas", f"SELECT CAST(seq AS STRING) AS external_job_id, 'himalayas' AS source, 'Himalayas' AS publisher, title, company_name, {_REMOTE}, {_level(True)} AS experience_level, 'https://himalayas.app/jobs/s' || CAST(seq AS STRING) AS apply_url, true AS remote_uae FROM postings")
def himalayas(v: Views):
    item = F.struct(F.col("seq").alias("guid"), "title", F.col("company_name").alias("companyName"), F.concat(F.lit("s"), "seq").alias("slug"), "description", F.col("salary_min").alias("minSalary"))
    return feeds.postings_from_himalayas(v.postings.select(F.when(F.col("seq") % 2 == 0, _payload(jobs=F.array(item))).otherwise(F.to_json(F.array(item))).alias("payload"))).select(_SHOW)


@query("a06_postings_from_remoteok", f"SELECT CAST(seq AS STRING) AS external_job_id, 'remoteok' AS source, 'RemoteOK' AS publisher, title, company_name, {_REMOTE}, {_level(False)} AS experience_level, 'https://remoteok.example/' || CAST(seq AS STRING) AS apply_url, true AS remote_uae FROM postings")
def remoteok(v: Views):
    item = F.struct(F.col("seq").cast("string").alias("id"), F.col("title").alias("position"), F.col("company_name").alias("company"), F.concat(F.lit("https://remoteok.example/"), "seq").alias("url"), "description", "salary_min")
    notice = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("position", "string"), ("company", "string"), ("url", "string"), ("description", "string"), ("salary_min", "int"))])
    return feeds.postings_from_remoteok(v.postings.select(F.to_json(F.array(notice, item)).alias("payload"))).select(_SHOW)


@query("a07_postings_from_external", f"SELECT 'push_' || CAST(seq AS STRING) AS external_job_id, 'push' AS source, publisher, title, company_name, location_uae, emirate, salary_min, 'full_time' AS job_type, {_level(True)} AS experience_level, apply_url, remote_uae FROM postings WHERE apply_url IS NOT NULL")
def external(v: Views):
    item = F.struct(F.col("seq").alias("externalId"), "title", F.col("company_name").alias("company"), "description", F.col("location_uae").alias("location"), "emirate", F.col("apply_url").alias("applyUrl"), F.col("salary_min").alias("salaryMin"), F.col("remote_uae").alias("remoteUae"), "publisher")
    return feeds.postings_from_external(v.postings.select(_payload(source="push", jobs=F.array(item)).alias("payload"))).select(_SHOW)


@query("a13_postings_from_ats", f"SELECT title, 'Acme' AS company_name, {_LOC} AS location_uae, 'https://jobs.lever.co/acme/' || CAST(seq AS STRING) AS apply_url, location_uae = '' OR {_LOC} IS NOT NULL AS complete FROM postings")
def ats(v: Views):
    item = _payload(text=F.col("title"), description=F.concat(F.lit("<p>x</p>"), "description"), company="Acme", hostedUrl=F.concat(F.lit("https://jobs.lever.co/acme/"), "seq"), categories=F.struct(F.col("location_uae").alias("location")))
    raw = v.postings.select(item.alias("payload"), F.col("apply_url").alias("url"), F.lit("acme").alias("board"))
    return feeds.postings_from_ats(raw, "lever").select("title", "company_name", "location_uae", "apply_url", "complete")


@query("a14_route_ats_url", "SELECT seq, CASE WHEN seq % 4 <> 3 THEN ['lever', 'ashby', 'greenhouse'][CAST(seq % 4 + 1 AS INT)] END AS ats, CASE WHEN seq % 4 <> 3 THEN 'acme' END AS board, CASE WHEN seq % 4 <> 3 THEN CAST(seq AS STRING) END AS job FROM postings")
def route(v: Views):
    k = F.col("seq") % 4
    url = X.first_match([(k == i, F.concat(F.lit(p), "seq")) for i, p in enumerate(("https://jobs.lever.co/acme/", "https://jobs.ashbyhq.com/acme/", "https://boards.greenhouse.io/acme/jobs/", "https://x.example/"))])
    return v.postings.select("seq", feeds.route_ats_url(url).alias("r")).select("seq", "r.ats", "r.board", "r.job")


# Pages of the table have a title, no meta data, and their text in an article, if they have one.
_HTML_TEXT = lambda c: f"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({c}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<[^>]+>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[\\s\\x{{A0}}]+', ' ', 'g'))"
_ARTICLE = _HTML_TEXT("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")
_RENDERED = f"CASE WHEN length({_ARTICLE}) >= 150 THEN {_ARTICLE} END"
_RAW_TITLE = _STRIP("""regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\\s{2,}', ' ', 'g')""")


def _without_site(title: str) -> str:
    left = [_STRIP(f"regexp_extract({title}, '(?s)^(.+){sep}', 1)") for sep in (" \\| ", " – ", " — ", " :: ")]
    return "CASE " + " ".join(f"WHEN {x} <> '' AND len(string_split_regex({x}, '\\s+')) <= 10 THEN {x}" for x in left) + f" ELSE {title} END"


_PAGE_TITLE = f"({_without_site(_RAW_TITLE)})"
_PAGE_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', ''), '^(?:careers?|jobs?|talent|recruitment)\\.', ''), '\\.[a-z]{2,6}$', '')"
_PAGE_COMPANY = f"array_to_string(list_transform(list_filter(string_split_regex({_PAGE_HOST}, '[._\\-\\s]+'), lambda w: w <> ''), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ')"
_PAGE_CITY = _case([(f"contains(replace(lower({_PAGE_TITLE}), '-', ' '), '{n}')", _NAMES[n]) for n in rules.CITY_ORDER])
_MISSING = "Description could not be extracted. Fill it in before importing."


@query("a08_postings_from_pages", f"SELECT page_id, url AS apply_url, nullif({_PAGE_TITLE}, '') AS title, {_PAGE_COMPANY} AS company_name, {_RENDERED} AS description, {_PAGE_CITY} AS location_uae, {_PAGE_TITLE} <> '' AND {_RENDERED} IS NOT NULL AS complete, CASE WHEN {_PAGE_TITLE} = '' THEN 'No title was found on the page. Fill it in before importing.' WHEN {_RENDERED} IS NULL THEN '{_MISSING}' END AS message FROM pages")
def page_postings(v: Views):
    return pages.postings_from_pages(v.pages)


@query("a09_page_jsonld", "SELECT seq, title, company_name, CASE WHEN location_uae <> '' THEN location_uae END AS location_uae FROM postings")
def page_jsonld(v: Views):
    node = F.struct(F.lit("JobPosting").alias("@type"), "title", "description", F.struct(F.col("company_name").alias("name")).alias("hiringOrganization"), F.array(F.struct(F.struct(F.col("location_uae").alias("addressLocality")).alias("address"))).alias("jobLocation"))
    body = F.when(F.col("seq") % 2 == 0, F.to_json(F.array(node))).otherwise(F.to_json(node))
    html_ = F.concat(F.lit("<html><script type='application/ld+json'>"), body, F.lit("</script></html>"))
    made = v.postings.select("seq", html_.alias("html"), F.lit("https://x.example/").alias("url"))
    return pages.with_jsonld(made).select("seq", "ld.title", "ld.company_name", "ld.location_uae")


_FLAT = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_CITY_OF = lambda c: _case([(f"contains(replace(lower({c}), '-', ' '), '{n}')", _NAMES[n]) for n in rules.CITY_ORDER])


@query("a10_page_microdata", f"SELECT seq, CASE WHEN length({_FLAT('description')}) >= 80 THEN title END AS title, CASE WHEN length({_FLAT('description')}) >= 80 THEN company_name END AS company_name, CASE WHEN length({_FLAT('description')}) >= 80 THEN {_FLAT('description')} END AS description, CASE WHEN length({_FLAT('description')}) >= 80 THEN CASE WHEN trim(location_uae) = '' THEN {_CITY_OF('title || chr(32) || description')} ELSE coalesce({_CITY_OF('location_uae')}, location_uae) END END AS location_uae FROM postings")
def page_microdata(v: Views):
    """Postings as pages with item properties, read again."""
    tag = lambda name, c: F.concat(F.lit(f'<div itemprop="{name}"><b>'), X.escape_html(c), F.lit("</b></div>"))
    page = F.concat(F.lit("<html><body><script>var x='<p>';</script>"), tag("title", "title"), tag("hiringOrganization", "company_name"), tag("addressLocality", "location_uae"), tag("description", "description"), F.lit("</body></html>"))
    made = v.postings.select(F.col("seq").alias("page_id"), page.alias("html"), F.lit("https://x.example/").alias("url"))
    return pages.with_microdata(pages.with_elements(made)).select(F.col("page_id").alias("seq"), "micro.title", "micro.company_name", "micro.description", "micro.location_uae")


@query("a11_page_opengraph", f"SELECT page_id, nullif({_PAGE_TITLE}, '') AS title, {_PAGE_COMPANY} AS company_name, CAST(NULL AS STRING) AS description, {_PAGE_CITY} AS location_uae, false AS complete, CASE WHEN {_PAGE_TITLE} = '' THEN 'No title was found on the page. Fill it in before importing.' ELSE '{_MISSING}' END AS message FROM pages")
def page_opengraph(v: Views):
    return pages.with_opengraph(v.pages).select("page_id", "og.*")


@query("a12_page_linkedin", f"SELECT seq, CAST(seq AS STRING) AS linkedin_id, title, company_name, coalesce({_CITY_OF('location_uae')}, {_CITY_OF('description')}) AS location_uae, {_FLAT('description')} AS description, 'Employment type: Contract' AS requirements, salary_min, coalesce(salary_max, salary_min) AS salary_max, 'contract' AS job_type FROM postings WHERE salary_min IS NOT NULL OR salary_max IS NULL")
def page_linkedin(v: Views):
    """Postings as public job pages, read again."""
    tag = lambda name, c: F.concat(F.lit(f'<span class="x {name}">'), X.escape_html(c), F.lit("</span>"))
    salary = F.coalesce(F.concat(F.lit("AED "), F.format_number("salary_min", 0), F.coalesce(F.concat(F.lit(" - "), F.format_number("salary_max", 0)), F.lit(""))), F.lit(""))
    criteria = F.lit('<h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">Contract</span>')
    page = F.concat(F.lit("<html><body>"), tag("topcard__title", "title"), tag("topcard__flavor", "company_name"), tag("topcard__flavor--bullet", "location_uae"), tag("description__text", "description"), criteria, tag("salary", salary), F.lit("</body></html>"))
    made = v.postings.where("salary_min is not null or salary_max is null").select(F.col("seq").alias("page_id"), F.concat(F.lit("https://ae.linkedin.com/jobs/view/"), "seq").alias("url"), page.alias("html"))
    return pages.linkedin_fields(made).select(F.col("page_id").alias("seq"), "linkedin_id", "title", "company_name", "location_uae", "description", "requirements", "salary_min", "salary_max", "job_type")


@query("a15_rendered_description", f"SELECT page_id, {_RENDERED} AS rendered FROM pages")
def page_rendered(v: Views):
    return pages.with_elements(v.pages).select("page_id", "rendered")


_META = f"CASE WHEN length({_PLAIN}) <= 155 THEN {_PLAIN} WHEN length(regexp_extract(substring({_PLAIN}, 1, 155), '(?s)^(.*) ', 1)) < 77 THEN rtrim(substring({_PLAIN}, 1, 154)) || '…' ELSE rtrim(regexp_extract(substring({_PLAIN}, 1, 155), '(?s)^(.*) ', 1)) || '…' END"
_HEAD = _ESCAPED("title || ' at ' || company_name")


@query("a19_job_page_html", f"SELECT id, '<!doctype html><html><head><title>' || {_HEAD} || '</title><meta name=\"description\" content=\"' || {_ESCAPED(_META)} || '\"></head><body><h1>' || {_HEAD} || '</h1><p>' || {_ESCAPED(_STRIP('description'))} || '</p></body></html>' AS html FROM jobs WHERE is_active")
def job_pages(v: Views):
    head = X.escape_html(F.concat("title", F.lit(" at "), "company_name"))
    page = F.concat(F.lit("<!doctype html><html><head><title>"), head, F.lit('</title><meta name="description" content="'), X.escape_html(X.meta_description("description", "title", "company_name", "location_uae")), F.lit('"></head><body><h1>'), head, F.lit("</h1>"), X.body_html("description"), F.lit("</body></html>"))
    return v.jobs.where("is_active").select("id", page.alias("html"))


@query("c18_complete_preview", f"SELECT page_id, CASE WHEN {_PAGE_TITLE} = '' THEN 'No title was found on the page. Fill it in before importing.' ELSE '{_MISSING}' END AS message FROM pages WHERE {_PAGE_TITLE} = '' OR {_RENDERED} IS NULL")
def complete(v: Views):
    return pages.postings_from_pages(v.pages).where("not complete").select("page_id", "message")


@query("h06_merge_adjacent", "SELECT p_partkey, 'A: ' || p_brand || ',' || p_type || '; B: ' || p_name AS merged FROM part WHERE p_brand <> p_type")
def adjacent(v: Views):
    s = lambda h, *i: F.struct(F.lit(h).alias("heading"), F.array(*i).alias("items"))
    merged = X.merge_adjacent(F.array(s("A", "p_brand"), s("a", "p_type", "p_brand", "p_type"), s("B", "p_name")))
    shown = F.array_join(F.transform(merged, lambda x: F.concat(x["heading"], F.lit(": "), F.array_join(x["items"], ","))), "; ")
    return v.part.where("p_brand <> p_type").select("p_partkey", shown.alias("merged"))


@query("d11_publisher_tokens", "SELECT seq FROM postings WHERE contains(lower(publisher), 'indeed') OR contains(lower(coalesce(apply_url, '')), 'acme2')")
def tokens(v: Views):
    from jobloom.operators.search import publisher_match

    return v.postings.withColumn("linkedin_url", F.lit(None).cast("string")).where(publisher_match(["indeed", "acme2"])).select("seq")


#: Further entries: one in capitals, with a class, optional and repeated parts, one without a plain beginning, and
#: brackets in sets before and behind an alternative.
MORE_TECHNOLOGIES = [("erlang", r"Erlang|\b[Ee]lixir\b", "Erlang"), ("color", r"colou?r", "Color"), ("sql", r"(?<![\w])SQL(?![\w])", "SQL"), ("numbers", r"[0-9]{3,}", "Numbers"), ("wide", r"(?:plat|uni)form(?:s|ed)?", "Wide"), ("plus", r"c\+\+|th\w+ing", "Plus"), ("call", r"jav[a(]x?[(]|kafka|und[^)]heit", "Call"), ("close", r"vis[)]|(?:re[)(]|an)d\b|[|]", "Close")]


@query("b24_custom_catalogue", "SELECT seq, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_re('description', p)} THEN '{k}' END" for k, p, _ in MORE_TECHNOLOGIES) + "], lambda x: x IS NOT NULL), ',') AS technologies FROM postings")
def custom_technologies(v: Views):
    return v.postings.select("seq", F.array_join(X.extract_technologies("description", MORE_TECHNOLOGIES), ",").alias("technologies"))


@query("j01_ingest_enabled_feeds", "SELECT CASE WHEN seq % 3 = 0 THEN 'adzuna' ELSE 'careerjet' END AS feed, title, company_name FROM postings WHERE (seq % 3 = 0 AND apply_url <> '') OR seq % 3 = 1")
def ingested(v: Views):
    """Payloads of three feeds, of which one is switched off."""
    k = F.col("seq") % 3
    adzuna_ = _payload(results=F.array(F.struct(F.col("seq").alias("id"), "title", F.col("apply_url").alias("redirect_url"), F.struct(F.col("company_name").alias("display_name")).alias("company"), "description")))
    careerjet_ = _payload(jobs=F.array(F.struct(F.concat(F.lit("https://www.careerjet.ae/jobad/"), "seq").alias("url"), "title", F.col("company_name").alias("company"), F.col("location_uae").alias("locations"), "description")))
    himalayas_ = _payload(jobs=F.array(F.struct(F.col("seq").alias("guid"), "title", F.col("company_name").alias("companyName"), F.lit("s").alias("slug"), "description")))
    raw = v.postings.select(F.when(k == 0, "adzuna").when(k == 1, "careerjet").otherwise("himalayas").alias("feed"), F.when(k == 0, adzuna_).when(k == 1, careerjet_).otherwise(himalayas_).alias("payload"))
    return feeds.ingest(raw, {"himalayas": False}).select("feed", "title", "company_name")


@query("j02_format_by_source", f"SELECT id, CASE WHEN source = 'adzuna' THEN '<p>' || {_ESCAPED('description')} || '</p>' ELSE '<ul><li>' || {_ESCAPED('title')} || '</li></ul>' END AS html FROM jobs")
def formatted_by_source(v: Views):
    """A formatter of its own for one source, the default one for the others."""
    chosen = {"Adzuna": lambda c: F.concat(F.lit("<p>"), X.escape_html(c), F.lit("</p>")), "default": lambda c: F.concat(F.lit("<ul><li>"), X.escape_html("title"), F.lit("</li></ul>"))}
    return v.jobs.select("id", html.format_description("source", "description", chosen).alias("html"))
