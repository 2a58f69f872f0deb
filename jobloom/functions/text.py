"""Column functions over postings and pages: cleaning, normalising, classifying. Each takes columns (or
names) and gives a column, so Catalyst plans them with the rest of the query."""

from __future__ import annotations

import re
import re._constants as _sre
import warnings
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions import rules

STRINGS = "array<string>"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def is_blank(c) -> Column:
    """Null or white space only."""
    return safe(c).rlike(r"\A\s*\z")


def strip(c) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(col(c), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def matches(c, pattern: str) -> Column:
    """Case-insensitive search; null counts as empty."""
    return safe(c).rlike("(?i)" + pattern)


def first_match(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """Value of the first condition that holds."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def contains_any(c: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in tokens])


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_non_blank(*columns) -> Column:
    return F.coalesce(*[F.when(~is_blank(c), col(c)) for c in columns])


# ---- markup -----------------------------------------------------------------------------------------


def strip_tags(c) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(c), "<[^>]+>", " "), r"\s+", " "))


def html_to_text(c) -> Column:
    """Breaks and ends of block elements are line ends; other tags go; no more than one empty line."""
    text = F.regexp_replace(col(c), r"(?i)<br\s*/?>|</(?:p|li|div|h[1-6])>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip_tags_entities(c) -> Column:
    text = F.regexp_replace(safe(c), "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return strip(F.regexp_replace(text, r"\s{2,}", " "))


def repair_mojibake(c) -> Column:
    """UTF-8 that was read as Latin-1 is read again, if all of it can be and it gets shorter."""
    text = col(c)
    again = F.encode(text, "ISO-8859-1").cast("string")
    repaired = F.when(F.is_valid_utf8(again) & (F.length(again) < F.length(text)), again).otherwise(text)
    # Nested: encoding fails on characters that Latin-1 lacks.
    return F.when(text.rlike(r"[^\x{00}-\x{FF}]"), text).otherwise(F.when(~text.rlike(r"[\x{80}-\x{FF}]"), text).otherwise(repaired))


DANGEROUS = "script|style|iframe|object|embed|form|svg|math|noscript|template"


def sanitise_html(c) -> Column:
    """Only h3, p, ul and li without attributes stay; code fences and dangerous blocks go whole."""
    text = F.regexp_replace(safe(c), r"(?i)```[a-z]*", "")
    text = F.regexp_replace(text, rf"(?is)<({DANGEROUS})\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)<(?!/?(?:h3|p|ul|li)\b)[^>]*>", "")
    for tag in ("h3", "p", "ul", "li"):
        text = F.regexp_replace(F.regexp_replace(text, rf"(?i)<{tag}\b[^>]*>", f"<{tag}>"), rf"(?i)</{tag}\s*>", f"</{tag}>")
        text = F.regexp_replace(text, rf"<{tag}>\s*</{tag}>", "")
    return strip(text)


# ---- places -----------------------------------------------------------------------------------------


def infer_emirate(*columns, hyphens: bool = False) -> Column:
    text = F.lower(F.concat_ws(" ", *[safe(c) for c in columns]))
    cases = []
    for name, code, _ in rules.EMIRATES:
        hit = text.contains(name)
        if hyphens and " al " in name:
            hit = hit | text.contains(name.replace(" al ", " al-"))
        cases.append((hit, code))
    return first_match(cases)


def infer_city(c) -> Column:
    """Display name of the first place named in free text, hyphens read as spaces."""
    text = F.translate(F.lower(safe(c)), "-", " ")
    names = {n: d for n, _, d in rules.EMIRATES}
    return first_match([(text.contains(n), names[n]) for n in rules.CITY_ORDER])


def city_from_location(c) -> Column:
    first = strip(F.get(F.split(col(c), r"[•|\-]| via ", 2), 0))
    return F.when(~is_blank(c), strip(F.regexp_replace(first, r"(?i),\s*(uae|united arab emirates)\s*$", "")))


def clean_location_feed(c) -> Column:
    """The country is UAE, a city that is named twice in front is named once."""
    text = F.regexp_replace(col(c), r"(?i),\s*United Arab Emirates\s*$", ", UAE")
    text = F.regexp_replace(text, r"(?i),\s*UAE\s*,\s*UAE\s*$", ", UAE")
    parts = F.split(text, r",\s*")
    first, second = strip(F.get(parts, 0)), strip(F.get(parts, 1))
    once = F.when(F.size(parts) > 2, F.concat_ws(", ", first, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), ", "))).otherwise(first)
    text = F.when(F.lower(first) == F.lower(second), once).otherwise(text)
    return F.when(col(c).isNull(), "United Arab Emirates").when(is_blank(text), "UAE").otherwise(text)


def clean_location_display(c) -> Column:
    text = F.regexp_replace(safe(c), r"(?i)\s*-\s*United Arab Emirates\s*\(UAE\)", "")
    return strip(F.regexp_replace(text, r"(?i),\s*AE\s*$", ""))


def normalize_location(city, area, country) -> Column:
    """struct(city, emirate, country)."""
    own, near = strip(safe(city)), strip(safe(area))
    text = F.lower(F.concat_ws(" ", own, near))
    emirate = first_match([(text.contains(n), code) for n, code, _ in rules.EMIRATES])
    spelled = F.translate(emirate, "_", " ")
    shown = F.when((own == "") & emirate.isNotNull(), F.concat(F.upper(F.substring(spelled, 1, 1)), F.substring(spelled, 2, 100))).otherwise(own)
    return F.struct(shown.alias("city"), emirate.alias("emirate"), F.when(is_blank(country), "AE").otherwise(F.upper(strip(country))).alias("country"))


def mentions_uae(location, description, title) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", safe(location), safe(description), safe(title))), rules.UAE_MENTIONS)


# ---- titles, companies ------------------------------------------------------------------------------


def infer_experience_level(title, staff_is_senior: bool) -> Column:
    text = F.lower(safe(title))
    senior = ["senior", "lead", "principal"] + ["staff"] * staff_is_senior
    return first_match([(contains_any(text, senior), "senior_5_plus"), (contains_any(text, ["junior", "graduate", "entry"]), "junior_1_2_yrs"), (text.contains("intern"), "fresher")], "mid_3_5_yrs")


def map_employment_type(c) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in (("FULLTIME", "full_time"), ("PARTTIME", "part_time"), ("CONTRACTOR", "contract"), ("INTERN", "internship")) for x in pair])
    return F.coalesce(kinds[F.upper(safe(c))], F.lit("full_time"))


def posted_at(c, form: str) -> Column:
    """form: instant, offset, datetime (UTC) or day; what can't be read is null."""
    text = col(c)
    if form == "instant":
        return F.when(text.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z\z"), F.try_to_timestamp(text))
    if form == "offset":
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    if form == "datetime":
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))


def usd_to_aed(c) -> Column:
    return F.floor(col(c) * 3.67 + 0.5).cast("int")


def round_half_up(c) -> Column:
    return F.floor(col(c) + 0.5).cast("int")


def _seniority_prefix(c) -> Column:
    word = F.lower(F.regexp_extract(col(c), "(?i)" + rules.SENIOR_WORDS, 1))
    return let(word, lambda w: first_match([(w == "", ""), (w.isin("sr", "sr."), "Senior"), (w.isin("jr", "jr."), "Junior")], F.initcap(w)))


def normalize_title(c) -> Column:
    """Canonical title behind its seniority, else the title without seniority and place."""
    bare = F.regexp_replace(col(c), "(?i)" + rules.SENIOR_WORDS + r"\s*", " ")
    bare = F.regexp_replace(bare, "(?i)" + rules.PLACE_TAIL, "")
    bare = strip(F.regexp_replace(bare, r"\s+", " "))

    def named(bare):
        canonical = first_match([(bare.rlike("(?i)" + p), t) for p, t in rules.TITLES])
        return let(F.struct(canonical.alias("canonical"), _seniority_prefix(c).alias("prefix")), lambda x: F.when(x["canonical"].isNull(), bare).when(x["prefix"] == "", x["canonical"]).otherwise(F.concat_ws(" ", x["prefix"], x["canonical"])))

    return F.when(~is_blank(c), let(bare, named))


def normalize_company(c) -> Column:
    whole = strip(c)
    bare = strip(F.regexp_replace(F.regexp_replace(whole, "(?i)" + rules.COMPANY_NOISE, ""), r"[,\s]+$", ""))
    return F.when(~is_blank(c), F.when(bare == "", whole).otherwise(bare))


def _title_and_text(title, description) -> Column:
    return F.lower(F.concat_ws(" ", safe(title), safe(description)))


def classify_seniority(title, description) -> Column:
    # A pattern is searched for only where a text that it needs occurs at all.
    may = lambda text, p: contains_any(text, needed_texts(p)) if needed_texts(p) else F.lit(True)
    return let(_title_and_text(title, description), lambda text: first_match([(may(text, p) & text.rlike(rf"\b(?:{p})\b"), name) for name, p in rules.SENIORITY], "mid"))


def classify_work_mode(title, description, remote) -> Column:
    said = lambda text: first_match([(text.contains("hybrid") & text.rlike(r"\bhybrid\b"), "hybrid"), (contains_any(text, ["remote", "work from home", "wfh"]) & text.rlike(r"\b(?:remote|work from home|wfh)\b"), "remote")], "onsite")
    return F.when(F.coalesce(col(remote), F.lit(False)), "remote").otherwise(let(_title_and_text(title, description), said))


def _parsed(pattern: str):
    """The pattern's tree; None where the two pattern languages could read it differently (quoting, octal escapes,
    sets in sets, Unicode case) or the parser at hand doesn't know it."""
    if re.search(r"\\[0Q]|\(\?[a-zA-Z]*[uUxd]", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # it warns of sets in sets
            return re._parser.parse(pattern, re.IGNORECASE)
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern; the pattern itself where it can't be told."""
    if _parsed(pattern) is None:
        return [pattern]
    out, depth, at = [], 0, 0
    # An escape, a set (its first sign may be a bracket), or a sign.
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.DOTALL):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == "|" and depth == 0:
            out.append(pattern[at : m.start()])
            at = m.end()
    return [*out, pattern[at:]]


def _flat(items):
    """The items of a sequence, with groups opened."""
    for op, arg in items:
        if op is _sre.SUBPATTERN:
            yield from _flat(arg[3])
        elif op is _sre.ATOMIC_GROUP:
            yield from _flat(arg)
        else:
            yield op, arg


def _needed(items) -> frozenset[str]:
    """Texts of which every match of a sequence holds one; empty if that can't be told."""
    found: list[frozenset[str]] = []
    run = ""

    def ends() -> None:
        nonlocal run
        found.append(frozenset([run]))
        run = ""

    for op, arg in _flat(items):
        if op is _sre.LITERAL and arg < 128:
            run += chr(arg).lower()
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT, _sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            own = list(_flat(body))
            if least and all(o is _sre.LITERAL and x < 128 for o, x in own):
                run += "".join(chr(x) for _, x in own).lower() * min(least, 20)
                if least == most and least <= 20:
                    continue
            elif least:
                found.append(_needed(own))
            ends()
        elif op is _sre.BRANCH:
            ends()
            each = [_needed(x) for x in arg[1]]
            if all(each):
                found.append(frozenset().union(*each))
        elif op not in (_sre.AT, _sre.ASSERT, _sre.ASSERT_NOT):  # these take no room
            ends()
    ends()
    return max((x for x in found if x and min(map(len, x)) > 1), key=lambda x: (min(map(len, x)), -len(x)), default=frozenset())


def needed_texts(pattern: str) -> list[str]:
    """Lower-case texts (A-Z) of which every match of the pattern, in any case, holds one; empty if none are known."""
    tree = _parsed(pattern)
    return sorted(_needed(tree)) if tree is not None else []


def occurs(c, lower: Column, alternatives) -> Column:
    """Whether one of the patterns is found in c (in any case of A-Z): each is searched for only where one of the texts
    that every match of it holds occurs in c in lower case."""

    def found(alt: str) -> Column:
        if alt == re.escape(alt) and alt.lower() == alt.upper():  # signs without case
            return safe(c).contains(alt)
        needed = needed_texts(alt)
        return contains_any(lower, needed) & matches(c, alt) if needed else matches(c, alt)

    return reduce(lambda a, b: a | b, map(found, alternatives))


def extract_technologies(c, catalogue=None) -> Column:
    """Keys whose pattern occurs (in any case of A-Z), in the catalogue's order."""
    entries = catalogue or rules.TECHNOLOGIES

    def keys(lower):
        return F.array(*[F.when(occurs(c, lower, alternatives(pattern)), F.lit(key)) for key, pattern, _ in entries])

    return F.array_compact(let(F.lower(safe(c)), keys))


def tech_flags(technologies) -> dict[str, Column]:
    return {flag: reduce(lambda a, b: a | b, [F.array_contains(col(technologies), k) for k in keys]) for flag, keys in rules.TECH_FLAGS.items()}


def tech_display_name(key: Column, catalogue=None) -> Column:
    names = F.create_map(*[F.lit(x) for k, _, n in (catalogue or rules.TECHNOLOGIES) for x in (k, n)])
    words = F.transform(F.split(key, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.coalesce(names[key], F.array_join(words, " "))


def skills_from_text(description, requirements) -> Column:
    found = extract_technologies(F.concat_ws(" ", safe(description), safe(requirements)))
    return F.when(F.size(found) == 0, F.array(F.lit("General IT"), F.lit("Problem Solving"))).otherwise(F.transform(found, lambda k: tech_display_name(k)))


def classify_category(title, text, table=None) -> Column:
    """Null without a title or a match."""
    padded = F.lower(F.concat(F.lit(" "), safe(title), F.lit(" "), safe(text), F.lit(" ")))
    return F.when(~is_blank(title), let(padded, lambda t: first_match([(contains_any(t, tokens), name) for name, tokens in table or rules.CATEGORIES])))


def valid_category_or_infer(requested, title, text) -> Column:
    known = [n for n, _ in rules.CATEGORIES] + ["other"]
    return F.when(col(requested).isin(known), col(requested)).otherwise(F.coalesce(classify_category(title, text), F.lit("other")))


def _cleaned(c) -> Column:
    return strip(F.regexp_replace(safe(c), r"[^\p{L}\p{N}]+", " "))


def dedup_hash(company, title, city) -> Column:
    return F.sha2(F.lower(F.concat_ws("|", _cleaned(company), _cleaned(title), _cleaned(city))), 256)


@F.pandas_udf(T.StringType())
def _without_marks(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda s: None if s is None else "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.category(ch).startswith("M")))


def dashed(text: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(is_blank(slug), "job").otherwise(slug)


def with_slug(df: DataFrame, c: str, name: str = "slug") -> DataFrame:
    """df with the slug of a column: letters without marks, runs of others as one dash; blank: job. Spark has no
    function that takes marks off, so texts beyond ASCII go through Python; a plan runs a Python function on every
    row that reaches it, so these rows are a branch of their own."""
    ascii_only = ~safe(c).rlike(r"[^\x00-\x7F]")
    plain = df.where(ascii_only).withColumn(name, dashed(safe(c)))
    return plain.unionByName(df.where(~ascii_only).withColumn(name, dashed(_without_marks(safe(c)))))


def directory_slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# ---- hosts ------------------------------------------------------------------------------------------


def host_of(url) -> Column:
    """Lower-case host without www., if it has a dot."""
    text = strip(url)
    full = F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", "")
    return F.when(host.contains("."), host)


def company_domain(apply_url, linkedin_url, name) -> Column:
    """The link's host unless it belongs to a board or recruiting platform, else a known employer's domain
    (the longest prefix of the name wins), else the name itself with .com."""
    host = F.coalesce(host_of(apply_url), host_of(linkedin_url))
    lower = strip(F.lower(col(name)))
    slug = F.regexp_replace(lower, "[^a-z0-9]", "")
    known = [(lower.startswith(p), rules.EMPLOYERS[p]) for p in sorted(rules.EMPLOYERS, key=lambda p: (-len(p), p))]
    guess = first_match(known, F.when((slug != "") & (F.length(slug) <= 30), F.concat(slug, F.lit(".com"))))
    return F.when(host.isNotNull() & ~host.isin(rules.NOT_EMPLOYERS), host).otherwise(F.when(~is_blank(name), guess))


def company_logo_url(domain, token: str | None = None) -> Column:
    """The site's icon; with a logo service's token, the company's logo there."""
    if token and token.strip():
        return F.concat(F.lit("https://img.logo.dev/"), col(domain), F.lit(f"?token={token}&size=200&format=png"))
    return F.concat(F.lit("https://www.google.com/s2/favicons?sz=128&domain="), col(domain))


ATS_HOSTS = ["lever.co", "greenhouse.io", "ashbyhq.com", "workday.com", "myworkdayjobs.com", "smartrecruiters.com", "taleo.net", "icims.com", "successfactors.com", "workable.com"]


def company_from_host(url) -> Column:
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^(?:careers?|jobs?|talent|recruitment)\.", "")
    name = F.regexp_replace(F.regexp_replace(host, r"\.[a-z]{2,6}$", ""), r"(?i)(careers?|jobs?|recruit|talent)$", "")
    words = F.filter(F.split(strip(F.regexp_replace(name, r"[._\-]", " ")), r"\s+"), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    return F.when(host.isNull() | reduce(lambda a, b: a | b, [host.endswith(h) for h in ATS_HOSTS]), "").otherwise(shown)


def strip_site_suffix(c) -> Column:
    text = safe(c)
    cases = []
    for sep in (r" \| ", " – ", " — ", " :: "):
        left = F.regexp_extract(text, rf"(?s)\A(.+){sep}", 1)
        cases.append(((left != "") & (F.size(F.split(strip(left), r"\s+")) <= 10), strip(left)))
    return F.when(is_blank(c), "").otherwise(first_match(cases, strip(text)))


def is_job_description(description, title) -> Column:
    lower = F.lower(safe(description))
    named = F.exists(F.split(F.lower(safe(title)), r"\s+"), lambda w: (F.length(w) >= 4) & lower.contains(w))
    return F.when(is_blank(description), False).when(is_blank(title), True).otherwise(named)


def linkedin_job_id(url) -> Column:
    plain = F.regexp_extract(safe(url), r"/jobs/view/(\d+)", 1)
    slugged = F.regexp_extract(safe(url), r"/jobs/view/[^/?#]*?-(\d+)(?:[/?#]|\z)", 1)
    return F.when(plain != "", plain).when(slugged != "", slugged)


def linkedin_job_type(text) -> Column:
    t = F.lower(safe(text))
    return first_match([(contains_any(t, ["part-time", "part time"]), "part_time"), (t.contains("contract"), "contract"), (t.contains("internship"), "internship")], "full_time")


def linkedin_level(text) -> Column:
    t = F.lower(safe(text))
    return first_match([(contains_any(t, ["entry level", "fresher", "internship", "associate", "junior"]), "junior"), (contains_any(t, ["director", "executive", "senior"]), "senior")], "mid")


def parse_salary_range(c) -> Column:
    """struct(low, high) of the first two numbers."""
    numbers = F.regexp_extract_all(F.translate(safe(c), ",", ""), F.lit(r"(\d+)"), 1)
    low, high = F.get(numbers, 0).try_cast("int"), F.get(numbers, 1).try_cast("int")
    return F.struct(low.alias("low"), F.coalesce(high, low).alias("high"))


def format_highlights(c) -> Column:
    """Blocks "Section: item. item." of a map of lists."""

    def block(entry):
        items = F.filter(F.transform(entry["value"], strip), lambda x: x != "")
        return F.concat(entry["key"], F.lit(":"), F.array_join(F.transform(items, lambda x: F.concat(F.lit(" "), x, F.lit("."))), ""))

    return F.array_join(F.transform(F.filter(F.map_entries(col(c)), lambda e: F.size(e["value"]) > 0), block), "\n\n")


# ---- descriptions -----------------------------------------------------------------------------------

SECTIONS = "array<struct<heading: string, items: array<string>>>"
_MARK, _END = "\u0001", "\u0002"


def parse_sections(c) -> Column:
    """Ordered sections: what stands before the first header is the Overview. Adjacent sections of one
    heading are merged, without repeated items."""
    text = strip(F.regexp_replace(F.regexp_replace(safe(c), r"\.([A-Z])", r". $1"), r"\s+", " "))
    # A header opens a chunk: mark, heading, end mark, body.
    marked = F.regexp_replace(text, rf"(?i)(?:^|(?<=[.!?\s]))\s*({rules.SECTION_HEADERS})\s*[:\-—–]", f"{_MARK}$1{_END}")
    chunks = F.split(F.concat(F.lit(f"Overview{_END}"), marked), _MARK)

    def section(chunk):
        heading = F.initcap(F.regexp_replace(strip(F.substring_index(chunk, _END, 1)), r"\s+", " "))
        body = strip(F.substring_index(chunk, _END, -1))
        ends = F.split(F.regexp_replace(body, r"(?<=\.) +(?=[A-Z(\[])", _MARK), _MARK)
        items = F.filter(F.transform(ends, lambda s: strip(F.regexp_replace(strip(s), r"\.\z", ""))), lambda s: s != "")
        items = F.when(F.size(items) > 0, items).otherwise(F.array(strip(F.regexp_replace(body, r"\.+$", ""))))
        return F.struct(heading.alias("heading"), items.alias("items"), body.alias("body"))

    full = F.filter(F.transform(chunks, section), lambda s: s["body"] != "")
    return F.when(is_blank(c), F.expr(f"cast(array() as {SECTIONS})")).otherwise(merge_adjacent(F.transform(full, lambda s: F.struct(s["heading"].alias("heading"), s["items"].alias("items")))))


def merge_adjacent(c) -> Column:
    def add(out, s):
        last = F.element_at(out, -1)
        same = (F.size(out) > 0) & (F.lower(last["heading"]) == F.lower(s["heading"]))
        merged = F.struct(last["heading"].alias("heading"), F.concat(last["items"], F.filter(F.array_distinct(s["items"]), lambda i: ~F.array_contains(last["items"], i))).alias("items"))
        return F.when(same, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(col(c), F.expr(f"cast(array() as {SECTIONS})"), add)


def format_sections(c) -> Column:
    def block(s):
        lines = F.transform(s["items"], lambda i: F.concat(F.lit("• "), i))
        return F.array_join(F.when(s["heading"] == "", lines).otherwise(F.concat(F.array(s["heading"]), lines)), "\n")

    return F.array_join(F.transform(col(c), block), "\n\n")


def sections_json(c) -> Column:
    return F.to_json(col(c))


# Words of headers, and bullet signs.
HEADER_WORDS = (
    r"(?i)\b(responsibilities|responsibility|requirements|qualifications|skills|tools|profile|benefits|perks|compensation|duties|tasks|competencies|what we offer|we offer|what you'll do|what you will do|"
    r"nice to have|must have|key responsibilities|your role|your day|your tasks|your profile|about the role|about the company|about us|about you|preferred|required|domain experience|how to apply|application process)\b"
)
_SIGNS = "•●▪◦■□▶▸►✓✔➢➤"
BULLET = rf"[{_SIGNS}]|(?:^|\s)[-*]\s+"


def has_bullet(text: Column, single_spaced: bool = False) -> Column:
    """Whether BULLET occurs; it is searched for only where one of its signs does."""
    return contains_any(text, [*_SIGNS, *(("- ", "* ") if single_spaced else ("-", "*"))]) & text.rlike(BULLET)


def is_cased(text: Column) -> Column:
    """Over half of the letters are capitals, or at least 60 % of two to eight words have one in front."""
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    bare = F.regexp_replace(text, r":\z", "")
    words = F.size(F.split(bare, r"\s+"))
    titled = F.regexp_count(bare, F.lit(r"\b[A-Z][a-z']+\b"))
    # Either takes two capitals or a text without small letters, which is cheap to see.
    likely = text.rlike(r"(?s)\p{Lu}.*\p{Lu}") | ~text.rlike("[a-z]")
    return likely & ((F.floor(upper * 100 / F.greatest(letters, F.lit(1))) > 50) | (words.between(2, 8) & (F.floor(titled * 100 / words) >= 60)))


def is_list(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit(""))) >= 2) | has_bullet(text)


def score_header(c) -> Column:
    """0 to 4: a line of 5 to 60 characters, in upper or title case, with a colon at its end, with a header
    word. What looks like a list scores 0."""
    text = strip(safe(c))
    points = [F.length(text).between(5, 60), is_cased(text), text.endswith(":"), text.rlike(HEADER_WORDS)]
    return F.when(is_list(text), 0).otherwise(sum((p.cast("int") for p in points), F.lit(0)))


def combine_description(description, requirements) -> Column:
    d, r = F.when(~is_blank(description), strip(description)), F.when(~is_blank(requirements), strip(requirements))
    return F.when(r.isNull(), F.coalesce(d, F.lit(""))).when(d.isNull(), r).otherwise(F.concat(d, F.lit("\n\nRequirements\n"), r))


def skills_to_array(c) -> Column:
    text = strip(safe(c))
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda s: s != "")
    return F.when(text.startswith("["), F.from_json(text, STRINGS)).otherwise(parts)


def display_name(name, email) -> Column:
    return F.coalesce(F.when(~is_blank(name), col(name)), F.substring_index(col(email), "@", 1))


# ---- pages for crawlers -----------------------------------------------------------------------------


def schema_org_employment_type(c) -> Column:
    kinds = {"full_time": "FULL_TIME", "part_time": "PART_TIME", "contract": "CONTRACTOR", "internship": "INTERN", "temporary": "TEMPORARY"}
    return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[col(c)]


def plain_text(c) -> Column:
    """One line without tags, bullets and a leading Overview."""
    text = strip(F.regexp_replace(F.translate(F.regexp_replace(safe(c), "<[^>]+>", " "), "•", " "), r"\s+", " "))
    return strip(F.regexp_replace(text, r"(?i)\Aoverview ", ""))


def meta_description(description, title, company, location, most: int = 155) -> Column:
    """At most `most` characters, cut at a space of the second half."""
    text = plain_text(description)
    place = clean_location_display(location)
    text = F.when(text == "", F.concat(safe(title), F.lit(" position at "), safe(company), F.lit(" in "), F.when(place == "", "UAE").otherwise(place))).otherwise(text)
    head = F.regexp_extract(F.substring(text, 1, most), r"(?s)\A(.*) ", 1)
    head = F.when(F.length(head) < most // 2, F.substring(text, 1, most - 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def escape_html(c) -> Column:
    out = col(c)
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(ch), F.lit(entity))
    return out


def body_html(c, cap: int = 8000) -> Column:
    """Lines that start with a bullet as list items, others as paragraphs; it ends before cap is passed."""

    def item(line):
        text = strip(line)
        bullet = text.rlike("^(•|- |[*] )")
        return F.struct(bullet.alias("bullet"), F.when(bullet, strip(F.substring(text, 2, 1 << 30))).otherwise(text).alias("text"))

    kept = F.filter(F.transform(F.split(F.translate(safe(c), "\r", ""), "\n"), item), lambda i: (i["text"] != "") & (i["bullet"] | (F.lower(i["text"]) != "overview")))

    def add(state, i):
        full = state["full"] | (state["used"] + F.length(i["text"]) > cap)
        tag = F.when(i["bullet"], "li").otherwise("p")
        change = F.when(i["bullet"] & ~state["list"], "<ul>").when(~i["bullet"] & state["list"], "</ul>").otherwise("")
        more = F.concat(state["html"], change, F.lit("<"), tag, F.lit(">"), escape_html(i["text"]), F.lit("</"), tag, F.lit(">"))
        return F.struct(
            F.when(full, state["html"]).otherwise(more).alias("html"), F.when(full, state["used"]).otherwise(state["used"] + F.length(i["text"])).alias("used"),
            F.when(full, state["list"]).otherwise(i["bullet"]).alias("list"), full.alias("full"),
        )

    start = F.struct(F.lit("").alias("html"), F.lit(0).alias("used"), F.lit(False).alias("list"), F.lit(False).alias("full"))
    return F.aggregate(kept, start, add, lambda s: F.concat(s["html"], F.when(s["list"], "</ul>").otherwise("")))


def job_posting_jsonld(title, description, company, location, job_type, posted, expires, apply_url, salary_min, salary_max, currency) -> Column:
    """schema.org JSON of a posting, safe inside a script element; absent fields are left out."""
    value = F.when(col(salary_min).isNotNull() | col(salary_max).isNotNull(), F.struct(F.lit("MonetaryAmount").alias("@type"), col(currency).alias("currency"), F.struct(F.lit("QuantitativeValue").alias("@type"), col(salary_min).alias("minValue"), col(salary_max).alias("maxValue"), F.lit("MONTH").alias("unitText")).alias("value")))
    iso = lambda c: F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.to_json(
        F.struct(
            F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), col(title).alias("title"), plain_text(description).alias("description"),
            F.struct(F.lit("Organization").alias("@type"), col(company).alias("name")).alias("hiringOrganization"),
            F.struct(F.lit("Place").alias("@type"), F.struct(F.lit("PostalAddress").alias("@type"), clean_location_display(location).alias("addressLocality"), F.lit("AE").alias("addressCountry")).alias("address")).alias("jobLocation"),
            schema_org_employment_type(job_type).alias("employmentType"), iso(posted).alias("datePosted"), iso(expires).alias("validThrough"), is_blank(apply_url).alias("directApply"), value.alias("baseSalary"),
        )
    )
    for ch, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(ch), F.lit(code))
    return text


# ---- directory --------------------------------------------------------------------------------------


def _label(c, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.lower(safe(c))]


def directory_category(c) -> Column:
    return _label(c, rules.DIRECTORY_CATEGORIES)


def directory_city(c) -> Column:
    return F.coalesce(_label(c, rules.DIRECTORY_CITIES), F.lit("UAE-wide"))


# ---- requests ---------------------------------------------------------------------------------------


def classify_endpoint(uri) -> Column:
    return first_match([(col(uri).isin("/api/v1/auth/login", "/api/v1/auth/register"), "login"), (col(uri) == "/api/v1/auth/refresh", "refresh")], "public")


def client_ip(forwarded, address) -> Column:
    """The last hop of X-Forwarded-For, else the peer."""
    hops = F.filter(F.transform(F.split(safe(forwarded), ","), strip), lambda h: h != "")
    return F.coalesce(F.try_element_at(hops, F.lit(-1)), col(address))
