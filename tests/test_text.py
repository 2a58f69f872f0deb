"""Row functions on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from jobloom.functions import html, rules
from jobloom.functions import text as X


@pytest.fixture
def value(spark):
    def run(column, **given):
        kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
        schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in given.items()) or "x int"
        return spark.createDataFrame([tuple(given.values()) or (1,)], schema).select(column.alias("v")).collect()[0]["v"]

    return run


@pytest.mark.parametrize(("text", "want"), [("Caf\xc3\xa9 Zw\xc3\xb6lf", "Café Zwölf"), ("Zwölf Möwen", "Zwölf Möwen"), (None, None), ("a", "a"), ("漢字", "漢字"), ("\xc3\xa9 漢", "\xc3\xa9 漢")])
def test_repair_mojibake(value, text, want):
    assert value(X.repair_mojibake("t"), t=text) == want


@pytest.mark.parametrize(
    ("title", "text", "want"),
    [("Backend Engineer", "We build.\nSenior engineer wanted", "senior"), ("Interior Designer", "architectural drawings", "mid"), ("Solutions Architect", None, "architect"), ("Head of Data", "", "manager"), ("Internship", None, "intern"), (None, None, "mid")],
)
def test_seniority(value, title, text, want):
    assert value(X.classify_seniority("a", "b"), a=title, b=text) == want


def test_work_mode(value):
    assert value(X.classify_work_mode("a", "b", "c"), a="x", b="line\nfully remote position", c=False) == "remote"
    assert value(X.classify_work_mode("a", "b", "c"), a="x", b="hybrid", c=True) == "remote"
    assert value(X.classify_work_mode("a", "b", "c"), a="x", b=None, c=False) == "onsite"


@pytest.mark.parametrize(("raw", "want"), [("Sr. Widget Maker", ". Widget Maker"), ("Senior Java Developer in Dubai, UAE", "Java Developer"), ("sr back-end developer", "Senior Backend Engineer"), ("SDET", "QA Automation Engineer"), (" ", None), (None, None)])
def test_normalize_title(value, raw, want):
    assert value(X.normalize_title("t"), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Acme Holdings L.L.C", "Acme"), ("Gulf Group Inc.", "Gulf Group Inc."), ("Noon", "Noon"), ("", None)])
def test_normalize_company(value, raw, want):
    assert value(X.normalize_company("t"), t=raw) == want


def test_locations(value):
    assert value(X.clean_location_feed("t"), t="Dubai, Dubai, United Arab Emirates") == "Dubai, UAE"
    assert value(X.city_from_location("t"), t="Dubai • via Indeed") == "Dubai"
    assert value(X.infer_city("t"), t="near Ras al-Khaimah") == "Ras Al Khaimah"
    assert value(X.normalize_location("a", "b", "c"), a="", b="abu dhabi", c=None).asDict() == {"city": "Abu dhabi", "emirate": "abu_dhabi", "country": "AE"}


def test_levels(value):
    assert value(X.infer_experience_level("t", True), t="Staff Engineer") == "senior_5_plus"
    assert value(X.infer_experience_level("t", False), t="Staff Engineer") == "mid_3_5_yrs"
    assert value(X.infer_experience_level("t", True), t="Internal Auditor") == "fresher"


def test_technologies(value):
    assert value(X.extract_technologies("t"), t="Java, JavaScript; React Native on AWS. C# and .NET") == ["java", "javascript", "csharp", "react native", "react", "aws"]
    assert value(X.skills_from_text("t", "u"), t="nothing", u=None) == ["General IT", "Problem Solving"]


def test_technologies_of_any_catalogue(spark):
    """What is found equals plain searches, whatever the patterns are made of."""
    import random

    r = random.Random(1)
    custom = [("a", "Erlang", ""), ("b", "colou?r", ""), ("c", "x{2,3}y", ""), ("d", r"[Pp]l/?sql|Oracle\b", ""), ("e", r"(?<![\w])Go(?![\w])", ""), ("f", r"c\+\+", ""), ("g", "(?:ab|a)c", ""), ("h", r"\bjs\b|ab*", ""), ("i", r"r|(?<![\w])k8s(?![\w])", ""), ("j", "(one|two)+|q", ""), ("k", r"a\|b", "")]
    words = ["Erlang", "erlang", "color", "colour", "xxy", "xy", "plsql", "PL/SQL", "oracle", "oracles", "go", "GO", "cargo", "c++", "ac", "abc", "js", "jsx", "a", "k8s", "onetwo", "q", "a|b", "spring", "boot", "springmvc", "reactjs", "react", "native", "node.js", "nodejs", "next.js", "nextjs", "oauth2", "golang", ".net", "c#", "javascript", "java", "é", "K", "postgresql", "amazon web services"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "", "-", "_", ".", "\n"]) for _ in range(r.randint(0, 7))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, t string")
    for catalogue in (custom, rules.TECHNOLOGIES):
        plain = df.select("row", *[F.col("t").rlike("(?i)" + p).alias(k) for k, p, _ in catalogue]).collect()
        want = {x["row"]: [k for k, _, _ in catalogue if x[k]] for x in plain}
        assert {x["row"]: x["found"] for x in df.select("row", X.extract_technologies("t", catalogue).alias("found")).collect()} == want


def _random_pattern(r, depth=0):
    """Letters, brackets in sets, escapes, optional and repeated parts, groups and alternatives."""
    atom = lambda: r.choice(["a", "b", "ab", "Go", "k", "é", r"\.", r"\(", "[(]", "[)b]", "[^)]", "[a|]", r"[\]|]", r"\b", r"\w", ".", "(?=a)", "(?:k)"]) if depth > 2 or r.random() < 0.7 else "(?:" + _random_pattern(r, depth + 1) + ")"
    part = lambda: "".join((x := atom()) + (r.choice(["", "", "", "?", "+", "*", "{2}", "{1,2}"]) if not x.startswith(("(?=", r"\b")) else "") for _ in range(r.randint(1, 4)))
    return "|".join(part() for _ in range(r.choice([1, 1, 2, 3])))


def test_any_pattern_is_found_as_by_a_search(spark):
    """Random patterns, and some that lost matches: equal to a plain search."""
    import random

    r = random.Random(3)
    some = ["java[(]|kotlin", "foo[)]x|bazooka", r"\Qa|b\E|zz", "[a[b|]]c|dd", r"(?iu)k8s|é", r"\0101b", "a{2,}b|(?:ab){2}"]
    texts = ["".join(r.choice(["a", "b", "ab", "go", "GO", "k", "K", "K", "é", ".", "(", ")", "|", "]", " ", "kotlin", "bazooka", "dd"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["We like kotlin and bazooka", *texts])], "row long, t string").coalesce(1)
    for patterns in (some, [_random_pattern(r) for _ in range(40)], [_random_pattern(r) for _ in range(40)]):
        catalogue = [(str(i), p, "") for i, p in enumerate(patterns)]
        plain = {x["row"]: [k for k, _, _ in catalogue if x[k]] for x in df.select("row", *[F.col("t").rlike("(?i)" + p).alias(k) for k, p, _ in catalogue]).collect()}
        assert {x["row"]: x["found"] for x in df.select("row", X.extract_technologies("t", catalogue).alias("found")).collect()} == plain


def test_needed_texts():
    assert X.needed_texts("java[(]|kotlin") == ["java(", "kotlin"] and X.alternatives("java[(]|kotlin") == ["java[(]", "kotlin"]
    assert X.needed_texts("x(?:ab|cd)+y") == ["ab", "cd"] and X.needed_texts("colou?r") == ["colo"] and X.needed_texts("[ab]c|d") == []


def test_slugs(spark):
    rows = [(1, "Ingénieur Sénior — Données!"), (2, "  "), (3, None), (4, "Plain Title, 2"), (5, "漢字"), (6, "-a-")]
    df = spark.createDataFrame(rows, "i long, t string")
    assert {r["i"]: r["slug"] for r in X.with_slug(df, "t").collect()} == {1: "ingenieur-senior-donnees", 2: "job", 3: "job", 4: "plain-title-2", 5: "job", 6: "a"}


@pytest.mark.parametrize(("apply", "name", "want"), [("https://www.etisalat.ae/careers", "x", "etisalat.ae"), ("https://linkedin.com/jobs/1", "Emirates NBD PJSC", "emiratesnbd.com"), ("https://ae.linkedin.com/j", "x", "ae.linkedin.com"), (None, "Blue Dune!", "bluedune.com"), (None, None, None)])
def test_domains(value, apply, name, want):
    assert value(X.company_domain("a", F.lit(None).cast("string"), "b"), a=apply, b=name) == want


def test_sections(value):
    raw = "We are Acme.Requirements: Java skills. Five years. Benefits: Visa. benefits: Housing. Visa."
    got = [(s["heading"], s["items"]) for s in value(X.parse_sections("t"), t=raw)]
    assert got == [("Overview", ["We are Acme"]), ("Requirements", ["Java skills", "Five years"]), ("Benefits", ["Visa", "Housing"])]
    assert value(X.parse_sections("t"), t=None) == []


@pytest.mark.parametrize(("chunk", "low", "high"), [("Key Responsibilities:", 3, 4), ("REQUIREMENTS", 2, 4), ("we are a small team that likes to build things together every day", 0, 1), ("Java; Spring; Kafka", 0, 0)])
def test_header_scores(value, chunk, low, high):
    assert low <= value(X.score_header("t"), t=chunk) <= high


PROSE = " ".join(f"Sentence number {i} tells of our platform, its people and what they do all day long." for i in range(1, 6))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, ""),
        (" \n ", ""),
        ("short", "<p>short.</p>"),
        ("is it? a <b> & 'c'", "<p>is it? a &lt;b&gt; &amp; &#39;c&#39;.</p>"),
        ("We sail boats.Crew wanted", "<p>We sail boats. Crew wanted.</p>"),
        ("Key Responsibilities: • Mend sails • Cook. Requirements: • Knots • Patience", "<h3>Key Responsibilities</h3><ul><li>Mend sails</li><li>Cook</li></ul><h3>Requirements</h3><ul><li>Knots</li><li>Patience</li></ul>"),
        ("mend one; paint two; cook three; wash four.", "<ul><li>mend one</li><li>paint two</li><li>cook three</li><li>wash four</li></ul>"),
        ("mend one; paint two", "<p>mend one; paint two.</p>"),
        ("REQUIREMENTS - Knots - Ropes - Sails", "<h3>REQUIREMENTS</h3><ul><li>Knots</li><li>Ropes</li><li>Sails</li></ul>"),
        ("We offer: berths and meals. Benefits: a view", "<h3>We offer</h3><p>berths and meals.</p><h3>Benefits</h3><p>a view.</p>"),
        (PROSE, "<p>" + " ".join(PROSE.split(". ")[k] + "." for k in range(3)) + "</p><p>" + PROSE.split(". ")[3] + ". " + PROSE.split(". ")[4] + "</p>"),
    ],
)
def test_description_html(value, given, want):
    assert value(html.description_html("t"), t=given) == want


def test_headers_are_those_that_score(spark):
    rows = [("Key Responsibilities:",), ("REQUIREMENTS",), ("we mend boats on the coast and sail them home every single evening",), ("Ropes; Knots; Sails",), ("Our Profile",), ("skills and tools",), ("A Long Title In Capitals That Goes On And On About Requirements Of All Kinds Here",), ("THE REQUIREMENTS OF A LONG LINE IN CAPITALS THAT GOES ON FOR OVER SIXTY",), ("- a",), ("É:",), ("ÉÉÉÉÉ",), ("abc:",), ("four:",)]
    df = spark.createDataFrame(rows, "t string").select("t", (X.score_header("t") >= 2).alias("a"), html.is_header(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in df) and {r["a"] for r in df} == {True, False}


def test_formatters_by_source(value):
    made = {"Acme": lambda c: F.concat(F.lit("A"), c), " ": lambda c: c}
    assert value(html.format_description("s", "t", made), s="ACME", t="x") == "Ax"
    assert value(html.format_description("s", "t", made), s="other", t="x") == "<p>x.</p>"
    assert value(html.format_description("s", "t", made | {"default": lambda c: F.upper(c)}), s=None, t="x") == "X"
    assert value(html.format_description("s", "t"), s="acme", t="x") == "<p>x.</p>"


def test_logo(value):
    assert value(X.company_logo_url("d"), d="a.ae").endswith("domain=a.ae")
    assert value(X.company_logo_url("d", "pk_1"), d="a.ae") == "https://img.logo.dev/a.ae?token=pk_1&size=200&format=png"


def test_sanitise(value):
    assert value(X.sanitise_html("t"), t="```html\n<H3 class='x'>A</H3><script>evil()</script><div><p>b</p></div><p> </p>```") == "<h3>A</h3><p>b</p>"


def test_body_and_meta(value):
    assert value(X.body_html("t"), t="Overview\n• Build services\n• Run them\nWe value teamwork.") == "<ul><li>Build services</li><li>Run them</li></ul><p>We value teamwork.</p>"
    assert value(X.meta_description("d", "t", "c", "l"), d=None, t="Senior Java Engineer", c="Careem", l="Dubai") == "Senior Java Engineer position at Careem in Dubai"
    long = value(X.meta_description("d", "t", "c", "l"), d="word " * 80, t="x", c="y", l="z")
    assert len(long) <= 155 and long.endswith("word…")
    assert value(X.body_html("t", 10), t="12345678\nabcdefgh") == "<p>12345678</p>"


def test_jsonld(value):
    column = X.job_posting_jsonld("t", "d", "c", "l", "j", "p", "p", "a", "s", "s", F.lit("AED"))
    given = dict(t="A <b>", d="x & y", c="Acme", l="Dubai", j="part_time", p=None, s=5)
    got = value(column, **given, a=None)
    assert "<" not in got and json.loads(got)["directApply"] is True and json.loads(got)["employmentType"] == "PART_TIME"
    assert json.loads(value(column, **given, a="https://x"))["directApply"] is False


def test_client_ip(value):
    assert value(X.client_ip("f", F.lit("peer")), f="203.0.113.7, 10.0.3.50") == "10.0.3.50"
    assert value(X.client_ip("f", F.lit("peer")), f=None) == "peer"


def test_posted_at(value):
    assert str(value(X.posted_at("t", "instant"), t="2024-01-25T00:00:00Z")) == "2024-01-25 00:00:00"
    assert str(value(X.posted_at("t", "offset"), t="2024-01-25T04:00:00+04:00")) == "2024-01-25 00:00:00"
    assert value(X.posted_at("t", "datetime"), t="soon") is None
    assert str(value(X.posted_at("t", "day"), t="2024-01-25T10:00")) == "2024-01-25 00:00:00"
