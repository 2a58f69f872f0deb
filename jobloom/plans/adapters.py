"""Views in the shape of a job board, built from the star-schema tables. Each is one SQL text that Spark and
the oracle both run, so that queries over them can be compared; names in braces are other views or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The clocks of the two groups of tables.
NOW, EVENTS_NOW = "1998-09-02 00:00:00", "2024-01-25 12:00:00"
AS_OF, EVENTS_AS_OF = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{EVENTS_NOW}'"

_TITLES = ["Senior Java Developer", "Sr. Widget Maker", "Backend Engineer in Dubai", "QA Automation Lead", "Mobile Crane Operator", "Data Engineer", "Staff Machine Learning Engineer", "Junior Front-end Developer", "Internal Auditor", "Cloud Architect", "DevOps Engineer", "HVAC Engineer", "Product Designer", "IT Support Specialist", "Principal Data Scientist", "Android Developer", "Full Stack Developer", "Receptionist", "Engineering Manager", "Cyber Security Engineer", "Marketing Writer"]
_COMPANIES = ["Acme Holdings L.L.C", "Gulf Group Inc.", "Careem", "Emirates NBD", "Emirates Group", "Noon", "Unknown", "Talabat FZ-LLC", "G42", "Nimbus Tech LLC", "Confidential", "Falcon Software, Inc.", "Blue Dune International"]
_PLACES = ["Dubai", "Abu Dhabi, UAE", "Dubai, Dubai, United Arab Emirates", "Sharjah", "Remote (UAE-friendly)", "Mumbai, India", "Ras Al Khaimah", "", "United Arab Emirates", "Umm Al Quwain, AE", "Ajman - United Arab Emirates (UAE)"]
_EXTRAS = ["We use Java, Spring Boot and Kafka on AWS in Dubai.", "Fully remote position. Python, Django, PostgreSQL. UAE residents only.", "Hybrid work with React and Node.js.", "Requirements: Docker, Kubernetes. Benefits: visa and housing in Abu Dhabi.", "Selenium, Playwright and cucumber.", "Location: EMEA, salary 90k / year eur", "The employer is in India.", "Senior engineer wanted for data platform and cloud security in the UAE."]
_PUBLISHERS = ["LinkedIn", "Indeed", "bayt.com", "GulfTalent", "RemoteOK", "", "Naukrigulf", "Some Board", "LinkedIn Jobs", "Glassdoor"]


def _values(name: str, texts: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(texts))
    return f"(VALUES {rows}) AS {name}(k, v)"


VIEWS: dict[str, str] = {
    "postings": f"""
        SELECT d.doc_id AS seq, CAST(d.doc_id % 700 AS STRING) AS external_job_id, d.source AS source, p.v AS publisher, t.v AS title, c.v AS company_name,
               CONCAT(coalesce(d.text, ''), ' ', x.v) AS description, CASE WHEN d.doc_id % 4 = 0 THEN 'Requirements are Python and SQL' END AS requirements,
               l.v AS location_uae, CASE WHEN d.doc_id % 3 = 0 THEN 'dubai' END AS emirate,
               CASE WHEN d.doc_id % 5 = 0 THEN CAST(8000 + d.doc_id % 17 * 500 AS INT) END AS salary_min, CASE WHEN d.doc_id % 10 = 0 THEN CAST(12000 + d.doc_id % 23 * 700 AS INT) END AS salary_max,
               CASE WHEN d.doc_id % 7 = 0 THEN CONCAT('https://careers.acme', CAST(d.doc_id % 9 AS STRING), '.com/jobs/', CAST(d.doc_id % 90 AS STRING)) WHEN d.doc_id % 7 = 1 THEN 'https://www.linkedin.com/jobs/view/123' WHEN d.doc_id % 7 = 2 THEN '' ELSE CONCAT('https://boards.greenhouse.io/acme/jobs/', CAST(d.doc_id AS STRING)) END AS apply_url,
               d.doc_id % 6 = 0 AS remote_uae, CASE WHEN d.doc_id % 8 = 0 THEN d.doc_id % 16 = 0 END AS linkedin_easy_apply
        FROM documents d JOIN {_values("t", _TITLES)} ON d.doc_id % {len(_TITLES)} = t.k JOIN {_values("c", _COMPANIES)} ON d.doc_id % {len(_COMPANIES)} = c.k JOIN {_values("l", _PLACES)} ON d.doc_id % {len(_PLACES)} = l.k
             JOIN {_values("x", _EXTRAS)} ON d.doc_id % {len(_EXTRAS)} = x.k JOIN {_values("p", _PUBLISHERS)} ON d.doc_id % {len(_PUBLISHERS)} = p.k""",
    "jobs": f"""
        SELECT o.o_orderkey AS id, t.v AS title, c.v AS company_name, CONCAT(t.v, ' wanted. ', x.v, CASE WHEN o.o_orderkey % 3 = 0 THEN repeat(' We build reliable systems together.', 10) ELSE '' END) AS description,
               CASE WHEN o.o_orderkey % 4 = 0 THEN 'Python and SQL' END AS requirements,
               CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(floor(o.o_totalprice / 100) AS INT) END AS salary_min, CASE WHEN o.o_orderkey % 3 <> 0 THEN CAST(floor(o.o_totalprice / 80) AS INT) END AS salary_max,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'part_time' WHEN 1 THEN 'contract' WHEN 2 THEN 'internship' ELSE 'full_time' END AS job_type,
               CASE o.o_orderkey % 3 WHEN 0 THEN 'senior_5_plus' WHEN 1 THEN 'mid_3_5_yrs' ELSE 'junior_1_2_yrs' END AS experience_level, l.v AS location_uae,
               CASE o.o_custkey % 9 WHEN 0 THEN 'dubai' WHEN 1 THEN 'abu_dhabi' WHEN 2 THEN 'sharjah' WHEN 3 THEN 'ajman' WHEN 4 THEN 'dubai' WHEN 5 THEN 'fujairah' END AS emirate,
               CASE o.o_orderkey % 11 WHEN 0 THEN 'backend' WHEN 1 THEN 'frontend' WHEN 2 THEN 'data_ml' WHEN 3 THEN 'devops' WHEN 4 THEN 'qa' WHEN 5 THEN 'security' WHEN 6 THEN 'other' WHEN 7 THEN 'mobile' END AS job_category,
               CASE WHEN o.o_orderkey % 3 = 0 THEN 'java,spring boot,sql' WHEN o.o_orderkey % 3 = 1 THEN 'python,aws' ELSE 'react,javascript' END AS skills_text,
               CASE o.o_orderkey % 3 WHEN 0 THEN 'employment' WHEN 1 THEN 'visit' END AS visa_type, o.o_orderkey % 5 = 0 AS immediate_joiner, o.o_orderkey % 7 = 0 AS remote_uae,
               CASE WHEN o.o_orderkey % 8 = 0 THEN NULL WHEN o.o_orderkey % 8 = 1 THEN '' WHEN o.o_orderkey % 8 = 2 THEN 'https://www.linkedin.com/jobs/view/77' ELSE CONCAT('https://careers.firm', CAST(o.o_custkey % 13 AS STRING), '.com/apply/', CAST(o.o_orderkey % 500 AS STRING)) END AS apply_url,
               CASE WHEN o.o_orderkey % 6 = 0 THEN CONCAT('https://ae.linkedin.com/jobs/view/', CAST(o.o_orderkey AS STRING)) END AS linkedin_url, p.v AS publisher, CASE WHEN o.o_orderkey % 4 = 0 THEN CONCAT('firm', CAST(o.o_custkey % 13 AS STRING), '.com') END AS company_domain,
               CASE WHEN o.o_orderkey % 9 = 0 THEN o.o_orderkey % 18 = 0 END AS linkedin_easy_apply, o.o_orderstatus <> 'P' AS is_active, CASE o.o_orderkey % 4 WHEN 0 THEN 'jsearch' WHEN 1 THEN 'adzuna' WHEN 2 THEN 'demo' ELSE 'careerjet' END AS source,
               o.o_orderdate AS created_at, CASE WHEN o.o_orderkey % 4 <> 0 THEN o.o_orderdate - INTERVAL 1 DAY END AS posted_at, o.o_orderdate + INTERVAL 30 DAY AS expires_at, o.o_orderdate + INTERVAL 3 DAY AS updated_at, o.o_custkey AS posted_by_id
        FROM orders o JOIN {_values("t", _TITLES)} ON o.o_orderkey % {len(_TITLES)} = t.k JOIN {_values("c", _COMPANIES)} ON o.o_custkey % {len(_COMPANIES)} = c.k JOIN {_values("l", _PLACES)} ON o.o_custkey % {len(_PLACES)} = l.k
             JOIN {_values("x", _EXTRAS)} ON o.o_orderkey % {len(_EXTRAS)} = x.k JOIN {_values("p", _PUBLISHERS)} ON o.o_orderkey % {len(_PUBLISHERS)} = p.k""",
    "users": """
        SELECT c.c_custkey AS id, CONCAT(lower(replace(c.c_name, '#', '')), '@mail.example') AS email, CASE WHEN c.c_custkey % 3 = 0 THEN c.c_name WHEN c.c_custkey % 3 = 1 THEN ' ' END AS display_name,
               CASE WHEN c.c_custkey % 10 = 0 THEN 'hr' WHEN c.c_custkey % 97 = 0 THEN 'admin' ELSE 'job_seeker' END AS user_type, CASE WHEN c.c_custkey % 12 = 0 THEN '' ELSE n.n_name END AS country,
               CAST('1998-08-30 06:30:00' AS TIMESTAMP) - CAST(c.c_custkey % 400 AS INT) * INTERVAL 7 HOUR AS created_at, c.c_custkey % 5 <> 0 AS verified, CASE WHEN c.c_custkey % 4 <> 0 THEN o.last_order END AS last_login
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "login_attempts": """
        SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS user_id, CONCAT('user', CAST(user_id AS STRING), '@mail.example') AS email_entered, event_type IN ('click', 'view', 'purchase') AS success,
               CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'BAD_PASSWORD' WHEN value < 60 THEN 'UNKNOWN_USER' ELSE 'LOCKED' END WHEN event_type = 'signup' THEN 'UNVERIFIED' END AS failure_reason, ts AS created_at
        FROM events""",
    "members": """
        SELECT u.user_id AS id, CONCAT('user', CAST(u.user_id AS STRING), '@mail.example') AS email, CASE WHEN u.user_id % 3 = 0 THEN 'hr' WHEN u.user_id % 11 = 0 THEN 'admin' ELSE 'job_seeker' END AS user_type,
               u.first_seen AS created_at, u.user_id % 2 = 0 AS verified, CASE WHEN u.user_id % 4 <> 0 THEN u.last_seen END AS last_login
        FROM (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id) u""",
    "applications": """
        SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey AS job_id, l.l_partkey % 150 + 1 AS user_id, l.l_shipdate AS applied_at,
               CASE l.l_linenumber % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'shortlisted' WHEN 3 THEN 'rejected' ELSE 'hired' END AS status
        FROM lineitem l""",
    "profiles": "SELECT c_custkey AS user_id, c_mktsegment AS headline, CAST(c_custkey % 20 AS INT) AS years_experience FROM customer WHERE c_custkey % 3 <> 0",
    "saved_jobs": "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS user_id, l_orderkey AS job_id, l_shipdate AS saved_at FROM lineitem",
    "subscriptions": "SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'professional' ELSE 'free' END AS tier, o_orderdate AS started_at, o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderstatus = 'O' AS is_active FROM orders",
    "keywords": """
        SELECT p_partkey AS id, p_name AS keyword, CAST(p_size % 4 + 1 AS INT) AS tier, CASE p_size % 3 WHEN 0 THEN 'role' WHEN 1 THEN 'skill' ELSE 'x' END AS category, CAST(p_retailprice / 1000 AS DOUBLE) AS weight, p_partkey % 6 <> 0 AS active,
               CASE WHEN p_partkey % 5 <> 0 THEN CAST('1998-09-01 12:00:00' AS TIMESTAMP) - CAST(p_partkey % 50 AS INT) * INTERVAL 2 HOUR END AS last_run_at, p_partkey % 40 AS inserted, p_partkey % 7 AS duplicates
        FROM part""",
    "runs": """
        SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'adzuna' WHEN 1 THEN 'jsearch' ELSE 'careerjet' END AS source, event_type AS keyword, ts AS started_at, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 5 MINUTE END AS finished_at,
               CASE event_id % 6 WHEN 0 THEN 'rejected_hard' WHEN 1 THEN 'rejected_score' WHEN 2 THEN 'L1' WHEN 3 THEN 'L2' WHEN 4 THEN 'L3' ELSE 'inserted' END AS outcome
        FROM events""",
    "tokens": "SELECT event_id AS id, user_id, ts + INTERVAL 7 DAY AS expires_at, event_type = 'error' AS revoked FROM events",
    "companies": """
        SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug, CASE WHEN s_suppkey % 4 = 0 THEN 'Data & AI' WHEN s_suppkey % 4 = 1 THEN 'Enterprise IT' ELSE 'Software & Product' END AS category,
               CASE WHEN s_suppkey % 3 = 0 THEN 'Dubai' WHEN s_suppkey % 3 = 1 THEN 'Abu Dhabi' ELSE 'UAE-wide' END AS city, CASE WHEN s_suppkey % 5 = 0 THEN 'https://ae.indeed.com/cmp/x' WHEN s_suppkey % 7 = 0 THEN NULL ELSE CONCAT('https://careers.supplier', CAST(s_suppkey AS STRING), '.com') END AS careers_url,
               CASE WHEN s_suppkey % 6 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS status, s_suppkey % 8 = 0 AS featured, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 5 AS BIGINT) END AS submitted_by,
               CAST('1998-09-01 18:00:00' AS TIMESTAMP) - CAST(s_suppkey % 30 AS INT) * INTERVAL 2 HOUR AS created_at
        FROM supplier""",
}

_NEEDS = {
    "postings": ["documents"], "jobs": ["orders"], "users": ["customer", "nation", "orders"], "login_attempts": ["events"], "members": ["events"], "applications": ["lineitem"], "profiles": ["customer"], "saved_jobs": ["lineitem"],
    "subscriptions": ["orders"], "keywords": ["part"], "runs": ["events"], "tokens": ["events"], "companies": ["supplier"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's DataFrame over the tables in sf_dir; nothing is registered in the session's catalogue."""
    from jobloom.sources.tables import read_table

    text = VIEWS[name]
    tables = {t: read_table(spark, sf_dir, t) for t in _NEEDS[name]}
    for t in tables:
        for lead in ("FROM ", "JOIN "):
            text = text.replace(f"{lead}{t} ", f"{lead}{{{t}}} ").replace(f"{lead}{t})", f"{lead}{{{t}}})")
        if text.endswith(f"FROM {t}"):
            text = text.removesuffix(t) + f"{{{t}}}"
    return spark.sql(text, **tables)


def with_views(sql: str) -> str:
    """sql for the oracle, with the views that it names as common table expressions."""
    used = [n for n in VIEWS if n in set(sql.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split())]
    if not used:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().upper().startswith(start):
            return f"{start}{ctes}, {sql.lstrip()[len(start) :]}"
    return f"WITH {ctes} {sql}"
