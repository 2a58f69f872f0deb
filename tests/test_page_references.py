"""Pages whose references are cut off, against the SQL."""

import duckdb
import pytest

import __spark_entry__ as E

#: A title cut within `&amp;`, unknown and numeric references, and an article that reaches 150 characters only as cut.
HEADS = ["Lead and&amp;&amp;&amp", "Lead &quot", "Lead &am", "Lead &", "Lead &ampx; &amp;lt;", "Lead &notit;", "Lead &amp;&amp;"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cut"))
    article = lambda h, n: f"<title>{h}</title></head><article><h1>{h}</h1><p>{'word ' * n}<!-- & --></p></article>"
    short = "x" * 146 + "&amp"
    rows = [(i, "https://www.firm.example/a", "<html><head>" + article(h, 60)) for i, h in enumerate(HEADS)] + [(90, "https://www.firm.example/b", f"<title>IT Lead</title><article><p>{short}</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def _same(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = sorted(db.execute(E.oracle_sql()[name]).fetchall(), key=repr)
    assert sorted([tuple(r) for r in E.queries()[name](spark, folder).collect()], key=repr) == want
    return want


def test_postings_of_cut_pages(spark, cut):
    assert len(_same(spark, cut, "a08_postings_from_pages")) == len(HEADS) + 1


def test_rendered_texts_of_cut_pages(spark, cut):
    texts = dict(_same(spark, cut, "a15_rendered_description"))
    assert texts[0].startswith("Lead and&&&amp") and texts[4].startswith("Lead &ampx; &lt;")


def test_previews_of_cut_pages(spark, cut):
    # The article of the last page has 150 characters, of which a decoded reference would take three.
    assert 90 not in dict(_same(spark, cut, "c18_complete_preview"))
