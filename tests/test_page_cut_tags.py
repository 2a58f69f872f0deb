"""Articles whose last tag is cut off, against the SQL."""

import pytest

from tests.test_page_references import _same


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("cut-tags"))
    page = lambda n, end: f"<html><head><title>IT Lead</title></head><article><h1>IT</h1><p>{'x' * n}{end}</article><footer>{'y' * 200}</footer>"
    ends = ["<p", "</", "</p", "<b", "<", "<br></P", "</p>", " a < b", "</p><!-- < -->"]
    rows = [(i, "https://www.firm.example/a", page(200, end)) for i, end in enumerate(ends)] + [(90, "https://www.firm.example/b", page(100, "<p"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["a08_postings_from_pages", "a15_rendered_description"])
def test_texts_end_with_their_article(spark, cut, name):
    assert len(_same(spark, cut, name)) == 10


def test_short_article_with_a_cut_tag_is_incomplete(spark, cut):
    assert [r[0] for r in _same(spark, cut, "c18_complete_preview")] == [90]
