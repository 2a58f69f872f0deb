"""Articles with characters that Python takes for white space and the SQL does not, against the SQL."""

import pytest

from tests.test_page_references import _same


@pytest.fixture(scope="module")
def spaced(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("spaces"))
    page = lambda text: f"<html><head><title>IT Lead</title></head><article><p>{text}</p></article>"
    # Long only with their runs of separators; short, as such characters end them; white space of HTML.
    texts = ["x" * 100 + c * 60 + "y" for c in "\x0b\x1c\x1f\x85  　"] + ["x" * 149 + c for c in "   　"]
    texts += ["x" * 149 + c for c in "\x0b\x1d\x85 "] + ["x \t\n\f\r\xa0" * 70, "x" * 148 + "\xa0 \n"]
    rows = [(i, "https://www.firm.example/a", page(t)) for i, t in enumerate(texts)] + [(17, "https://www.firm.example/b", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def test_incomplete_previews_of_spaced_pages(spark, spaced):
    assert sorted(r[0] for r in _same(spark, spaced, "c18_complete_preview")) == [7, 8, 9, 10, 15, 16, 17]


@pytest.mark.parametrize("name", ["a08_postings_from_pages", "a15_rendered_description"])
def test_texts_of_spaced_pages(spark, spaced, name):
    assert len(_same(spark, spaced, name)) == 18
