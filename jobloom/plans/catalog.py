"""Registered queries over the adapter views, each with the oracle's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobloom.plans.adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Views and tables by attribute: v.jobs, v.documents."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from jobloom.plans.adapters import VIEWS
        from jobloom.sources.tables import read_table

        return view(self.spark, self.sf_dir, name) if name in VIEWS else read_table(self.spark, self.sf_dir, name)


    def enriched(self, *names: str) -> DataFrame:
        """Columns of all postings with what the ingest derives, worked out once and stored: a filter on the result
        would otherwise repeat these long expressions below itself. What is not named is not worked out."""
        from jobloom.operators.scoring import enrich
        from jobloom.sources.tables import stored

        return stored(self.spark, enrich(self.postings).select(*names), "enriched")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
