"""Saving pairs: the size of a task, equal pairs and nulls."""

import duckdb
from pyspark.sql import functions as F

from jobloom.operators.activity import save_jobs


def test_pairs_are_saved_once(spark):
    saved = [(1, 1), (1, 1), (None, 2), (3, None), (4, 4)]
    more = [(1, 1), (None, 2), (3, None), (5, 5), (5, 5), (None, 6), (None, 6), (4, 5)]
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, job_id long")
    values = lambda rows: ", ".join(f"({a}, {b})" for a, b in rows).replace("None", "NULL")
    want = duckdb.sql(f"WITH s(u, j) AS (VALUES {values(saved)}), m(u, j) AS (VALUES {values(more)}) SELECT u, j FROM s UNION ALL (SELECT DISTINCT u, j FROM m EXCEPT SELECT u, j FROM s)").fetchall()
    for at_once in (2, 1_000_000):
        assert sorted(map(tuple, save_jobs(frame(saved), frame(more), at_once).collect()), key=repr) == sorted(want, key=repr)
    assert save_jobs(frame([]), frame([])).count() == 0


def test_tasks_hold_bounded_numbers_of_pairs(spark):
    pairs = spark.range(40_000).select((F.col("id") % 150).alias("user_id"), F.col("id").alias("job_id"))
    held = save_jobs(pairs, pairs, 5_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 17 and max(r["count"] for r in held) < 5_000
