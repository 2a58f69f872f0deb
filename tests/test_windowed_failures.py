from jobloom.streaming.ingest import windowed_failures


def test_rows_are_dealt_before_they_are_counted_in_windows(spark):
    rows = spark.sql("SELECT id, CASE WHEN id % 5 <> 0 THEN id % 7 END AS user_id, id % 3 = 0 AS success, timestamp'2024-01-01 00:00:00' + id * INTERVAL 20 MINUTES AS created_at FROM range(200)")
    counted = windowed_failures(rows)
    assert "RepartitionByExpression [user_id" in counted._jdf.queryExecution().logical().toString()
    kept = rows.where("not success and user_id is not null").count()
    assert counted.agg({"failures": "sum"}).first()[0] == 24 * kept
