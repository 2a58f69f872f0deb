"""Incremental forms of the batch operators; each gives what its batch form gives on the same data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobloom.operators.dedup import resolve_batch, upsert_postings
from jobloom.operators.limits import admit, take
from jobloom.operators.scoring import enrich
from jobloom.sources.snapshots import Snapshots
from jobloom.sources.tables import stored


def ingest_stream(spark: SparkSession, path: str, schema, checkpoint: str, merge: Callable[[DataFrame, int], None], files: int | None = None) -> None:
    """Run merge(batch, batch id) over every newly landed file of postings (at most `files` a batch), then stop. The
    checkpoint makes a batch run once; merge must write under its batch id, so that a repeated batch changes nothing."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    query = reader.parquet(path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()


#: The columns of the job table that the ingest keeps.
JOBS = "id long, external_source string, external_job_id string, dedup_hash string, normalized_title string, normalized_company_name string, city string, is_active boolean, apply_url string, publisher string, linkedin_easy_apply boolean, last_seen_at timestamp, duplicate_source_count int, expires_at timestamp"


def merge_postings(table: Snapshots, batch: DataFrame, number: int, as_of) -> int:
    """Merge a batch of postings (seq in the order of arrival) into the job table as its version number + 1: enrich,
    reject, resolve against the table and within the batch, update the jobs that were met and add the others, whose id
    is their seq. Only buckets with such rows are written; returns their number (0: the batch was merged before)."""
    spark = batch.sparkSession
    if table.latest() > number:
        return 0
    # What the table doesn't keep is not worked out, nor are its long texts written again.
    enriched = enrich(batch).withColumn("external_source", F.col("source"))
    kept = {"seq", "reject_stage", *table.schema.names}
    enriched = stored(spark, enriched.select(*[c for c in enriched.columns if c in kept]), "ingest-batch")
    accepted = enriched.where("reject_stage is null")
    jobs = table.read(number)
    found = stored(spark, resolve_batch(accepted, jobs), "ingest-resolved")
    now = F.lit(as_of).cast("timestamp")
    fresh = {"id": F.col("seq"), "is_active": F.lit(True), "last_seen_at": now, "duplicate_source_count": F.lit(0), "expires_at": now + F.expr("INTERVAL 30 DAYS")}
    # Rows that lead themselves are new jobs; the others count on a job of the table or of this batch.
    rows = accepted.join(found, "seq").withColumns(fresh)
    new = stored(spark, rows.where("level = 'NONE'"), "ingest-new")
    hits = stored(spark, rows.where("level <> 'NONE'").withColumn("match_id", F.coalesce("job", "leader")), "ingest-hits")

    def change(old: DataFrame) -> DataFrame:
        return upsert_postings(old.unionByName(new.select(*old.columns)), hits, as_of)

    touched = hits.select(F.col("match_id").alias("id")).unionByName(new.select("id"))
    return table.update(number + 1, touched, change)


def windowed_failures(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Failures per user in sliding 24-hour windows. How late an attempt may come is our choice."""
    # A row counts in 24 windows, which are summed up in memory before they are shuffled: rows are dealt by user first,
    # so that no task holds the windows of a whole file.
    failed = attempts.where(~F.col("success") & F.col("user_id").isNotNull()).select("user_id", "created_at").withWatermark("created_at", late).repartition("user_id")
    counted = failed.groupBy(F.window("created_at", "24 hours", "1 hour"), "user_id").agg(F.count("*").alias("failures"))
    return counted.select("user_id", F.col("window.end").alias("window_end"), "failures")


def daily_health(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    from jobloom.operators.activity import success_rate

    counted = attempts.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day")).agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))
    return counted.select(F.col("window.start").alias("day"), "attempts", "successes", success_rate(F.col("successes"), F.col("attempts")).alias("success_rate"))


def view_counts(views: DataFrame) -> DataFrame:
    """Running views per job, for update mode."""
    return views.groupBy("job_id").agg(F.count("*").alias("n"))


class _Sliding(StatefulProcessor):
    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getListState("admitted", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["t", "id"])
        held = [r[0] for r in self.admitted.get()]
        pdf["admitted"] = admit(pdf["t"].tolist(), self.limit, self.window, held)
        if held:
            self.admitted.put([(t,) for t in held])
        else:
            self.admitted.clear()
        yield pdf[["key", "id", "t", "admitted"]]

    def close(self) -> None:
        pass


class _Bucket(StatefulProcessor):
    def __init__(self, capacity: int, period: int):
        self.capacity, self.period = capacity, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens long, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values(["t", "id"])
        state = list(self.bucket.get()) if self.bucket.exists() else []
        pdf["admitted"] = take(pdf["t"].tolist(), self.capacity, self.period, state)
        self.bucket.update((int(state[0]), int(state[1])))
        yield pdf[["key", "id", "t", "admitted"]]

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, processor: StatefulProcessor) -> DataFrame:
    timed = events.select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType="key string, id long, t long, admitted boolean", outputMode="Append", timeMode="None")


def sliding_admission_stream(events: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Admission of a stream of events (key, id, ts). State per key: the times let in within the window, at
    most limit. Events of one key must arrive in order across batches."""
    return _stateful(events, _Sliding(limit, window_seconds * 1_000_000))


def token_bucket_stream(events: DataFrame, capacity: int, period_seconds: int) -> DataFrame:
    return _stateful(events, _Bucket(capacity, period_seconds * 1_000_000))
