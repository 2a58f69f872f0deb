"""Tables: scans with a schema check, snapshots and logs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema, its columns in that order after a check of their types."""
    df = spark.read.parquet(f"{path}/{name}.parquet")
    if schema is not None:
        have = {f.name: f.dataType for f in df.schema.fields}
        wrong = [f"{f.name}: {have.get(f.name)}" for f in schema.fields if have.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"{name} differs from its schema in {', '.join(wrong)}")
        df = df.select([f.name for f in schema.fields])
    return df


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new state of a table; readers of the old path are not disturbed. Active rows are a partition."""
    df.write.mode("errorifexists").partitionBy("is_active").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A snapshot by its schema; the partition column's type would be guessed otherwise."""
    return spark.read.schema(schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One process, as in tests: any folder is shared.
        base = f"/tmp/jobloom-shared/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and it survives lost executors."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
