"""Versions of a table in buckets of its id, published by a pointer file that is written last.

A version is a list of buckets and the folders that hold them. A new version writes only the buckets in which rows
changed or came; the others are carried over by name. Readers take the newest version that has its pointer, so they
never see a half-written one, and a batch that is run again finds its version published and changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class Snapshots:
    """A table under root whose rows lie in buckets of width ids each. New rows have growing ids, so they and the
    recent rows that most changes hit lie in few buckets."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id", width: int = 100_000):
        self.spark, self.root, self.schema, self.key, self.width = spark, root.rstrip("/"), schema, key, width

    def bucket(self, key: Column | None = None) -> Column:
        return F.floor((F.col(self.key) if key is None else key) / self.width).cast("long")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The newest published version; -1 if there is none."""
        path, fs = self._fs("versions")
        if not fs.exists(path):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def buckets(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket of a version."""
        version = self.latest() if version is None else version
        if version < 0:
            return {}
        path, fs = self._fs(f"versions/{version}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: other folders are not opened."""
        folders = [f"{self.root}/{folder}" for b, folder in sorted(self.buckets(version).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def publish(self, version: int, rows: DataFrame, replaced: set[int] | None = None) -> None:
        """Publish a version: rows are all rows of the replaced buckets (None: of all buckets) and of new ones."""
        base = {} if replaced is None else {b: f for b, f in self.buckets(version - 1).items() if b not in replaced}
        data = f"data/version={version}"
        rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/{data}")
        path, fs = self._fs(data)
        written = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        base |= {int(n.split("=")[1]): f"{data}/{n}" for n in written}
        # Written aside and renamed: a pointer that can be seen is whole.
        aside, _ = self._fs(f"versions/.{version}")
        final, fs = self._fs(f"versions/{version}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(base).encode()))
        out.close()
        if not fs.rename(aside, final):
            raise RuntimeError(f"version {version} of {self.root} could not be published")

    def update(self, version: int, touched: DataFrame, change) -> int:
        """Publish change(rows of the touched buckets) as a version. touched: ids (column key) of rows that change or
        come; only its bucket numbers reach the driver. Returns how many buckets were written. A version that is
        published already stays as it is."""
        if self.latest() >= version:
            return 0
        hit = {r[0] for r in touched.select(self.bucket()).distinct().collect()}
        self.publish(version, change(self.read(version - 1, hit)), hit)
        return len(hit)
