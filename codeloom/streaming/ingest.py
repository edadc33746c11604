"""Incremental indexing of a feed of file states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import graph
from codeloom.tables import latest


def feed(spark: SparkSession, folder: str, schema, glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def apply_batch(state: DataFrame, batch: DataFrame, key: str = "id", newest: str = "last_updated", deleted: str | None = None) -> DataFrame:
    """The state after a batch: per key the row with the greatest `newest` of both sides, rows marked deleted gone.

    Late rows (older than what is known) change nothing; applying a batch twice changes nothing.
    """
    both = state.unionByName(batch, allowMissingColumns=True).where(F.col(key).isNotNull())
    now = latest(both, [key], newest)
    return graph.delete_where(now, F.col(deleted)) if deleted else now


class Index:
    """A table kept by upserts, one complete folder per micro-batch; a batch that comes twice is applied once.

    What is there is read off the folder, so a driver that starts again goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", newest: str = "last_updated", deleted: str | None = None):
        self.spark, self.folder, self.key, self.newest, self.deleted = spark, folder.rstrip("/"), key, newest, deleted
        self.version = self._newest()

    def _newest(self) -> int | None:
        """The greatest version that was written to its end."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return max(whole, default=None)

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version}"

    def upsert(self, batch: DataFrame, number: int) -> None:
        """foreachBatch function."""
        if self.version is not None and number <= self.version:
            return
        old = self.spark.read.parquet(self._path(self.version)) if self.version is not None else batch.limit(0)
        apply_batch(old, batch, self.key, self.newest, self.deleted).write.mode("overwrite").parquet(self._path(number))
        self.version = number

    def run(self, stream: DataFrame) -> None:
        """Apply all that the stream holds now, batch by batch."""
        query = stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def read(self) -> DataFrame:
        if self.version is None:
            raise ValueError("nothing indexed yet")
        return self.spark.read.parquet(self._path(self.version))


def recent(files: DataFrame, n: int = 10) -> DataFrame:
    """The n files updated last, ties to the smallest id."""
    return files.orderBy(F.desc("last_updated"), "id").limit(n)
