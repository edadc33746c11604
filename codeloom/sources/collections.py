"""Vector collections as folders of Parquet, written in versions.

A version is a complete folder; the newest number counts, and no reader ever sees a folder being written. Undo points
back to the version before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators import graph, vectors

# Type names of a schema description; any other name is text.
TYPES = {"int": T.LongType(), "integer": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType()}
# Metadata of a code chunk.
CODE_FIELDS = {
    "file_path": "string", "language": "string", "entity_type": "string", "entity_id": "string", "start_line": "int", "end_line": "int",
    "chunk_id": "string", "indexed_at": "string", "repository": "string", "branch": "string", "commit_id": "string",
}
DEFAULTS = {"string": "", "long": 0, "float": 0.0, "double": 0.0, "boolean": False}


def schema_of(fields: Mapping[str, str], extra: bool = True) -> T.StructType:
    rows = [T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))]
    rows += [T.StructField(n, TYPES.get(k, T.StringType())) for n, k in fields.items()]
    return T.StructType(rows + ([T.StructField("extra", T.MapType(T.StringType(), T.StringType()))] if extra else []))


class Collection:
    """One named collection below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, name: str, fields: Mapping[str, str] = CODE_FIELDS):
        self.spark, self.path, self.schema = spark, f"{folder.rstrip('/')}/{name}", schema_of(fields)

    def _fs(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if fs.exists(path(f"{self.path}/{s.getPath().getName()}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def exists(self) -> bool:
        return bool(self.versions())

    def create(self) -> bool:
        """Make an empty collection; True also where it is there already."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], self.schema))
        return True

    def drop(self) -> bool:
        fs, path = self._fs()
        return bool(self.exists() and fs.delete(path(self.path), True))

    def read(self) -> DataFrame:
        held = self.versions()
        if not held:
            raise ValueError(f"no collection at {self.path}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{held[-1]}")

    def _write(self, rows: DataFrame) -> None:
        held = self.versions()
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/v{held[-1] + 1 if held else 0}")

    def undo(self) -> bool:
        """Take back the last write."""
        held = self.versions()
        fs, path = self._fs()
        return bool(len(held) > 1 and fs.delete(path(f"{self.path}/v{held[-1]}"), True))

    def insert(self, rows: DataFrame) -> None:
        """Add rows, those of known ids in the place of the old; missing fields get their type's default."""
        given = rows
        if "id" not in given.columns:
            given = given.withColumn("id", F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in given.columns if c not in ("vector", "extra")])))
        for field in self.schema.fields:
            default = DEFAULTS.get(field.dataType.typeName())
            if field.name not in given.columns:
                given = given.withColumn(field.name, F.lit(default).cast(field.dataType))
            elif default is not None and field.name != "id":
                given = given.withColumn(field.name, F.coalesce(F.col(field.name).cast(field.dataType), F.lit(default)))
        self._write(graph.upsert(self.read(), given.select(*self.schema.names), "id"))

    def get(self, ids: DataFrame) -> DataFrame:
        return self.read().join(ids.select("id").distinct(), "id", "left_semi")

    def delete(self, ids: DataFrame | None = None, filters: Mapping | None = None) -> None:
        """Delete by ids, else by a filter; without either nothing is deleted."""
        rows = self.read()
        if ids is not None:
            self._write(rows.join(ids.select("id").distinct(), "id", "left_anti"))
        elif (test := vectors.condition(filters)) is not None:
            self._write(graph.delete_where(rows, test))

    def count(self, filters: Mapping | None = None) -> int:
        return vectors.where(self.read(), filters).count()

    def search(self, queries: DataFrame, k: int = 10, metric: str = "cosine", filters: Mapping | None = None, least: float | None = None) -> DataFrame:
        """Hits with their metadata; `least` drops scores below it (for l2 the score is 1 / (1 + distance))."""
        rows = vectors.where(self.read(), filters)
        hits = vectors.top_k(queries, rows.select("id", "vector"), k, metric, "string")
        if least is not None:
            score = 1 / (1 + F.col("score")) if metric == "l2" else F.col("score")
            hits = hits.where(score >= least)
        return hits.join(rows.drop("vector"), "id")


#: Known kinds of vector store.
STORES = {"parquet": Collection}


def store(kind: str, *args, **kwargs) -> Collection:
    if kind not in STORES:
        raise ValueError(f"unsupported vector store: {kind}")
    return STORES[kind](*args, **kwargs)
