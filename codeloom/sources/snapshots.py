"""Reading trees of files and comparing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text


def read_tree(spark: SparkSession, folder: str, repository: str = "", commit: str = "", branch: str = "") -> DataFrame:
    """Every file below a folder as a files_raw row; what is not indexable is left unread, bytes are read as UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root}/", "")
    rows = raw.where(text.indexable(path, F.col("length"))).withColumn("path", path)
    return rows.select(
        "path",
        F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string").alias("content"),
        F.lit(repository).alias("repository"),
        F.lit("").alias("url"),
        F.lit(commit).alias("commit"),
        F.lit(branch).alias("branch"),
    )


def parse_gate(files: DataFrame, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(files to parse, failures with a reason): null or empty paths and texts and texts over `most` characters fail."""
    reason = (
        F.when(F.coalesce("path", F.lit("")) == "", "no path")
        .when(F.coalesce("content", F.lit("")) == "", "no content")
        .when(F.length("content") > most, "too long")
    )
    marked = files.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def diff(old: DataFrame, new: DataFrame, key: str = "path", state: str = "hash") -> DataFrame:
    """(key, change_type): A only in new, D only in old, M with another state; equal rows give none.

    A null state differs from any text, and equals a null state.
    """
    o = old.select(F.col(key), F.col(state).alias("o"), F.lit(True).alias("in_old"))
    n = new.select(F.col(key), F.col(state).alias("n"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "A").when(F.col("in_new").isNull(), "D").when(~F.col("o").eqNullSafe(F.col("n")), "M")
    return o.join(n, key, "full").select(key, change.alias("change_type")).where("change_type IS NOT NULL")


def name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, change_type) from lines of a version control's name-status listing; a rename is D of the old and A of the new path."""
    parts = F.split(F.col(column), "\t")
    kind = F.substring(parts[0], 1, 1)
    rows = F.when(kind == "R", F.array(F.struct(parts[1].alias("path"), F.lit("D").alias("change_type")), F.struct(F.try_element_at(parts, F.lit(3)).alias("path"), F.lit("A").alias("change_type")))).otherwise(
        F.array(F.struct(parts[1].alias("path"), kind.alias("change_type")))
    )
    return lines.where(F.size(parts) > 1).select(F.explode(rows).alias("r")).select("r.path", "r.change_type")


def tree_url(url: str) -> str:
    """Address of a repository over ssh, for hosts given by https."""
    import re

    m = re.match(r"^https?://([^/]+)/(.+?)(?:\.git)?/?$", url)
    return f"git@{m[1]}:{m[2]}.git" if m else url
