"""Reading the given tables, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder (one Parquet file or folder per table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A folder of our own only where all runs in one process (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder once and read it from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def latest(df: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row per key: the row with the greatest `newest` (nulls lose; equal times: the greatest whole row).

    Aggregation over one struct, so copies shrink before the shuffle; rows with a null key form one group. Columns that
    have no order (maps, also inside others) are compared by their entries.
    """
    rest = [c for c in df.columns if c not in keys and c != newest]
    unordered = [c for c in rest if "map<" in df.schema[c].dataType.simpleString()]

    def entries(c: str) -> Column:
        plain = df.schema[c].dataType.simpleString().startswith("map")
        return F.to_json(F.array_sort(F.map_entries(c)) if plain else F.col(c))

    packed = F.struct(F.col(newest), *[F.col(c) for c in rest if c not in unordered], *[entries(c).alias(c) for c in unordered])
    kept = F.max_by(F.struct(*unordered), packed) if unordered else F.lit(None)
    return (
        df.groupBy(*keys)
        .agg(F.max(packed).alias("_row"), kept.alias("_kept"))
        .select(*keys, *[F.col("_kept" if c in unordered else "_row")[c].alias(c) for c in [newest, *rest]])
        .select(*df.columns)
    )


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or '' where the last path part has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def current_files(spark: SparkSession, sf_dir: str, read_as: Callable[[DataFrame], DataFrame] = lambda raw: raw) -> DataFrame:
    """file_id, path, repository, language, content of each current file that has a text row.

    A file is current in the source_files row with the greatest last_updated; its text is the files_raw row with
    the same repository, path and commit. Repeated text rows stay repeated (their results are equal). Null content
    stays null. `read_as` may put other columns in the place of the content before the rows are met, so that they travel instead.
    """
    now = latest(
        read(spark, sf_dir, "source_files").select("id", "path", "repository", "language", "commit", "last_updated"),
        ["id"],
        "last_updated",
    )
    key = ["repository", "path", "commit"]
    raw = read_as(read(spark, sf_dir, "files_raw").select("path", "repository", "commit", "content"))
    return now.join(raw, key).select(F.col("id").alias("file_id"), "path", "repository", "language", *[c for c in raw.columns if c not in key])
