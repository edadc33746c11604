"""Nodes and edges as tables: keyed upsert, deletion, transitive closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.tables import cut


def upsert(old: DataFrame, new: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Rows of `new`, and those of `old` whose key `new` lacks. Repeats of a key in `new`: the greatest `newest`.

    Rows of `new` without a key are skipped. Columns missing on one side come out null.
    """
    keyed = new.where(F.col(key).isNotNull())
    if newest is not None:
        rest = [c for c in keyed.columns if c not in (key, newest)]
        keyed = keyed.groupBy(key).agg(F.max(F.struct(newest, *rest)).alias("_r")).select(key, "_r.*")
    else:
        keyed = keyed.dropDuplicates([key])
    kept = old.join(keyed.select(key), key, "left_anti")
    return keyed.unionByName(kept, allowMissingColumns=True)


def update_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """upsert() that never adds a key."""
    return upsert(old, new.join(old.select(key).distinct(), key, "left_semi"), key)


def upsert_edges(edges: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with the new ones whose both ends exist; one edge per (src, dst, rel_type), new properties win.

    A missing rel_type is RELATED_TO. sources and targets: a column id.
    """
    fine = (
        new.withColumn("rel_type", F.coalesce("rel_type", F.lit("RELATED_TO")))
        .join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
        .join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
        .dropDuplicates(["src", "dst", "rel_type"])
    )
    return fine.unionByName(edges.join(fine, ["src", "dst", "rel_type"], "left_anti"), allowMissingColumns=True)


def detach(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of `gone` (column id) and without edges at either end of them."""
    out = gone.select("id").distinct()
    return (
        nodes.join(out, "id", "left_anti"),
        edges.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti"),
    )


def delete_where(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true; null is not true."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def closure(edges: DataFrame, start: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(src, dst, depth): every node reached from src over edges, with its least distance, at most `most` steps.

    Semi-naive: each round joins only the pairs found in the round before with the edges. Cycles end, because a pair
    that is known is not followed again. start: a column id; without it, every source is a start.
    """
    steps = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    if start is not None:
        new = steps.join(start.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    else:
        new = steps
    new = cut(new.withColumn("depth", F.lit(1)))
    found, depth = new, 1
    ahead = steps.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    while new.limit(1).count() and (most is None or depth < most):
        depth += 1
        reached = (
            new.join(ahead, F.col("dst") == F.col("mid"))
            .where("src <> far")
            .select("src", F.col("far").alias("dst"))
            .distinct()
            .join(found.select("src", "dst"), ["src", "dst"], "left_anti")
        )
        new = cut(reached.withColumn("depth", F.lit(depth)))
        found = found.unionByName(new)
    return found


def paths(edges: DataFrame, most: int) -> DataFrame:
    """(src, dst, length, path): every way over one to `most` edges that meets no node twice; path lists its nodes."""
    steps = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    ahead = steps.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    found = new = cut(steps.select("src", "dst", F.array("src", "dst").alias("path")))
    for _ in range(most - 1):
        longer = new.join(ahead, F.col("dst") == F.col("mid")).where(~F.array_contains("path", F.col("far")))
        new = cut(longer.select("src", F.col("far").alias("dst"), F.array_append("path", F.col("far")).alias("path")))
        found = found.unionByName(new)
    return found.select("src", "dst", (F.size("path") - 1).cast("bigint").alias("length"), "path")


def contained_in(files: DataFrame, contains: DataFrame) -> DataFrame:
    """Everything below the given files (column id), however deep: what deleting them takes along."""
    below = closure(contains, files).select(F.col("dst").alias("id"))
    return below.unionByName(files.select("id")).distinct()
