"""Reports over the graph (A1-A20, J10, J15, J16, GQ1-GQ22): counts, degrees, dead code, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def degree_stats(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """One row: nodes, average and greatest number of edges per node; nodes without edges count as 0."""
    degrees = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(degrees, "id", "left").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.avg(F.coalesce("degree", F.lit(0))), 6).alias("avg_degree"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
    )


def resolution_stats(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: sites, resolved sites, their share in percent (0 where there are no sites)."""
    hit = resolved.select(F.col("src").alias("id")).distinct().withColumn("hit", F.lit(1))
    return sites.select("id").join(hit, "id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("hit").alias("resolved"),
        F.round(F.coalesce(F.try_divide(F.count("hit") * 100.0, F.count(F.lit(1))), F.lit(0.0)), 6).cast("double").alias("pct"),
    )


def top(rows: DataFrame, by: str, tie: str, n: int = 10) -> DataFrame:
    """The n rows with the greatest `by`, ties to the smallest `tie`."""
    return rows.orderBy(F.desc(by), tie).limit(n)


def dead(functions: DataFrame, calls: DataFrame, exclude: list[str] | None = None, entry_points: bool = True) -> DataFrame:
    """Functions that nothing calls, without entry points, tests and names that a pattern of `exclude` matches whole."""
    name = F.col("name")
    kept = functions.join(calls.select(F.col("callee").alias("id")).distinct(), "id", "left_anti")
    if entry_points:
        kept = kept.where(~name.isin("main", "__main__", "__init__") & ~name.startswith("test_") & ~name.startswith("Test"))
    for pattern in exclude or []:
        kept = kept.where(~name.rlike(f"^(?:{pattern})$"))
    return kept


def dead_classes(classes: DataFrame, functions: DataFrame, calls: DataFrame, inherits: DataFrame) -> DataFrame:
    """Classes that no class inherits from and none of whose methods is called; test classes aside."""
    used = calls.select(F.col("callee").alias("id")).join(functions.select("id", "class_id"), "id").select(F.col("class_id").alias("id"))
    parents = inherits.select(F.col("dst").alias("id"))
    name = F.col("name")
    return (
        classes.where(~name.startswith("Test") & ~name.endswith("Test") & ~name.endswith("TestCase"))
        .join(used.unionByName(parents).where("id IS NOT NULL").distinct(), "id", "left_anti")
    )


def samples(rows: DataFrame, n: int = 10) -> DataFrame:
    """One row: how many rows, and the n smallest (name, id). Only n rows are ever gathered."""
    few = rows.orderBy("name", "id").limit(n).agg(F.array_sort(F.collect_list(F.concat_ws(":", "name", "id"))).alias("samples"))
    return rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(few))


def file_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(src_file, dst_file, strength): calls between different files."""
    at = functions.select("id", "file_id")
    return (
        calls.join(at.select(F.col("id").alias("caller"), F.col("file_id").alias("src_file")), "caller")
        .join(at.select(F.col("id").alias("callee"), F.col("file_id").alias("dst_file")), "callee")
        .where("src_file <> dst_file")
        .groupBy("src_file", "dst_file")
        .agg(F.count(F.lit(1)).alias("strength"))
    )


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each value of a column; the total is one broadcast row."""
    n = counts_by(rows, key)
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))
    return n.join(total).select(key, "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).cast("double").alias("pct"))
