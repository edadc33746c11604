"""Placeholder resolution: call sites to the functions they may mean, with a confidence.

The score depends only on where a definition lies, so definitions are first reduced to the smallest id per place and
name; each rung of the ladder is then one equi join that keeps at most one row per call site. No call site ever meets
all definitions of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _least(defs: DataFrame, keys: dict[str, Column], out: str) -> DataFrame:
    return defs.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.min("id").alias(out))


def resolve(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """(src, dst, score): call site to function of its name in its repository; 1.0 in its own file, else 0.7.

    Ties go to the smallest function id; sites without a definition give no row. Null names or repositories never match.
    """
    same = _least(defs, {"caller_file_id": F.col("file_id"), "call_name": F.col("name")}, "same")
    best = _least(defs, {"repository": F.col("repository"), "call_name": F.col("name")}, "best")
    return (
        sites.select("id", "caller_file_id", "repository", "call_name")
        .join(same, ["caller_file_id", "call_name"], "left")
        .join(best, ["repository", "call_name"], "left")
        .select(
            F.col("id").alias("src"),
            F.coalesce("same", "best").alias("dst"),
            F.when(F.col("same").isNotNull(), 1.0).otherwise(0.7).alias("score"),
        )
        .where("dst IS NOT NULL")
    )


def resolve_naive(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """The same by ranking every pair; the yardstick for resolve()."""
    pairs = sites.alias("s").join(defs.alias("d"), F.expr("s.repository = d.repository AND s.call_name = d.name"))
    scored = pairs.select(
        F.col("s.id").alias("src"), F.col("d.id").alias("dst"), F.expr("CASE WHEN s.caller_file_id = d.file_id THEN 1.0D ELSE 0.7D END").alias("score")
    )
    first = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return scored.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def resolve_ladder(sites: DataFrame, defs: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, score) with four rungs: 1.0 own file, 0.9 own folder, 0.8 an imported module's file, 0.5 repository.

    files: id, path, repository; imports: file_id, module_name. A module means the files whose name without extension
    is its last part.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    place = files.select(F.col("id").alias("file_id"), folder.alias("folder"), stem.alias("stem"))
    d = defs.select("id", "file_id", "name", "repository").join(place, "file_id")
    s = sites.select(F.col("id"), F.col("caller_file_id").alias("file_id"), "repository", "call_name").join(place, "file_id", "left")
    same = _least(d, {"file_id": F.col("file_id"), "call_name": F.col("name")}, "r1")
    near = _least(d, {"repository": F.col("repository"), "folder": F.col("folder"), "call_name": F.col("name")}, "r2")
    by_module = _least(d, {"repository": F.col("repository"), "module": F.col("stem"), "call_name": F.col("name")}, "r3")
    anywhere = _least(d, {"repository": F.col("repository"), "call_name": F.col("name")}, "r4")
    module = F.regexp_extract("module_name", r"([A-Za-z0-9_-]+)(?:\.js|\.ts)?$", 1)
    imported = imports.select("file_id", module.alias("module")).where("module <> ''").distinct()
    third = (
        s.join(imported, "file_id")
        .join(by_module, ["repository", "module", "call_name"])
        .groupBy("id")
        .agg(F.min("r3").alias("r3"))
    )
    return (
        s.join(same, ["file_id", "call_name"], "left")
        .join(near, ["repository", "folder", "call_name"], "left")
        .join(third, "id", "left")
        .join(anywhere, ["repository", "call_name"], "left")
        .select(
            F.col("id").alias("src"),
            F.coalesce("r1", "r2", "r3", "r4").alias("dst"),
            F.expr("CASE WHEN r1 IS NOT NULL THEN 1.0D WHEN r2 IS NOT NULL THEN 0.9D WHEN r3 IS NOT NULL THEN 0.8D ELSE 0.5D END").alias("score"),
        )
        .where("dst IS NOT NULL")
    )


def resolve_qualified(sites: DataFrame, defs: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, dst, score): attribute calls meet methods first (1.0), then any function of the name (0.8) in the repository."""
    methods = defs.join(classes.select(F.col("id").alias("class_id")), "class_id", "left_semi")
    first = _least(methods, {"repository": F.col("repository"), "call_name": F.col("name")}, "m")
    other = _least(defs, {"repository": F.col("repository"), "call_name": F.col("name")}, "f")
    return (
        sites.select("id", "repository", "call_name", "is_attribute_call")
        .join(first, ["repository", "call_name"], "left")
        .join(other, ["repository", "call_name"], "left")
        .withColumn("m", F.when(F.col("is_attribute_call"), F.col("m")))
        .select(F.col("id").alias("src"), F.coalesce("m", "f").alias("dst"), F.when(F.col("m").isNotNull(), 1.0).otherwise(0.8).alias("score"))
        .where("dst IS NOT NULL")
    )


def resolve_new(sites: DataFrame, defs: DataFrame, edges: DataFrame) -> DataFrame:
    """Resolution of the sites that no edge (src) covers yet."""
    return resolve(sites.join(edges.select(F.col("src").alias("id")), "id", "left_anti"), defs)


def calls(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst, score): function to function, derived from call sites and their resolution; the best score counts."""
    return (
        resolved.join(sites.select(F.col("id").alias("src"), "caller_function_id"), "src")
        .groupBy(F.col("caller_function_id").alias("caller"), F.col("dst").alias("callee"))
        .agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("sites"))
    )
