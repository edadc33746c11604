"""The entity tables as one row per id, and the sites that are read off source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import ids, text
from codeloom.sources import imports
from codeloom.tables import current_files, latest, read

# Words before a bracket that are no calls.
NO_CALLS = "if for while switch catch return function def class and or not in elif assert lambda await super synchronized with except print".split()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of each file: greatest last_updated; equal rows once."""
    cols = ["id", "path", "name", "language", "repository", "commit", "last_updated"]
    return latest(read(spark, sf_dir, "source_files").select(*cols), ["id"], "last_updated")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods, repeats once; repository from the file where the row has none."""
    rows = read(spark, sf_dir, "function_defs").dropDuplicates(["id"])
    repo = files(spark, sf_dir).select(F.col("id").alias("file_id"), F.col("repository").alias("file_repository"))
    return (
        rows.join(repo, "file_id", "left")
        .withColumn("repository", F.coalesce("repository", "file_repository"))
        .drop("file_repository")
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "class_defs").dropDuplicates(["id"])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])


#: Strings and comments within a line, by family of languages, and what names a definition before a bracket.
PY_QUIET = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|#.*$"
C_QUIET = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|//.*$|/\*.*?\*/|^\s*(?:/?\*.*)$"
HEAD = r"\b(?:def|class|function)\b\s*\*?\s*[A-Za-z_$][A-Za-z0-9_$]*\s*\("
CALL = r"(\.?[A-Za-z_][A-Za-z0-9_]*)(?:<[A-Za-z0-9_, .?]*>)?\("


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, repository, content) of the current texts, repeats once, null texts left out."""
    return current_files(spark, sf_dir).where("content IS NOT NULL").select("file_id", "path", "repository", "content").distinct()


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, call_name, is_attribute_call, caller_file_id, caller_function_id, repository, start_line), one row per id.

    Read off whole texts: every name before an opening bracket (type arguments aside) outside strings and comments that
    is no head of a definition. The caller is the innermost function whose lines hold the site, null outside functions.
    """
    python = text.extension(F.col("path")) == ".py"
    # what stands between triple quotes leaves its line ends only
    parts = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\"\"\"|'''")
    quiet = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, "[^\n]", "")).otherwise(x)), "\"\"")
    code = sources(spark, sf_dir).where(text.language_of(F.col("path")).isNotNull()).select(
        "file_id", "repository", python.alias("python"), F.posexplode(F.split(F.when(python, quiet).otherwise(F.regexp_replace("content", "\r\n?", "\n")), "\n")).alias("at", "line")
    )
    bare = F.regexp_replace(F.when(F.col("python"), F.regexp_replace("line", PY_QUIET, "")).otherwise(F.regexp_replace("line", C_QUIET, "")), HEAD, "(")
    sites = (
        code.where(F.col("line").contains("("))
        .select("file_id", "repository", (F.col("at") + 1).alias("start_line"), F.explode(F.regexp_extract_all(bare, F.lit(CALL), F.lit(1))).alias("hit"))
        .select("file_id", "repository", "start_line", F.ltrim(F.col("hit"), F.lit(".")).alias("call_name"), F.startswith("hit", F.lit(".")).alias("dotted"))
        .where(~F.col("call_name").isin(NO_CALLS))
        .groupBy("file_id", "repository", "call_name", "start_line")
        .agg(F.max("dotted").alias("is_attribute_call"))
    )
    defined = functions(spark, sf_dir).where("start_line > 0 AND end_line >= start_line")
    heads = defined.select("file_id", F.col("name").alias("call_name"), "start_line").distinct()
    owner = (
        defined.select("file_id", F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id").alias("f"), F.explode(F.sequence("start_line", "end_line")).alias("start_line"))
        .groupBy("file_id", "start_line")
        .agg(F.min("f").alias("f"))
        .select("file_id", "start_line", F.col("f.id").alias("caller_function_id"))
    )
    return (
        sites.join(heads, ["file_id", "call_name", "start_line"], "left_anti")
        .join(owner, ["file_id", "start_line"], "left")
        .select(
            ids.call_site_id(F.col("file_id"), F.col("call_name"), F.col("start_line")).alias("id"), "call_name", "is_attribute_call", F.col("file_id").alias("caller_file_id"), "caller_function_id", "repository", "start_line"
        )
    )


def import_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file_id, module_name, is_from_import, start_line, repository): one row per imported module and line; in Java the
    module is the whole dotted name."""
    src = sources(spark, sf_dir)
    rows = (
        imports.import_statements(src)
        .groupBy("file_id", F.col("target").alias("module_name"), "start_line")
        .agg(F.max(F.col("import_name").isNotNull()).alias("is_from_import"))
        .join(files(spark, sf_dir).select(F.col("id").alias("file_id"), "repository"), "file_id")
    )
    return rows.withColumn("id", ids.joined(F.col("file_id"), F.lit("import"), F.col("module_name"), F.col("start_line")))


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): file to class, file to function, class to method."""
    f = functions(spark, sf_dir)
    return (
        f.select(F.col("file_id").alias("src"), F.col("id").alias("dst"), F.lit("file_function").alias("kind"))
        .unionByName(classes(spark, sf_dir).select(F.col("file_id").alias("src"), F.col("id").alias("dst"), F.lit("file_class").alias("kind")))
        .unionByName(f.where("class_id IS NOT NULL").select(F.col("class_id").alias("src"), F.col("id").alias("dst"), F.lit("class_function").alias("kind")))
    )


def inherits_of(classes: DataFrame) -> DataFrame:
    """(src, dst): class (id, name, parents) to each class that one of its parents names, in any repository; never itself."""
    asked = classes.select(F.col("id").alias("src"), F.explode("parents").alias("name")).distinct()
    return asked.join(classes.select(F.col("id").alias("dst"), "name"), "name").where("src <> dst").select("src", "dst").distinct()


def inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inherits_of(classes(spark, sf_dir))
