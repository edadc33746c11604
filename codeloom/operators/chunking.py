"""Cutting source text into chunks.

Structure-aware chunks are slices of a file's lines and stay in the JVM. Sliding windows follow a recurrence (where a
window ends decides where the next begins), so they run in Python over Arrow batches, one file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import ids, text

#: Least tokens of a window and lines that windows share.
TOKENS, OVERLAP = 1024, 10
_PUNCT = re.compile(r"[().,;]")


def windows(lines: list[str], tokens: int = TOKENS, overlap: int = OVERLAP, compat: bool = False) -> list[tuple[int, int]]:
    """(start, end) of each window, end exclusive: it grows until it holds `tokens`, the next starts `overlap` lines back.

    Ends with the window that reaches the last line; compat goes on with ever shorter windows, as older indexes hold.
    """
    sizes = [max(1, len(x.split()) + len(_PUNCT.findall(x))) for x in lines]
    found, start = [], 0
    while start < len(lines):
        end, held = start, 0
        while end < len(lines) and held < tokens:
            held += sizes[end]
            end += 1
        found.append((start, end))
        if end == len(lines) and not compat:
            break
        start = max(start + 1, end - overlap)
    return found


def window_chunks(files: DataFrame, tokens: int = TOKENS, overlap: int = OVERLAP, compat: bool = False) -> DataFrame:
    """(file_id, start_line, end_line, content) windows of files (file_id, content); null and empty texts have none."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file_id"], batch["content"]):
                if content:
                    lines = content.split("\n")
                    rows += [(file, a + 1, b, "\n".join(lines[a:b])) for a, b in windows(lines, tokens, overlap, compat)]
            yield pd.DataFrame(rows, columns=["file_id", "start_line", "end_line", "content"])

    return files.select("file_id", "content").mapInPandas(cut_up, "file_id string, start_line int, end_line int, content string")


def entity_chunks(files: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """One chunk per entity (id, file_id, start_line, end_line) whose span lies in its file."""
    rows = files.select("file_id", text.lines(F.col("content")).alias("lines"))
    inside = (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.size("lines"))
    return (
        entities.select(F.col("id").alias("entity_id"), "file_id", "start_line", "end_line")
        .join(rows, "file_id")
        .where(inside)
        .select(
            ids.chunk_id(F.col("file_id"), F.col("start_line"), F.col("end_line"), F.lit(kind)).alias("chunk_id"),
            "entity_id",
            "file_id",
            "start_line",
            "end_line",
            F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content"),
            F.lit(kind).alias("content_type"),
        )
    )


def header_chunks(files: DataFrame, entities: DataFrame) -> DataFrame:
    """The lines before the first entity of each file, where they are not blank."""
    first = entities.where("start_line > 0").groupBy("file_id").agg(F.min("start_line").alias("first"))
    head = F.array_join(F.slice(text.lines(F.col("content")), F.lit(1), F.col("first") - 1), "\n")
    return (
        files.join(first, "file_id")
        .where("first > 1")
        .select("file_id", F.lit(1).alias("start_line"), (F.col("first") - 1).alias("end_line"), head.alias("content"))
        .where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")
    )


# Lines that begin a function or a class, and lines that end the one before, by extension.
STARTS = {
    "function": {".py": r"^\s*(async\s+)?def\s+\w+\s*\(", ".js": r"^\s*(export\s+)?(async\s+)?function\s+\w+|^\s*(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?(function|\()"},
    "class": {".py": r"^\s*class\s+\w+", ".js": r"^\s*(export\s+)?class\s+\w+"},
}
STOPS = {
    "function": {".py": r"^\s*((async\s+)?def|class)\s", ".js": r"^\s*(export\s+)?((async\s+)?function|class)\s|^(export\s+)?(const|let|var)\s"},
    "class": {".py": r"^\s*class\s", ".js": r"^\s*(export\s+)?class\s"},
}


def split(files: DataFrame, kind: str) -> DataFrame:
    """(file_id, start_line, end_line, content) of functions or classes, told by their first lines alone.

    files: file_id, path, content. A chunk reaches to the line before the next beginning, else to the end of the file.
    For .py, .js and .ts; a text without such lines gives none (callers fall back to windows).
    """
    ext = text.extension(F.col("path"))
    family = F.when(ext == ".py", ".py").when(ext.isin(".js", ".ts"), ".js")
    rows = files.select("file_id", family.alias("family"), text.lines(F.col("content")).alias("lines")).where("family IS NOT NULL AND lines IS NOT NULL")

    def test(table: dict[str, str]) -> Column:
        return F.when(F.col("family") == ".py", F.col("line").rlike(table[".py"])).otherwise(F.col("line").rlike(table[".js"]))

    marked = rows.select("file_id", "family", F.size("lines").alias("size"), F.posexplode("lines").alias("at", "line")).where(test(STOPS[kind]) | test(STARTS[kind]))
    following = Window.partitionBy("file_id").orderBy("at")
    spans = (
        marked.withColumn("next", F.lead("at").over(following))
        .where(test(STARTS[kind]))
        .select("file_id", (F.col("at") + 1).alias("start_line"), F.coalesce("next", "size").alias("end_line"))
    )
    return spans.join(rows.select("file_id", "lines"), "file_id").select(
        "file_id", "start_line", "end_line", F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("content")
    )


def for_embedding(content: Column, language: Column, path: Column, kind: Column) -> Column:
    """A chunk as the text that is embedded: what it is, an empty line, its content."""
    lines = F.split(content, "\n")
    class_line = F.try_element_at(F.filter(lines, lambda x: x.contains("class ") & x.contains(":")), F.lit(1))
    fn_line = F.try_element_at(F.filter(lines, lambda x: (x.contains("def ") | x.contains("function ")) & x.contains("(")), F.lit(1))
    after = lambda line, word: F.split_part(line, F.lit(word), F.lit(2))
    class_name = F.trim(F.split_part(F.split_part(after(class_line, "class "), F.lit("("), F.lit(1)), F.lit(":"), F.lit(1)))
    fn_name = F.trim(F.split_part(F.when(fn_line.contains("def "), after(fn_line, "def ")).otherwise(after(fn_line, "function ")), F.lit("("), F.lit(1)))
    label = F.when(kind.isin("class", "function", "header"), kind).otherwise("code")
    name = F.when((kind == "class") & (class_name != ""), F.concat(F.lit("CLASS: "), class_name, F.lit("\n"))).when(
        (kind == "function") & (fn_name != ""), F.concat(F.lit("FUNCTION: "), fn_name, F.lit("\n"))
    )
    return F.concat(
        F.lit("LANGUAGE: "), F.coalesce(language, F.lit("unknown")), F.lit("\nFILE: "), F.coalesce(path, F.lit("")), F.lit("\nTYPE: "), label, F.lit("\n"),
        F.coalesce(name, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")),
    )


def file_chunks(files: DataFrame) -> DataFrame:
    """(file_id, pos, kind, start_line, end_line, content): class and function chunks of each file by their first lines,
    classes before functions that begin on the same line; sliding windows for files that have neither.

    files: file_id, path, content, one row per file; null and empty texts have none. pos counts from 0.
    """
    cut_up = split(files, "class").withColumn("kind", F.lit("class")).unionByName(split(files, "function").withColumn("kind", F.lit("function")))
    rest = files.where("content <> ''").join(cut_up.select("file_id").distinct(), "file_id", "left_anti")
    both = cut_up.unionByName(window_chunks(rest).withColumn("kind", F.lit("code_segment")))
    order = Window.partitionBy("file_id").orderBy("start_line", "kind", "end_line")
    return both.select("file_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "start_line", "end_line", "content")


def dispatched(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_id, kind, start_line, end_line, content): header and entity chunks of the files that have entities and a
    language with structure (.py, .js, .java), windows for all others. One row per file in `files`."""
    known = text.extension(F.col("path")).isin(".py", ".js", ".java")
    src = files.where("content <> ''").select("file_id", "content", known.alias("known"))
    whole = src.where("known").join(entities.where("start_line > 0").select("file_id").distinct(), "file_id", "left_semi").select("file_id", "content")
    rest = src.join(whole.select("file_id"), "file_id", "left_anti")
    cols = ["file_id", "kind", "start_line", "end_line", "content"]
    return (
        header_chunks(whole, entities).withColumn("kind", F.lit("header")).select(cols)
        .unionByName(entity_chunks(whole, entities, "entity").withColumn("kind", F.lit("entity")).select(cols))
        .unionByName(window_chunks(rest).withColumn("kind", F.lit("window")).select(cols))
    )


# Fields that every stored vector has, and those that it has where they hold something.
MANDATORY = ("file_path", "language", "entity_type", "entity_id", "start_line", "end_line", "chunk_id")
OPTIONAL = ("repository", "branch", "commit_id")


def metadata_text() -> Column:
    """The metadata of a vector row as sorted name=value pairs: mandatory fields (empty where null), optional fields that hold
    something, and the entries of extra."""
    must = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in MANDATORY]
    may = [F.when(F.col(c) != "", F.concat(F.lit(f"{c}="), F.col(c))) for c in OPTIONAL]
    more = F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(F.concat(F.array_compact(F.array(*must, *may)), F.coalesce(more, F.array().cast("array<string>")))), "|")
