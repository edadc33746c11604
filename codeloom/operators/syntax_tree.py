"""Syntax trees as flat node tables, and the entities read off them.

Python files are parsed by the interpreter's own parser in Arrow batches, one row per node with its parent, depth and
place; everything after that is plain columns. A file that does not parse gives one row of type error.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "file_id string, node_id bigint, parent_id bigint, ordinal int, depth int, type string, text string, start_row int, end_row int"
#: Names under which a node carries its text.
_TEXT = ("name", "id", "attr", "module", "arg")


def _walk(file: str, content: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            root = ast.parse(content.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(file, 0, None, 0, 0, "error", str(e), None, None)]
    rows: list[tuple] = []
    stack: list[tuple[ast.AST, int | None, int, int]] = [(root, None, 0, 0)]
    while stack:
        node, parent, ordinal, depth = stack.pop()
        me = len(rows)
        text = next((v for n in _TEXT if isinstance(v := getattr(node, n, None), str)), None)
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            text = node.value
        rows.append((file, me, parent, ordinal, depth, type(node).__name__, text, getattr(node, "lineno", None), getattr(node, "end_lineno", None)))
        children = [c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]
        stack += [(c, me, i, depth + 1) for i, c in reversed(list(enumerate(children)))]
    return rows


def python_nodes(files: DataFrame) -> DataFrame:
    """Node rows of files (file_id, content) in Python; null texts have none. node_id counts in preorder from 0."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        for batch in batches:
            rows = [r for f, c in zip(batch["file_id"], batch["content"]) if c is not None for r in _walk(f, c)]
            yield pd.DataFrame(rows, columns=names).astype({"parent_id": "Int64", "start_row": "Int32", "end_row": "Int32"})

    return files.select("file_id", "content").mapInPandas(parse, NODES)


def definitions(nodes: DataFrame) -> DataFrame:
    """(file_id, kind, name, start_row, end_row) of functions and classes."""
    kind = F.when(F.col("type").isin("FunctionDef", "AsyncFunctionDef"), "function").when(F.col("type") == "ClassDef", "class")
    return nodes.withColumn("kind", kind).where("kind IS NOT NULL").select("file_id", "kind", F.col("text").alias("name"), "start_row", "end_row")


def call_names(nodes: DataFrame) -> DataFrame:
    """(file_id, call_name, is_attribute_call, start_row): the name called, of a.b.c() the last part."""
    calls = nodes.where("type = 'Call'").select("file_id", F.col("node_id").alias("parent_id"), F.col("start_row"))
    target = nodes.where("ordinal = 0 AND type IN ('Name', 'Attribute')").select("file_id", "parent_id", "type", F.col("text").alias("call_name"))
    return calls.join(target, ["file_id", "parent_id"]).select("file_id", "call_name", (F.col("type") == "Attribute").alias("is_attribute_call"), "start_row")


def imported(nodes: DataFrame) -> DataFrame:
    """(file_id, module_name, import_name): import a as b and from m import a, one row per name."""
    heads = nodes.where("type IN ('Import', 'ImportFrom')").select("file_id", F.col("node_id").alias("parent_id"), "type", F.col("text").alias("module"))
    names = nodes.where("type = 'alias'").select("file_id", "parent_id", F.col("text").alias("import_name"))
    return heads.join(names, ["file_id", "parent_id"]).select(
        "file_id", F.when(F.col("type") == "Import", F.col("import_name")).otherwise(F.col("module")).alias("module_name"), "import_name"
    )
