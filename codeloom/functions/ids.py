"""Identity rules: md5 over parts joined by ':' (null parts as '')."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column) -> Column:
    columns = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat(*[x for c in columns for x in (F.lit(":"), c)][1:]))


def file_id(repository: Column, path: Column) -> Column:
    return joined(repository, path)


def class_id(file: Column, name: Column) -> Column:
    return joined(file, name)


def function_id(file: Column, name: Column, class_: Column | None = None) -> Column:
    """With a class the method keeps its own id; without one, same names in a file collapse."""
    return joined(file, name) if class_ is None else joined(file, name, class_)


def call_site_id(file: Column, name: Column, line: Column) -> Column:
    return joined(file, name, line)


def chunk_id(file: Column, start: Column, end: Column, kind: Column) -> Column:
    return joined(file, start, end, kind)
