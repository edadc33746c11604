"""Vector collections: exact similarity search in blocks, and the filter algebra.

Both sides are cut into blocks; a task scores one block of queries against one block of vectors with one matrix
product and passes on k rows per query, and the k best of all blocks are kept. No pair is ever a row, and neither
side is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of a block of queries.
BLOCK, QUERIES = 20_000, 4_000
METRICS = ("cosine", "l2", "ip")


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Similarities, greater is nearer: cosine, inner product, or the distance with its sign turned."""
    if metric == "ip":
        return q @ x.T
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(x, axis=1, keepdims=True)
        return (q / np.where(nq == 0, 1, nq)) @ (x / np.where(nx == 0, 1, nx)).T
    squares = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T
    return -np.sqrt(np.maximum(squares, 0))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", id_type: str = "bigint") -> DataFrame:
    """(query_id, id, score, rank): the k best vectors of each query; ties (6 digits) to the smallest id.

    queries: query_id, vector; vectors: id, vector; both of one length. Rows without a vector are left out. score is
    the cosine, the inner product, or for l2 the distance (smaller is nearer).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    v = vectors.where("vector IS NOT NULL").select(F.col("id").cast(id_type).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    q = queries.where("vector IS NOT NULL").select(F.col("query_id").cast(id_type).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    nv, nq = max(1, -(-v.count() // BLOCK)), max(1, -(-q.count() // QUERIES))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("vb", grid(nv)).withColumn("asks", F.lit(True))
    right = v.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int")).withColumn("qb", grid(nq)).withColumn("asks", F.lit(False))
    cells = left.select("qb", "vb", "asks", "id", "vector").unionByName(right.select("qb", "vb", "asks", "id", "vector"))
    kind = "long" if id_type == "bigint" else "string"

    def best(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        ids = np.asarray(table.column("id").to_pylist(), dtype=np.int64 if kind == "long" else object)
        x = np.asarray(table.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        qi, vi = ids[asks], ids[~asks]
        order = np.argsort(vi, kind="stable")  # so that a stable sort by score leaves ties in the order of ids
        vi = vi[order]
        out_q, out_v, out_s = [], [], []
        if len(vi):
            s = np.round(scores(x[asks], x[~asks][order], metric), 6)
            for part in range(0, len(qi), 512):
                near = np.argsort(-s[part : part + 512], axis=1, kind="stable")[:, :k]
                out_q.append(np.repeat(qi[part : part + 512], near.shape[1]))
                out_v.append(vi[near].ravel())
                out_s.append(np.take_along_axis(s[part : part + 512], near, axis=1).ravel())
        t = pa.int64() if kind == "long" else pa.string()
        join = lambda v, d: np.concatenate(v) if v else np.array([], dtype=d)
        return pa.table({"query_id": pa.array(join(out_q, ids.dtype), t), "id": pa.array(join(out_v, ids.dtype), t), "score": pa.array(join(out_s, np.float64), pa.float64())})

    found = cells.groupBy("qb", "vb").applyInArrow(best, f"query_id {id_type}, id {id_type}, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.round(-F.col("score") if metric == "l2" else F.col("score"), 6) + F.lit(0.0))


def condition(filters: Mapping | None, strict: bool = False) -> Column | None:
    """A filter as a predicate that Spark can push down; None where it asks for nothing.

    Flat: {field: value} all equal, a list means one of. Tree: {operator, field, value} with ==, !=, in, range (any of
    gt, gte, lt, lte), or {operator: and/or, conditions: [...]}. Empty lists and, unless strict, unknown operators ask
    for nothing.
    """
    if not filters:
        return None
    if "operator" not in filters:
        parts = [_in(F.col(f), v) if isinstance(v, (list, tuple, set)) else F.col(f) == F.lit(v) for f, v in filters.items()]
        return _fold([p for p in parts if p is not None], lambda a, b: a & b)
    op, field, value = filters["operator"], filters.get("field"), filters.get("value")
    if op in ("and", "or"):
        parts = [p for c in filters.get("conditions", []) if (p := condition(c, strict)) is not None]
        return _fold(parts, (lambda a, b: a & b) if op == "and" else (lambda a, b: a | b))
    if op == "==":
        return F.col(field) == F.lit(value)
    if op == "!=":
        return F.col(field) != F.lit(value)
    if op == "in":
        return _in(F.col(field), value)
    if op == "range":
        c, v = F.col(field), filters.get("value") or filters
        tests = {"gt": lambda x: c > x, "gte": lambda x: c >= x, "lt": lambda x: c < x, "lte": lambda x: c <= x}
        return _fold([tests[n](F.lit(v[n])) for n in tests if v.get(n) is not None], lambda a, b: a & b)
    if strict:
        raise ValueError(f"unknown operator {op!r}")
    return None


def _in(column: Column, values) -> Column | None:
    values = list(values or [])
    return column.isin(values) if values else None


def _fold(parts: list[Column], join) -> Column | None:
    return reduce(join, parts) if parts else None


def where(rows: DataFrame, filters: Mapping | None, strict: bool = False) -> DataFrame:
    test = condition(filters, strict)
    return rows if test is None else rows.where(test)


def expression(filters: Mapping | None) -> str:
    """The same filter as SQL text, for catalogs and logs; '' where it asks for nothing."""

    def quoted(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    def one_of(f: str, values) -> str:
        return f"{f} IN ({', '.join(quoted(v) for v in values)})" if values else ""

    if not filters:
        return ""
    if "operator" not in filters:
        parts = [one_of(f, v) if isinstance(v, (list, tuple)) else f"{f} = {quoted(v)}" for f, v in filters.items()]
        return " AND ".join(p for p in parts if p)
    op, field, value = filters["operator"], filters.get("field"), filters.get("value")
    if op in ("and", "or"):
        parts = [f"({p})" for c in filters.get("conditions", []) if (p := expression(c))]
        return f" {op.upper()} ".join(parts)
    if op in ("==", "!="):
        return f"{field} {'=' if op == '==' else '<>'} {quoted(value)}"
    if op == "in":
        return one_of(field, value)
    if op == "range":
        v = value or filters
        signs = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
        return " AND ".join(f"{field} {s} {quoted(v[n])}" for n, s in signs.items() if v.get(n) is not None)
    return ""
