"""Problem 4: the k most similar vectors of every vector, by a hierarchical k-means tree.

The upper level of the tree is fitted on a bounded sample (SAMPLE vectors, however many there are) and cuts the space
into at most MOST_CELLS cells; a cell that holds more than two times CELL vectors is divided once more by centres fitted
where its vectors are, on a bounded sample of each such cell (SPLIT_SAMPLE), into at most SPLIT cells. The centres of all
cells (at most MOST_CELLS x SPLIT) are one table that every task has. Every vector is stored in the cell of its nearest
centre. A query visits its own cell and each further cell whose centre is almost as similar to it. Visitors of a cell are
candidates there as well, so a pair is met in any cell that both visit. How far "almost" reaches is calibrated on just
that: the true neighbours of PROBED query vectors, which the centres were not fitted on, are found by one exact pass over
all vectors, and the margin is widened until RECALL of these pairs meet. Inside a cell the vectors are divided by a tree
again, and the number of leaves that a query visits there grows until exact search in that cell confirms the recall. A
visitor takes from a cell only what is as similar as FLOOR_AT of the true neighbours are (what is less similar is not
among its nearest, and would be most of what is shuffled); its own cell gives it its k best in any case. Pairs that this
leaves out count as not met in the calibration. Visitors carry half precision: a pair met only by a visit has its
similarity to about 1e-3, pairs of one cell in double precision.

Exact copies of one vector, of which there may be any number, count as HOT + 1 index rows at most: with k + 1 smallest
ids of a vector in the index, further copies cannot enter any list, and their own lists are read off their class.

Unusable vectors (null, other length, null, NaN or infinite elements, all zero) neither ask nor answer. Of an id with
several rows the one with the greatest indexed_at counts (null is the least; ties: the greatest hash of the vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.tables import cut

#: Bounds of what is fitted or calibrated on the driver, and the intended size of a cell and of a leaf.
SAMPLE, PROBED, CELL, LEAF, BRANCH, LEAST_CELLS, MOST_CELLS = 32_768, 256, 18_000, 160, 64, 24, 4_096
#: Vectors of which the centres of one overfull cell are fitted, and cells that it is divided into at most.
SPLIT_SAMPLE, SPLIT = 2_048, 64
#: Recall to which the margin between cells is widened (the visits within a cell lose a third of what is left of it), and
#: share of true neighbours that are less similar than what a visitor takes.
RECALL, FLOOR_AT = 0.99, 0.0025
#: More equal copies than this of one vector are taken out of the index and answered from their class.
HOT = 64
#: What a row of a cell is: stored there, a question in another piece of the cell that it is stored in, one from another cell.
MEMBER, HERE, VISITOR = 0, 1, 2


def unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def centres_of(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit rows; a centre without members is dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        c = np.add.reduceat(x[order], at, axis=0)
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.maximum(norm, 1e-12)
    return c.astype(np.float32)


class Tree:
    """Inner nodes are rows of `inner` (centres and child numbers); a child >= 0 is an inner node, else leaf -child-1."""

    def __init__(self, x: np.ndarray, leaf: int, branch: int = BRANCH, fit: int = 4_096):
        self.inner: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves = 0
        self.table: np.ndarray | None = None
        self.leaf, self.branch, self.fit = leaf, branch, fit
        self.root = self._grow(x)

    def _grow(self, x: np.ndarray) -> int:
        if len(x) <= self.leaf:
            self.leaves += 1
            return -self.leaves
        want = min(self.branch, -(-2 * len(x) // self.leaf))  # leaves are half full on average; only what is above is split again
        some = x[:: max(1, len(x) // self.fit)]
        c = centres_of(some, min(want, len(some)))
        near = np.argmax(x @ c.T, axis=1)
        if len(c) < 2 or np.bincount(near).max() == len(x):  # nothing to divide
            self.leaves += 1
            return -self.leaves
        me = len(self.inner)
        self.inner.append((c, np.zeros(len(c), dtype=np.int64)))
        for i in range(len(c)):
            self.inner[me][1][i] = self._grow(x[near == i])
        return me

    def divide(self, leaf: int, centres: np.ndarray) -> None:
        """Put an inner node with these centres in the place of a leaf; its first child keeps the leaf's number."""
        children = np.array([-leaf - 1, *(-self.leaves - 1 - i for i in range(len(centres) - 1))], dtype=np.int64)
        self.leaves += len(centres) - 1
        self.table = None
        node = len(self.inner)
        if self.root == -leaf - 1:
            self.root = node
        else:
            for _, kids in self.inner:
                kids[kids == -leaf - 1] = node
        self.inner.append((centres.astype(np.float32), children))

    def centres(self) -> np.ndarray:
        """The centre of each leaf."""
        if self.table is None:
            self.table = np.zeros((self.leaves, self.inner[0][0].shape[1]), dtype=np.float32)
            for centres, kids in self.inner:
                self.table[-kids[kids < 0] - 1] = centres[kids < 0]
        return self.table

    def visit(self, q: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of each query in the order of their centres' similarity, and these similarities."""
        n, visits = len(q), min(visits, self.leaves)
        leaves, scores = np.zeros((n, visits), dtype=np.int64), np.ones((n, visits), dtype=np.float32)
        if self.root < 0:
            return leaves, scores
        step = max(64, (1 << 22) // self.leaves)
        for i in range(0, n, step):
            s = q[i : i + step] @ self.centres().T
            best = np.argpartition(-s, visits - 1, axis=1)[:, :visits] if visits < self.leaves else np.broadcast_to(np.arange(self.leaves), s.shape)
            near = np.take_along_axis(s, best, axis=1)
            order = np.argsort(-near, axis=1, kind="stable")
            leaves[i : i + step], scores[i : i + step] = np.take_along_axis(best, order, axis=1), np.take_along_axis(near, order, axis=1)
        return leaves, scores


def exact(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    s = q @ x.T
    k = min(k, x.shape[0])
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def search_cell(x: np.ndarray, at_home: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of x and of others: about the k + 3 best of each row, of rows not at home those above the floor only.

    The leaf nearest to a row gives it a bar; from further leaves only what passes the bar is kept.
    """
    keep = k + 3
    tree = Tree(x, 2 * LEAF)
    home = tree.visit(x, 1)[0][:, 0]
    order = np.argsort(home, kind="stable")
    begin = np.searchsorted(home[order], np.arange(tree.leaves + 1))
    asked = np.arange(0, len(x), max(1, len(x) // 128))
    truth, seen = exact(x[asked], x, k + 1), tree.visit(x[asked], tree.leaves)[0]
    rank = np.empty_like(seen)
    np.put_along_axis(rank, seen, np.arange(tree.leaves)[None, :], axis=1)
    rank = np.take_along_axis(rank, home[truth], axis=1) + 1
    other = truth != asked[:, None]
    counts = other & (np.einsum("nd,nkd->nk", x[asked], x[truth]) >= floor)
    ranks = rank[counts] if counts.any() else rank[other]
    visits = min(tree.leaves, max(2, int(np.quantile(ranks, 1 - (1 - RECALL) / 3, method="higher")))) if len(ranks) else tree.leaves
    leaves = tree.visit(x, visits)[0]
    bar = np.where(at_home, -2.0, floor).astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in (True, False):
        flat = (leaves[:, :1] if first else leaves[:, 1:]).ravel()
        wide = 1 if first else leaves.shape[1] - 1
        turn = np.argsort(flat, kind="stable")
        edge = np.searchsorted(flat[turn], np.arange(tree.leaves + 1))
        for leaf in range(tree.leaves):
            members, rows = order[begin[leaf] : begin[leaf + 1]], turn[edge[leaf] : edge[leaf + 1]] // max(1, wide)
            if not len(members):
                continue
            for part in range(0, len(rows), 2_048):
                r = rows[part : part + 2_048]
                s = x[r] @ x[members].T
                if first and len(members) > keep:
                    bar[r] = np.maximum(bar[r], np.partition(s, len(members) - keep, axis=1)[:, len(members) - keep])
                at, col = np.nonzero(s >= bar[r][:, None])
                found.append((r[at], members[col], s[at, col]))
    row, col, score = (np.concatenate(v) for v in zip(*found))
    by = np.lexsort((-score, row))
    row, col = row[by], col[by]
    start = np.searchsorted(row, np.arange(len(x)))
    near = np.arange(len(row)) - start[row] < keep
    return row[near], col[near]


def packed(id_: Column) -> Column:
    """An id as bytes: 32 hex digits become 16 bytes behind a 1, any other text its UTF-8 behind a 0."""
    return F.when(id_.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(b"\x01"), F.unhex(id_))).otherwise(
        F.concat(F.lit(b"\x00"), F.encode(id_, "UTF-8"))
    )


def unpacked(data: Column) -> Column:
    rest = F.substring(data, 2, 1 << 30)
    return F.when(F.substring(data, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def text_of(data: bytes) -> str:
    return data[1:].hex() if data[:1] == b"\x01" else data[1:].decode("utf-8", "replace")


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float32).reshape(-1, dim)


def rows_of(column: pa.Array, kind: type, dim: int) -> np.ndarray:
    """The vectors that a column of byte strings of one length holds."""
    if not len(column):
        return np.zeros((0, dim), dtype=np.float32)
    width = dim * np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[column.offset * width : (column.offset + len(column)) * width]
    return data.view(kind).reshape(-1, dim)


def as_bytes(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def neighbours(vectors: DataFrame, k: int = 5, dim: int = 64, id_: str = "id", newest: str = "indexed_at") -> DataFrame:
    """(id, neighbour, similarity, rank): up to k most similar other ids of every id with a usable vector.

    Similarity is the cosine in double precision; equal similarities (to 12 digits) go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_).isNotNull()).select(
        packed(F.col(id_)).alias("id"), F.col(newest).alias("ts"), "vector", F.xxhash64("vector").alias("h")
    )
    rows = rows.withColumn("ok", usable(F.col("vector"), dim))
    # narrow facts about every id: its current row, and whether there are others
    facts = cut(
        rows.groupBy("id")
        .agg(F.max(F.struct("ts", "h", "ok")).alias("now"), F.count(F.lit(1)).alias("n"))
        .select("id", "now.ts", "now.h", "now.ok", "n")
    )
    total = facts.where("ok").count()
    again = facts.where("n > 1").select("id", F.col("ts").alias("ts_now"), F.col("h").alias("h_now"))
    few = again.count() * 64 < 48 << 20
    again = F.broadcast(again) if few else again
    current = (
        rows.where("ok")
        .join(again, "id", "left")
        .where("h_now IS NULL OR (h = h_now AND ts <=> ts_now)")
        .select("id", "h", "vector")
    )

    # copies of one vector beyond HOT: k + 1 smallest ids stay in the index
    classes = facts.where("ok").groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > HOT)
    hot = [] if total == 0 else classes.limit(1).collect()
    extra = None
    if hot:
        members = facts.where("ok").select("id", "h").join(classes.select("h"), "h")
        salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        name = unpacked(F.col("id"))
        near = salted.withColumn("r", F.row_number().over(Window.partitionBy("h", "salt").orderBy(name))).where(F.col("r") <= k + 1)
        first = cut(near.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(name))).where(F.col("r") <= k + 1).select("h", "id", "r"))
        others = members.join(first.select("id"), "id", "left_anti")
        extra = others.join(first.where(F.col("r") <= k).select("h", F.col("id").alias("nid"), "r"), "h").select(
            "id", F.col("nid").alias("neighbour"), F.lit(1.0).alias("similarity"), F.col("r").alias("rank")
        )
        current = current.join(others.select("id"), "id", "left_anti")

    if total == 0:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    tree, (margin, floor), visits, pieces = fitted(current, total, k, dim)
    shared = spark.sparkContext.broadcast((tree, margin, visits, pieces))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, margin, visits, pieces = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vecs = batch.column("id"), batch.column("vector")
            x = unit(matrix(vecs, dim))
            leaves, scores = tree.visit(x, visits)
            near = scores >= scores[:, :1] - margin
            row, slot = np.nonzero(near)
            cell = leaves[row, slot]
            # a cell that the sample shows to be large lies in several pieces; members are in one, questions in each
            many = pieces[cell]
            row, slot, cell = (np.repeat(v, many) for v in (row, slot, cell))
            part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            mine = np.asarray(batch.column("h"), dtype=np.int64).astype(np.uint64)[row] % pieces[cell].astype(np.uint64)
            member = (slot == 0) & (part == mine.astype(np.int64))
            number = np.concatenate([[0], np.cumsum(pieces)])[cell] + part
            role = np.where(member, MEMBER, np.where(slot == 0, HERE, VISITOR)).astype(np.int8)
            for own in (True, False):  # members keep their vector; a question elsewhere carries half precision
                pick = member == own
                take = pa.array(row[pick])
                data = matrix(vecs, dim)[row[pick]] if own else x[row[pick]].astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[pick], pa.int32()), pa.array(role[pick]), ids.take(take), as_bytes(data)],
                    ["cell", "role", "id", "vector"],
                )

    def answer(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        data = table.column("vector").combine_chunks()
        role = np.asarray(table.column("role"))
        if not (role == MEMBER).any():
            return pa.table({"id": pa.array([], pa.binary()), "entries": pa.array([], pa.list_(pa.binary()))})
        # a repeated row counts once; all in the order of their ids, so that equal similarities go to the smaller id
        _, at = np.unique([text_of(b) for b in ids.to_pylist()], return_index=True)
        role = role[at]
        mine = role == MEMBER
        raw = np.empty((len(at), dim), dtype=np.float32)
        raw[mine] = rows_of(data.take(pa.array(at[mine])), np.float32, dim)
        raw[~mine] = rows_of(data.take(pa.array(at[~mine])), np.float16, dim)
        # visitors are candidates too: a pair is met where any cell is visited by both
        x, norm = np.empty_like(raw), np.empty(len(raw))
        for s in range(0, len(raw), 16_384):
            wide = raw[s : s + 16_384].astype(np.float64)
            norm[s : s + 16_384] = np.linalg.norm(wide, axis=1)
            x[s : s + 16_384] = wide / norm[s : s + 16_384, None]
        row, best = search_cell(x, role != VISITOR, k, floor)
        sims = np.empty(len(row))
        for s in range(0, len(row), 16_384):
            a, b = row[s : s + 16_384], best[s : s + 16_384]
            sims[s : s + 16_384] = np.einsum("nd,nd->n", raw[a].astype(np.float64) / norm[a, None], raw[b].astype(np.float64) / norm[b, None])
        sims = np.round(sims, 12)
        other = best != row
        row, best, sims = row[other], best[other], sims[other]
        by = np.lexsort((best, -sims, row))
        row, best, sims = row[by], best[by], sims[by]
        start = np.searchsorted(row, np.arange(len(at)))
        near = np.arange(len(row)) - start[row] < k
        row, best, sims = row[near], best[near], sims[near]
        # an entry is the distance in units of 1e-12, as six bytes that sort like the number, and the id
        far = np.round((1.0 - sims) * 1e12).astype(np.int64).clip(0)
        key = as_bytes(np.ascontiguousarray(far.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]))
        entries = pc.binary_join_element_wise(key, ids.take(pa.array(at[best])), pa.scalar(b"", pa.binary()))
        some = np.unique(row)  # who found nothing here has no list
        ends = np.append(np.searchsorted(row, some), len(row)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), entries)
        return pa.table({"id": ids.take(pa.array(at[some])), "entries": lists})

    placed = current.select("id", "h", "vector").mapInArrow(place, "cell int, role tinyint, id binary, vector binary")
    partial = placed.groupBy("cell").applyInArrow(answer, "id binary, entries array<binary>")
    # the lists of a query, from the cells that it visits, are merged: entries sort by distance, then by id;
    # of a neighbour met in several cells the nearest entry stays
    distance = F.conv(F.hex(F.substring("e", 1, 6)), 16, 10).cast("double") / 1e12
    name = lambda e: F.substring(e, 7, 1 << 30)
    once = F.filter("z", lambda e, i: ~F.exists(F.slice("z", F.lit(1), i), lambda o: name(o) == name(e)))
    found = (
        partial.groupBy("id")
        .agg(F.flatten(F.collect_list("entries")).alias("z"))
        .select("id", F.sort_array("z").alias("z"))
        .select("id", F.posexplode(F.slice(once, 1, k)).alias("p", "e"))
        .select("id", name(F.col("e")).alias("neighbour"), (1 - distance).alias("similarity"), (F.col("p") + 1).alias("rank"))
    )
    return found.unionByName(extra) if extra is not None else found


def divided(current: DataFrame, tree: Tree, sizes: np.ndarray, dim: int) -> None:
    """Divide each cell of the tree whose expected size is more than two times CELL, by centres fitted on some of its vectors."""
    large = np.flatnonzero(sizes > 2 * CELL)
    if not len(large):
        return
    want = np.zeros(tree.leaves, dtype=np.int64)
    want[large] = np.clip(np.ceil(sizes[large] / CELL), 2, SPLIT).astype(np.int64)
    shared = current.sparkSession.sparkContext.broadcast((tree, want, np.minimum(1.0, SPLIT_SAMPLE / np.maximum(sizes, 1))))

    def some_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, want, share = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = tree.visit(unit(matrix(batch.column("vector"), dim)), 1)[0][:, 0]
            # by the vector's own hash, so that a task that runs again picks the same ones
            drawn = (np.asarray(batch.column("h"), dtype=np.int64).astype(np.uint64) % np.uint64(1 << 32)).astype(np.float64) / (1 << 32)
            pick = np.flatnonzero((want[cell] > 0) & (drawn < share[cell]))
            yield pa.RecordBatch.from_arrays([pa.array(cell[pick], pa.int32()), batch.column("vector").take(pa.array(pick))], ["cell", "vector"])

    def fit(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        x = unit(matrix(table.column("vector"), dim))
        # by the directions in which the vectors lie off their middle, all equally far from it: in a dense cell a centre in
        # the middle would be nearest to every vector
        x = x[np.lexsort(x.T[:4])]
        off = x - x.mean(axis=0)
        apart = np.linalg.norm(off, axis=1) > 1e-6
        ways = centres_of(unit(off[apart]), min(int(shared.value[1][cell]), int(apart.sum()))) if apart.any() else off[:0]
        ways = ways[np.linalg.norm(ways, axis=1) > 0.5]
        reach = float((off @ ways.T).max(axis=1).mean()) if len(ways) else 0.0
        centres = unit(x.mean(axis=0) + reach * ways) if len(ways) else ways
        return pa.table({"cell": pa.array([cell], pa.int32()), "centres": pa.array([centres.astype(np.float32).tobytes()], pa.binary())})

    found = current.select("h", "vector").mapInArrow(some_of, "cell int, vector array<float>").groupBy("cell").applyInArrow(fit, "cell int, centres binary")
    for row in sorted(found.collect(), key=lambda r: r["cell"]):  # at most MOST_CELLS rows of SPLIT centres
        centres = np.frombuffer(row["centres"], dtype=np.float32).reshape(-1, dim)
        if len(centres) > 1:
            tree.divide(row["cell"], centres)


def fitted(current: DataFrame, total: int, k: int, dim: int) -> tuple[Tree, tuple[float, float], int, np.ndarray]:
    """The tree over cells, the calibrated margin between cells and floor of visitors, the most visits, and each cell's pieces.

    A cell is laid in pieces only where it holds too much even after it was divided, as nearly equal vectors do.
    """
    some = np.asarray(current.sample(min(1.0, SAMPLE / total), seed=11).select("vector").limit(2 * SAMPLE).toPandas()["vector"].tolist(), dtype=np.float32)
    if not len(some):
        some = np.asarray(current.select("vector").limit(SAMPLE).toPandas()["vector"].tolist(), dtype=np.float32)
    some = unit(some.reshape(-1, dim))
    asked = some[:: max(1, len(some) // PROBED)][:PROBED]
    if len(some) > 8 * PROBED:  # the centres lie nearer to what they were fitted on than to the rest
        some = np.delete(some, np.arange(0, len(some), len(some) // PROBED)[:PROBED], axis=0)
    cells = min(MOST_CELLS, max(LEAST_CELLS, -(-total // CELL)), max(1, len(some) // 8))
    tree = Tree(some, -(-2 * len(some) // cells), branch=max(BRANCH, cells), fit=SAMPLE)
    expected = lambda: np.bincount(tree.visit(some, 1)[0][:, 0], minlength=tree.leaves) / len(some) * total
    divided(current, tree, expected(), dim)
    pieces = np.maximum(1, np.ceil(expected() / (4 * CELL))).astype(np.int64)
    shared = current.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        top, vecs = np.full((len(asked), k + 1), -2.0, dtype=np.float32), np.zeros((len(asked), k + 1, dim), dtype=np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("vector"), dim))
            near = exact(asked, x, k + 1)
            s = np.concatenate([top, np.take_along_axis(asked @ x.T, near, axis=1)], axis=1)
            v = np.concatenate([vecs, x[near]], axis=1)
            keep = np.argsort(-s, axis=1)[:, : k + 1]
            top, vecs = np.take_along_axis(s, keep, axis=1), np.take_along_axis(v, keep[:, :, None], axis=1)
        q, _ = np.nonzero(top > -2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(top[top > -2]), pa.array(list(vecs[top > -2]), pa.list_(pa.float32()))], ["q", "s", "vector"]
        )

    lists = current.select("vector").mapInArrow(nearest, "q int, s float, vector array<float>")
    by = Window.partitionBy("q").orderBy(F.desc("s"))
    # the best of a probed vector is itself, or one equal to it
    true = lists.withColumn("r", F.row_number().over(by)).where((F.col("r") > 1) & (F.col("r") <= k + 1)).select("q", "s", "vector").toPandas()
    if not len(true):
        return tree, (0.0, -2.0), 1, pieces
    floor = float(np.quantile(true["s"], FLOOR_AT, method="lower")) - 2e-3  # halves are that exact
    everywhere = lambda x: x @ tree.centres().T if tree.root >= 0 else np.ones((len(x), 1), dtype=np.float32)
    need = np.empty(len(true))
    theirs = np.asarray(true["vector"].tolist(), dtype=np.float32).reshape(-1, dim)
    for i in range(0, len(true), 64):
        a, b = everywhere(asked[true["q"].to_numpy()[i : i + 64]]), everywhere(theirs[i : i + 64])
        a, b = a.max(axis=1, keepdims=True) - a, b.max(axis=1, keepdims=True) - b
        # two vectors meet in the cell that both of them reach first
        need[i : i + 64] = np.maximum(a, b).min(axis=1)
    need[(need > 0) & (true["s"].to_numpy() < floor)] = 4.0
    margin = float(np.quantile(need, RECALL, method="higher"))
    # as many visits as any of these vectors has cells within the margin
    visits = 1
    for i in range(0, len(true), 64):
        for x in (asked[i : i + 64], theirs[i : i + 64]):
            if len(x):
                s = everywhere(x)
                visits = max(visits, int((s >= s.max(axis=1, keepdims=True) - margin).sum(axis=1).max()))
    return tree, (margin, floor), visits, pieces


def neighbour_pairs(vectors: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: pairs of which one is among the k most similar of the other."""
    found = neighbours(vectors, k, dim)
    if found.schema["id"].dataType.typeName() == "string":
        return found.select(F.col("id").alias("chunk_id_a"), F.col("neighbour").alias("chunk_id_b"))
    x, y = unpacked(F.col("id")), unpacked(F.col("neighbour"))
    return (
        found.select(F.when(x < y, F.col("id")).otherwise(F.col("neighbour")).alias("a"), F.when(x < y, F.col("neighbour")).otherwise(F.col("id")).alias("b"))
        .distinct()
        .select(unpacked(F.col("a")).alias("chunk_id_a"), unpacked(F.col("b")).alias("chunk_id_b"))
    )
