"""Exact nearest neighbours of many queries among many references, by the cells of a k-d tree.

References and queries are dealt to cells, one shuffle each; a cell's references are searched leaf by leaf, the leaves
whose box may hold something as near. The k nearest of a query's own cell bound it, and it goes on only to the other
cells whose box lies within that bound; for that a cell is kept as a row, its references by leaves. Rows, ties and
distances are those of ``knn.brute``.

The tree is cut from a sample by hash, as where cells lie changes the work and not what is right: every reference
and every query is in a cell. Of references with one vector a cell keeps the k lowest ids, as no other can be among
the k nearest; so a cell holds about CELL rows, however often a vector repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantize import space_of
from ..storage import written
from .knn_kernel import PAIRS, Nearest, matrix

#: References of a cell, about; rows of the sample for each cell; references of a leaf.
CELL, PER_CELL, LEAF = 65_536, 64, 128
#: Leaves that a query meets, nearest first, before the others that it needs are taken leaf by leaf.
FIRST = 3
#: Bounds (query, box) that are held at once, and computed at once.
BOUNDS, NEAR = 1 << 21, 1 << 15

KINDS = {"i8": np.int8, "i16": np.int16, "f32": np.float32, "f64": np.float64}


# ---- trees ---------------------------------------------------------------------------------------

def _cut(x: np.ndarray) -> tuple[int, float] | None:
    """Dimension and value that halve the rows best along their widest dimension: rows up to the value, and those above; None if all are equal."""
    spread = x.var(axis=0)
    d = int(spread.argmax())
    if not spread[d] > 0:
        return None
    col = x[:, d]
    mid = np.partition(col, (len(col) - 1) // 2)[(len(col) - 1) // 2]
    under = col[col < mid]
    if col.max() == mid or len(under) and abs(2 * len(under) - len(col)) < abs(2 * np.count_nonzero(col <= mid) - len(col)):
        return d, float(under.max()) if len(under) else float(mid)
    return d, float(mid)


class Tree:
    """Cells of a sample: dim, cut and the two children of each inner node; cell of each leaf."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.dim, self.cut, self.next, self.cell, self.size = [], [], [], [], 0
        waiting = [(x, None, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            at = len(self.dim)
            if parent is not None:
                self.next[parent][side] = at
            found = _cut(rows) if len(rows) > leaf else None
            below = rows[:, found[0]] <= found[1] if found else None
            if below is None or below.all():
                self.dim.append(-1), self.cut.append(0.0), self.next.append([at, at]), self.cell.append(self.size)
                self.size += 1
                continue
            self.dim.append(found[0]), self.cut.append(found[1]), self.next.append([0, 0]), self.cell.append(-1)
            waiting += [(rows[~below], at, 1), (rows[below], at, 0)]
        self.dim, self.cut, self.next, self.cell = np.array(self.dim), np.array(self.cut), np.array(self.next), np.array(self.cell, np.int32)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = self.dim[node] >= 0
            if not inner.any():
                return self.cell[node]
            at = node[inner]
            node[inner] = self.next[at, (x[rows[inner], self.dim[at]] > self.cut[at]).astype(np.int64)]


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by leaves of up to size rows, and where each leaf begins; equal rows may fill more than one."""
    order, starts, waiting = [], [0], [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        found = _cut(x[rows]) if len(rows) > size else None
        below = x[rows, found[0]] <= found[1] if found else None
        if below is None or below.all():
            for i in range(0, len(rows), size):
                order.append(rows[i : i + size])
                starts.append(starts[-1] + len(order[-1]))
            continue
        waiting += [rows[~below], rows[below]]
    return np.concatenate(order) if order else np.zeros(0, np.int64), np.array(starts)


def lower_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[query, box] least squared distance; terms are added in the order of the distance's own, so rounding can't lift one over it."""
    out = np.zeros((len(q), len(low)))
    step = max(1, NEAR // max(1, len(low)))
    for i in range(0, len(q), step):
        for d in range(q.shape[1]):
            x = q[i : i + step, d, None]
            gap = np.maximum(low[None, :, d] - x, x - high[None, :, d])
            np.maximum(gap, 0, out=gap)
            gap *= gap
            out[i : i + step] += gap
    return out


class Cell:
    """References of one cell, searched by leaves."""

    def __init__(self, x: np.ndarray, ref: np.ndarray, fraud: np.ndarray, integer: bool, starts: np.ndarray | None = None):
        """starts: where leaves begin, of rows that stand by leaves."""
        if starts is None:
            order, starts = _leaves(x.astype(np.float64), LEAF)
            x, ref, fraud = x[order], ref[order], fraud[order]
        self.rows, self.ref, self.fraud, self.starts = x, ref, fraud, starts
        x = x.astype(np.float64)
        self.low, self.high = np.minimum.reduceat(x, self.starts[:-1], axis=0), np.maximum.reduceat(x, self.starts[:-1], axis=0)
        self.integer = integer
        self.x = np.concatenate([-2 * x.T, (x * x).sum(1)[None], np.ones((1, len(x)))]) if integer else np.ascontiguousarray(x.T)

    def _distances(self, q: np.ndarray, leaf: int) -> np.ndarray:
        """[query, row]; of whole numbers in one product, exact as all terms are under 2**53."""
        x = self.x[:, self.starts[leaf] : self.starts[leaf + 1]]
        if self.integer:
            return q @ x
        out = np.zeros((len(q), x.shape[1]))
        for d in range(len(x)):
            diff = x[d] - q[:, d, None]
            diff *= diff
            out += diff
        return out

    def search(self, q: np.ndarray, k: int, at_most: np.ndarray | None = None) -> Nearest:
        """The k nearest of each query, up to the distances at_most, ready to settle."""
        q = q.astype(np.float64)
        nearest = Nearest(len(q), k, at_most)
        own = np.concatenate([q, np.ones((len(q), 1)), (q * q).sum(1)[:, None]], axis=1) if self.integer else q
        best = np.full((len(q), k), np.inf)

        def meet(leaf: int, asked: np.ndarray) -> None:
            dist = self._distances(own[asked], leaf)
            hit = (dist <= nearest.bound[asked, None]).any(axis=1)
            if not hit.any():
                return
            asked, dist = asked[hit], dist[hit]
            best[asked] = np.partition(np.concatenate([best[asked], dist], axis=1), k - 1, axis=1)[:, :k]
            nearest.bound[asked] = np.minimum(nearest.bound[asked], best[asked].max(axis=1))
            query, row = np.nonzero(dist <= nearest.bound[asked, None])
            at = self.starts[leaf] + row
            nearest.held.append((asked[query], dist[query, row], self.ref[at], self.fraud[at]))
            nearest.size += len(at)
            if nearest.size > 4 * nearest.n * k + PAIRS:
                nearest.settle()

        def by_leaf(query: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            if not len(leaf):
                return
            order = np.argsort(leaf, kind="stable")
            leaf, query = leaf[order], query[order]
            edge = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            for i, j in zip(edge, np.append(edge[1:], len(leaf)), strict=True):
                yield int(leaf[i]), query[i:j]

        step = max(1, BOUNDS // len(self.low))
        for i in range(0, len(q), step):
            lower = lower_bounds(q[i : i + step], self.low, self.high)
            rows = np.arange(len(lower))
            for _ in range(min(FIRST, lower.shape[1])):
                leaf = lower.argmin(axis=1)
                near = lower[rows, leaf] <= nearest.bound[i + rows]
                for c, asked in by_leaf(rows[near], leaf[near]):
                    meet(c, i + asked)
                lower[rows, leaf] = np.inf
            lower[~(lower < np.inf)] = np.nan  # met, and no bound reaches it
            query, leaf = np.nonzero(lower <= nearest.bound[i + rows, None])
            for c, asked in by_leaf(query, leaf):
                asked = asked[lower[asked, c] <= nearest.bound[i + asked]]
                if len(asked):
                    meet(c, i + asked)
        return nearest


# ---- rows ----------------------------------------------------------------------------------------

def _packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int64) * width).astype(np.int32)), pa.py_buffer(x)])


def _unpacked(col: pa.Array, kind: type, dims: int) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros((0, dims), kind)
    first = int(np.frombuffer(col.buffers()[1], wide)[col.offset])
    return np.frombuffer(col.buffers()[2], kind, len(col) * dims, first).reshape(-1, dims)


def _lowest(x: np.ndarray, ref: np.ndarray, fraud: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with one vector those with the k lowest ids."""
    x = np.ascontiguousarray(x)
    _, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ref, same))
    same = same[order]
    start = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    keep = order[np.arange(len(same)) - np.repeat(start, np.diff(np.append(start, len(same)))) < k]
    return x[keep], ref[keep], fraud[keep]


def _dealt(rows: DataFrame, tree: Tree, kind: type, key: str) -> DataFrame:
    """cell, key, vector as bytes, and the other columns of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)
    rest = [f for f in rows.schema if f.name not in (key, "vector")]

    def run(batches):
        for b in batches:
            if len(b):
                x = matrix(b.column("vector")).astype(kind, copy=False)
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.of(x)), b.column(key), _packed(x + 0 if kind in (np.float32, np.float64) else x), *[b.column(f.name) for f in rest]], ["cell", key, "vector", *[f.name for f in rest]])

    return rows.mapInArrow(run, ", ".join(["cell int", f"{key} long", "vector binary", *[f"{f.name} {f.dataType.simpleString()}" for f in rest]]))


#: The references of a cell by leaves: vectors as bytes, ids, labels, and where leaves begin.
HELD = "struct<x:binary,ref:array<bigint>,fraud:array<boolean>,starts:array<int>>"
#: A row of ``_met``: a cell's box (low as vector, high) and what it holds, or a query with its bound so far and what it found.
MET = "cell int, query_id long, vector binary, high binary, bound double, refs array<long>, dists array<{0}>, frauds array<boolean>, held " + HELD


def _met(refs: DataFrame, queries: DataFrame, kind: type, dims: int, k: int, distance: str, parts: int, keep: bool = False) -> DataFrame:
    """Each query against its cell. refs: cell, and ref_id, vector, is_fraud or what a cell holds; queries: cell, query_id, vector, bound.

    keep: whether the cells are given with what they hold.
    """
    ready = "held" in refs.columns
    empty = lambda c, t: F.lit(None).cast(t).alias(c)
    if ready:
        r = refs.select("cell", F.lit(False).alias("asks"), empty("id", "long"), empty("vector", "binary"), empty("is_fraud", "boolean"), empty("bound", "double"), "held")
    else:
        r = refs.select("cell", F.lit(False).alias("asks"), F.col("ref_id").alias("id"), "vector", "is_fraud", empty("bound", "double"))
    q = queries.select("cell", F.lit(True).alias("asks"), F.col("query_id").alias("id"), "vector", empty("is_fraud", "boolean"), "bound", *[empty("held", HELD)] * ready)
    whole = distance == "bigint"
    held_type = pa.struct([("x", pa.binary()), ("ref", pa.list_(pa.int64())), ("fraud", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int32()))])

    def answered(cell: int, held: Cell | None, q: list[tuple]) -> pa.RecordBatch:
        ids, x, bound = (np.concatenate(c) for c in zip(*q, strict=True))
        found, dist, ref, fraud = (held.search(x, k, bound) if held else Nearest(len(ids), k)).settle()
        n = np.bincount(found, minlength=len(ids))
        full = n >= k
        last = np.cumsum(n) - 1
        bound = bound.copy()
        bound[full] = np.minimum(bound[full], dist[last[full]])
        cut = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (ref, dist.astype(np.int64 if whole else np.float64), fraud.astype(bool))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cell, np.int32)), pa.array(ids), _packed(x), pa.nulls(len(ids), pa.binary()), pa.array(bound), *lists, pa.nulls(len(ids), held_type)], [f.split()[0] for f in MET.split(", ")])

    def box(cell: int, held: Cell) -> pa.RecordBatch:
        low, high = held.low.min(axis=0)[None], held.high.max(axis=0)[None]
        none = [pa.array([None], pa.list_(t)) for t in (pa.int64(), pa.int64() if whole else pa.float64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.nulls(1, pa.int64()), _packed(low), _packed(high), pa.nulls(1, pa.float64()), *none, kept(held) if keep else pa.nulls(1, held_type)], [f.split()[0] for f in MET.split(", ")])

    def kept(held: Cell) -> pa.Array:
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.StructArray.from_arrays([pa.array([held.rows.tobytes()], pa.binary()), one(pa.array(held.ref, pa.int64())), one(pa.array(held.fraud, pa.bool_())), one(pa.array(held.starts.astype(np.int32)))], fields=list(held_type))

    def again(row: pa.StructScalar) -> Cell:
        return Cell(np.frombuffer(row["x"].as_buffer(), kind).reshape(-1, dims), row["ref"].values.to_numpy(), row["fraud"].values.to_numpy(zero_copy_only=False), whole, row["starts"].values.to_numpy())

    def run(batches):
        now, held, rows, n, most, asked, waiting = None, None, [], 0, 2 * CELL, [], 0
        step = 8192

        def compact():
            return _lowest(*(np.concatenate(c) for c in zip(*rows, strict=True)), k)

        for b in batches:
            if not len(b):
                continue
            cells, asks = b.column("cell").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])]))
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(b)], strict=True):
                part = b.slice(i, j - i)
                if cells[i] != now:
                    if rows:
                        held = Cell(*compact(), whole)
                        yield box(now, held)
                    if asked:
                        yield answered(now, held, asked)
                    now, held, rows, n, most, asked, waiting = int(cells[i]), None, [], 0, 2 * CELL, [], 0
                if ready and not asks[i]:
                    held = again(part.column("held")[0])  # a row a cell
                    continue
                x, ids = _unpacked(part.column("vector"), kind, dims), part.column("id").to_numpy()
                if not asks[i]:
                    rows.append((x, ids, part.column("is_fraud").to_numpy(zero_copy_only=False)))
                    n += len(ids)
                    if n > most:
                        rows = [compact()]
                        n = len(rows[0][1])
                        most = n + 2 * CELL
                    continue
                if rows:
                    held, rows = Cell(*compact(), whole), []
                    yield box(now, held)
                asked.append((ids, x, part.column("bound").to_numpy(zero_copy_only=False)))
                waiting += len(ids)
                if waiting >= step:
                    yield answered(now, held, asked)
                    asked, waiting = [], 0
        if rows:
            held = Cell(*compact(), whole)
            yield box(now, held)
        if asked:
            yield answered(now, held, asked)

    both = r.unionByName(q).repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", "asks")
    return both.mapInArrow(run, MET.format(distance))


def search(refs: DataFrame, queries: DataFrame, dims: int, space: str, k: int = 5) -> DataFrame:
    """query_id, ref_id, dist, is_fraud: what may be among the k nearest of each query; the k nearest are there."""
    spark, kind, distance = refs.sparkSession, KINDS[space], space_of(space).distance
    refs, queries = refs.select("ref_id", "vector", "is_fraud"), queries.select("query_id", "vector")
    n = refs.count()
    cells = -(-n // CELL)
    some = refs.where(F.pmod(F.xxhash64("ref_id", F.lit("cells")), F.lit(n)) < PER_CELL * cells) if cells > 1 else refs.limit(0)
    sample = matrix(some.select("vector").toArrow()["vector"]).astype(np.float64)  # PER_CELL rows a cell
    tree = Tree(sample if len(sample) else np.zeros((1, dims)), PER_CELL)
    parts = min(tree.size, 4096)  # a task for each cell, no task without one
    r = _dealt(refs, tree, kind, "ref_id")
    far = F.lit(float("inf"))
    met = written(_met(r, _dealt(queries, tree, kind, "query_id").withColumn("bound", far), kind, dims, k, distance, parts, tree.size > 1), "met")
    own = met.where("query_id is not null")
    found = own.select("query_id", F.explode(F.arrays_zip("refs", "dists", "frauds")).alias("f")).select("query_id", F.col("f.refs").alias("ref_id"), F.col("f.dists").alias("dist"), F.col("f.frauds").alias("is_fraud"))
    if tree.size == 1:
        return found
    boxes = met.where("query_id is null").select("cell", "vector", "high").toArrow().combine_chunks()  # a row a cell
    as_rows = lambda c: np.array([np.frombuffer(v, np.float64) for v in boxes[c].to_pylist()]).reshape(-1, dims)
    sent = spark.sparkContext.broadcast((boxes["cell"].to_numpy(), as_rows("vector"), as_rows("high")))

    def others(batches):
        """The other cells whose box lies within a query's bound."""
        cell, low, high = sent.value
        for b in batches:
            x, own, bound = _unpacked(b.column("vector"), kind, dims).astype(np.float64), b.column("cell").to_numpy(), b.column("bound").to_numpy()
            step = max(1, BOUNDS // max(1, len(cell)))
            for i in range(0, len(x), step):
                row, c = np.nonzero((lower_bounds(x[i : i + step], low, high) <= bound[i : i + step, None]) & (cell[None] != own[i : i + step, None]))
                at = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([pa.array(cell[c]), b.column("query_id").take(at), b.column("vector").take(at), b.column("bound").take(at)], ["cell", "query_id", "vector", "bound"])

    more = own.select("cell", "query_id", "vector", "bound").mapInArrow(others, "cell int, query_id long, vector binary, bound double")
    cells_held = met.where("query_id is null").select("cell", "held")
    again = _met(cells_held, more, kind, dims, k, distance, parts).where("query_id is not null")
    return found.unionByName(again.select("query_id", F.explode(F.arrays_zip("refs", "dists", "frauds")).alias("f")).select("query_id", F.col("f.refs").alias("ref_id"), F.col("f.dists").alias("dist"), F.col("f.frauds").alias("is_fraud")))
