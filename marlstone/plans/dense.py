"""LU of a dense matrix held as blocks, with tournament pivoting, and solves with it.

A matrix is a relation (bi, bj, ids, data): block row, block column, the rows still in it and their values, row by row.
Panel by panel (a block column) of `size` columns:

- each block of the panel puts up its best `size` rows by partial pivoting; a tree of groups of FAN blocks leaves one set
  of pivot rows (a tournament), all in one job;
- the pivot rows leave their blocks and become a row of U, block column by block column; what is left of the panel becomes L;
- every other block meets its L (by block row) and its U (by block column) in two joins and is updated in an Arrow pass.

Rows are never exchanged: a block keeps the ids of its rows and shrinks as they become pivots. The driver sees one panel's
pivot block at a time (size x size), a task a few blocks (FAN in the tournament), whatever the matrix's dimension. Each
panel's results are tables in the shared folder. `size` is the one bound to choose: memory of a task is about 5 * 8 * size^2
bytes, a panel costs a handful of jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize

#: Blocks in a group of the tournament.
FAN = 8
BLOCKS = "bi int, bj int, ids binary, data binary"
#: Bytes of blocks in a row group of their tables, however few they take compressed, and of blocks that an update's task meets.
GROUP, TASK = 16 << 20, 64 << 20


def dense_lu(x: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray, bool]:
    """LU with partial pivoting of an m x k array (m >= k): the factors in place, row order, and whether a pivot was 0.

    By panels of `block` columns, so most of the work is products of arrays.
    """
    x = x.astype(float).copy()
    m, k = x.shape
    order, singular = np.arange(m), False
    for a in range(0, k, block):
        b = min(k, a + block)
        for j in range(a, b):
            at = j + int(np.argmax(np.abs(x[j:, j])))
            if x[at, j] == 0:
                singular = True
                continue
            if at != j:
                x[[j, at]] = x[[at, j]]
                order[[j, at]] = order[[at, j]]
            x[j + 1 :, j] /= x[j, j]
            x[j + 1 :, j + 1 : b] -= np.outer(x[j + 1 :, j], x[j, j + 1 : b])
        if b < k:
            for j in range(a, b):
                x[j + 1 : b, b:] -= np.outer(x[j + 1 : b, j], x[j, b:])
            x[b:, b:] -= x[b:, a:b] @ x[a:b, b:]
    return x, order, singular


@dataclass(frozen=True)
class DenseFactors:
    """heads[k](k, ids array, data): panel k's pivot rows in order and their L11 \\ U11 in place; lower[k](ids, data): L of the rows left
    after panel k; upper(k, bj, data): U right of panel k. Row ids and columns are 0-based, in the blocks' numbering."""

    m: int
    n: int
    size: int
    heads: list[DataFrame]
    lower: list[DataFrame]
    upper: list[DataFrame]

    def width(self, k: int) -> int:
        return min(self.size, self.n - k * self.size)

    @property
    def pivots(self) -> DataFrame:
        """All panels' heads."""
        return reduce(DataFrame.union, self.heads)


def _array(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, width)


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(len(b)):
            yield {c: b.column(c)[k].as_py() for c in b.schema.names}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_OUT = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
_UP = pa.schema([("bj", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
_CELL = pa.schema([("i", pa.int32()), ("x", pa.float64())])


def table(df: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """A table of blocks that is read in pieces of GROUP bytes."""
    return materialize(df, by=by, group=max(1, GROUP // (8 * size * size)))


def _parts(spark: SparkSession, blocks: int, size: int) -> int:
    """Tasks that so many blocks are dealt to for an update: by their bytes, as blocks of few entries look small where they are compressed."""
    return max(1, min(blocks, max(spark.sparkContext.defaultParallelism, blocks * 3 * 8 * size * size // TASK)))


def blocked(entries: DataFrame, m: int, n: int, size: int) -> DataFrame:
    """Blocks of an m x n matrix from (i, j, val), 0-based; cells without an entry are 0. A group is at most size^2 entries."""
    place = (F.col("i") % size * size + F.col("j") % size).cast("int")
    cells = entries.select((F.col("i") / size).cast("int").alias("bi"), (F.col("j") / size).cast("int").alias("bj"), F.struct(place.alias("at"), F.col("val")).alias("cell"))
    spark, tall, wide = entries.sparkSession, -(-m // size), -(-n // size)
    grid = spark.range(tall * wide).select((F.col("id") / wide).cast("int").alias("bi"), (F.col("id") % wide).cast("int").alias("bj"), F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"))
    dealt = cells.union(grid).repartition(_parts(spark, tall * wide, size), "bi", "bj").groupBy("bi", "bj").agg(F.collect_list("cell").alias("cells"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            high, width = min(size, m - r["bi"] * size), min(size, n - r["bj"] * size)
            x = np.zeros((size, size))
            for c in r["cells"] or []:
                x.ravel()[c["at"]] = c["val"]
            ids = np.arange(high, dtype="<i4") + r["bi"] * size
            yield _batch([{"bi": r["bi"], "bj": r["bj"], "ids": ids.tobytes(), "data": x[:high, :width].astype("<f8").tobytes()}], _OUT)

    return dealt.mapInArrow(fill, BLOCKS)


def _best_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that partial pivoting takes first, as many as there are columns, with their values."""
    if len(ids) <= x.shape[1]:
        return ids, x
    first = dense_lu(x)[1][: x.shape[1]]
    return ids[first], x[first]


def _tournament(panel: DataFrame, blocks: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivot rows of a panel in order, and their factors."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            ids, x = _best_rows(_ids(r["ids"]), _array(r["data"], width))
            yield _batch([{"bi": r["bi"], "bj": 0, "ids": ids.tobytes(), "data": x.tobytes()}], _OUT)

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("bi")
        ids = np.concatenate([_ids(v.as_py()) for v in t.column("ids")])
        x = np.concatenate([_array(v.as_py(), width) for v in t.column("data")])
        ids, x = _best_rows(ids, x)
        return pa.Table.from_pylist([{"bi": t.column("bi")[0].as_py() // FAN, "bj": 0, "ids": ids.tobytes(), "data": x.tobytes()}], _OUT)

    left = panel.mapInArrow(best, BLOCKS)
    while blocks > 1:
        left = left.groupBy((F.col("bi") / FAN).cast("int")).applyInArrow(meet, BLOCKS)
        blocks = -(-blocks // FAN)
    won = left.first()
    ids, x = _ids(won.ids), _array(won.data, width)
    if len(ids) < width:
        raise ZeroDivisionError("the matrix is singular")
    lu, order, singular = dense_lu(x)
    if singular:
        raise ZeroDivisionError("the matrix is singular")
    return ids[order], lu


def factorize_blocks(blocks: DataFrame, m: int, n: int, size: int) -> DenseFactors:
    """P A = L U of blocked(); m >= n."""
    if n > m:
        raise ValueError("more columns than rows")
    spark, tall, wide = blocks.sparkSession, -(-m // size), -(-n // size)
    rest = table(blocks.withColumn("panel", F.col("bj") == 0), size, by=["panel"])
    pivots, lower, upper = [], [], []
    for k in range(wide):
        width = min(size, n - k * size)
        panel = rest.where("panel").drop("panel")
        ids, lu = _tournament(panel, tall, width)
        pivots.append(materialize(spark.createDataFrame([(k, ids.tolist(), bytearray(lu.astype("<f8").tobytes()))], "k int, ids array<int>, data binary").coalesce(1)))

        def below(batches: Iterator[pa.RecordBatch], ids=ids, lu=lu, width=width) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                own, x = _ids(r["ids"]), _array(r["data"], width)
                stay = ~np.isin(own, ids)
                if stay.any():
                    solved = np.linalg.solve(np.triu(lu).T, x[stay].T).T
                    yield _batch([{"bi": r["bi"], "bj": 0, "ids": own[stay].tobytes(), "data": np.ascontiguousarray(solved).tobytes()}], _OUT)

        l = table(panel.mapInArrow(below, BLOCKS).select("bi", "ids", "data"), size)  # noqa: E741
        lower.append(l)
        if k == wide - 1:
            discard(rest)
            break
        others = rest.where("not panel").drop("panel")
        upper.append(table(_upper(others, ids, lu, size, n).withColumn("k", F.lit(k)), size, by=["bj"]))
        spread = _parts(spark, tall * (wide - k - 1), size)
        was, rest = rest, table(_updated(others, l, upper[-1], (tall, k + 1, wide), spread, size, n).withColumn("panel", F.col("bj") == k + 1), size, by=["panel"])
        discard(was)
    return DenseFactors(m, n, size, pivots, lower, upper)


def _upper(blocks: DataFrame, ids: np.ndarray, lu: np.ndarray, size: int, n: int) -> DataFrame:
    """(bj, data): the pivot rows of each block column, solved with L11. A group is as many rows as a panel has pivots."""
    wide = lambda bj: min(size, n - bj * size)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            own, x = _ids(r["ids"]), _array(r["data"], wide(r["bj"]))
            here = np.isin(own, ids)
            if here.any():
                yield _batch([{"bj": r["bj"], "ids": own[here].tobytes(), "data": x[here].tobytes()}], _UP)

    def solved(t: pa.Table) -> pa.Table:
        bj = t.column("bj")[0].as_py()
        own = np.concatenate([_ids(v.as_py()) for v in t.column("ids")])
        x = np.concatenate([_array(v.as_py(), wide(bj)) for v in t.column("data")])
        order = np.argsort(own)
        x = x[order[np.searchsorted(own[order], ids)]]
        u = np.linalg.solve(np.tril(lu, -1) + np.eye(len(ids)), x)
        return pa.Table.from_pylist([{"bj": bj, "data": u.tobytes()}], pa.schema([_UP.field("bj"), _UP.field("data")]))

    return blocks.mapInArrow(taken, "bj int, ids binary, data binary").groupBy("bj").applyInArrow(solved, "bj int, data binary")


def _updated(blocks: DataFrame, l: DataFrame, u: DataFrame, span: tuple[int, int, int], spread: int, size: int, n: int) -> DataFrame:  # noqa: E741
    """Blocks less L U, without the pivot rows. Blocks all of whose rows are pivots go.

    L goes to all of its block row and U to all of its block column (span: number of block rows, first block column, end), so that one
    shuffle by block, to `spread` tasks, has all three meet. A group is three blocks.
    """
    tall, first, wide = span
    every = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
    left = l.select("bi", every(first, wide).alias("bj"), F.lit("l"), "ids", "data")
    right = u.select(every(0, tall).alias("bi"), "bj", F.lit("u"), F.lit(None).cast("binary"), "data")
    parts = blocks.select("bi", "bj", F.lit("x").alias("part"), "ids", "data").union(left).union(right)

    def update(t: pa.Table) -> pa.Table:
        at = {p: k for k, p in enumerate(t.column("part").to_pylist())}
        if len(at) < 3:
            return _OUT.empty_table()
        ids, data = (lambda p: t.column("ids")[at[p]].as_py()), (lambda p: t.column("data")[at[p]].as_py())
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        x, u_ = _array(data("x"), min(size, n - bj * size)), _array(data("u"), min(size, n - bj * size))
        x = x[np.isin(_ids(ids("x")), _ids(ids("l")))] - _array(data("l"), len(u_)) @ u_  # both keep the block's order
        return pa.Table.from_pylist([{"bi": bi, "bj": bj, "ids": ids("l"), "data": np.ascontiguousarray(x).tobytes()}], _OUT)

    return parts.repartition(spread, "bi", "bj").groupBy("bi", "bj").applyInArrow(update, BLOCKS)


def _replaced(v: DataFrame, key: str, known: dict[int, float], less: DataFrame | None) -> DataFrame:
    """v(key, x) with the known values put in and less(key, x) added elsewhere; a table. known: at most a panel's rows."""
    spark = v.sparkSession
    own = F.broadcast(spark.createDataFrame(list(known.items()), f"{key} int, known double"))
    out = v if less is None else v.union(less.select(key, "x")).groupBy(key).agg(F.sum("x").alias("x"))
    out = materialize(out.join(own, key, "left").select(key, F.coalesce("known", "x").alias("x")))
    discard(v)
    return out


def solve_blocks(f: DenseFactors, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(i, x): the solution by column, of (i, x) with a row for each row of the matrix. Rows beyond the square part must agree with the others."""
    panels = range(len(f.lower))
    v = materialize(b.select(F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x")))
    scale = max(1.0, v.agg(F.max(F.abs("x"))).first()[0] or 0.0)
    head = lambda k: f.heads[k].first()
    for k in panels:
        p = head(k)
        ids, lu = p.ids, _array(p.data, f.width(k))
        got = {r.i: r.x for r in v.where(F.col("i").isin(ids)).collect()}
        y = np.linalg.solve(np.tril(lu, -1) + np.eye(len(ids)), np.array([got[i] for i in ids]))

        def less(batches: Iterator[pa.RecordBatch], y=y) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array(_ids(r["ids"])), pa.array(-(_array(r["data"], len(y)) @ y))], schema=_CELL)

        v = _replaced(v, "i", dict(zip(ids, y.tolist(), strict=True)), f.lower[k].select("ids", "data").mapInArrow(less, "i int, x double"))
    spots = f.pivots.select("k", F.posexplode("ids").alias("at", "i")).select("i", (F.col("k") * f.size + F.col("at")).cast("int").alias("j"))  # pivot row, its column
    if f.m > f.n:
        off = v.join(spots, "i", "left_anti").agg(F.max(F.abs("x"))).first()[0] or 0.0
        if off > tolerance * scale:
            raise ValueError("rows beyond the square part contradict the others")
    w = materialize(v.join(spots, "i").select("j", "x"))
    discard(v)
    for k in reversed(panels):
        lu, lo = _array(head(k).data, f.width(k)), k * f.size
        got = {r.j: r.x for r in w.where((F.col("j") >= lo) & (F.col("j") < lo + f.size)).collect()}
        x = np.linalg.solve(np.triu(lu), np.array([got[lo + t] for t in range(f.width(k))]))

        def less(batches: Iterator[pa.RecordBatch], x=x, size=f.size) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                d = -(_array(r["data"], len(x)) @ x)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(d), dtype=np.int32) + r["k"] * size), pa.array(d)], schema=pa.schema([("j", pa.int32()), ("x", pa.float64())]))

        above = [u.where(F.col("bj") == k).select("k", "data") for u in f.upper[:k]]
        more = None
        for u in above:
            more = u if more is None else more.union(u)
        w = _replaced(w, "j", {lo + t: float(c) for t, c in enumerate(x)}, more.mapInArrow(less, "j int, x double") if more is not None else None)
    return w.select(F.col("j").alias("i"), "x")
