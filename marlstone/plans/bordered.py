"""Solves in singly bordered block diagonal form, and whole runs that make that form first.

Columns interior to one block are factorised sparsely, those of all blocks in the same steps, as blocks share no such
column; border columns get no pivot. What is left of a block is eliminated once, in a task of its own (dense, block by block), which gives the block's lines in
border columns and what substitution back needs.

The lines make the border's system. Small ones (max_dense_schur) are solved in one task. Larger ones are nested: blocks are joined in pairs, so that a column
which only two neighbours share becomes interior, and the system is solved in bordered form again, with half the blocks, down to two; then, or
if nesting is off, it is factorised like any matrix.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import Matrix, SolverParams
from ..operators import algebra as A
from ..operators import blocks as B
from ..operators import multilevel
from ..operators.layout import numbered
from ..storage import materialize
from . import factorize as FA
from .dense import dense_lu

ELIMINATED = "block int, part string, row int, col int, val double"


@dataclass(frozen=True)
class BorderedParams:
    num_blocks: int = 4
    #: multilevel: operators.multilevel; moves: blocks.grown; ranges: equal ranges of rows.
    partitioner: str = "multilevel"
    slack: float = 1.1
    nested: bool = True
    solver: SolverParams = field(default_factory=SolverParams)

    def __post_init__(self):
        if self.num_blocks < 1:
            raise ValueError("at least one block")
        if self.partitioner not in ("multilevel", "moves", "ranges"):
            raise ValueError("partitioner must be multilevel, moves or ranges")


def partition(a: Matrix, p: BorderedParams) -> DataFrame:
    """(row, block)."""
    if p.partitioner == "multilevel":
        return multilevel.partition(a.entries, a.m, p.num_blocks, p.slack)
    if p.partitioner == "moves":
        return B.grown(a.entries, a.m, p.num_blocks, slack=max(1.25, p.slack))
    return B.contiguous(a.entries.sparkSession, a.m, p.num_blocks)


def _eliminated(t: pd.DataFrame) -> pd.DataFrame:
    """A block's interior eliminated: lines that are left, in border columns (col -1: right-hand side), and the interior's rows (u, c on the border, y).

    Only rows with interior entries, and the border columns that those have, make dense arrays; other rows are lines as they are.
    """
    e, r = t[t.part == "e"], t[t.part == "b"]
    met = np.unique(e[e.interior].row)
    full, e = e[~e.row.isin(met)], e[e.row.isin(met)]
    plain, r = r[~r.row.isin(met)], r[r.row.isin(met)]
    rows = {x: k for k, x in enumerate(sorted(r.row))}
    inner, edge = sorted(set(e[e.interior].col)), sorted(set(e[~e.interior].col))
    ci, ce, n = {c: k for k, c in enumerate(inner)}, {c: k for k, c in enumerate(edge)}, len(inner)
    a, c, b = np.zeros((len(rows), n)), np.zeros((len(rows), len(edge))), np.zeros(len(rows))
    b[[rows[x] for x in r.row]] = r.val
    for part, to, at in ((e[e.interior], a, ci), (e[~e.interior], c, ce)):
        to[part.row.map(rows).to_numpy(int), part.col.map(at).to_numpy(int)] = part.val
    lu, order, singular = dense_lu(a) if inner else (a, np.arange(len(rows)), False)
    if singular or n > len(rows):
        raise ZeroDivisionError("a block is singular")
    right = np.column_stack([c, b])[order]
    if n:
        right[:n] = np.linalg.solve(np.tril(lu[:n], -1) + np.eye(n), right[:n])
        right[n:] -= lu[n:] @ right[:n]
    y, c = right[:, -1], right[:, :-1]
    parts = []

    def put(part: str, x: np.ndarray, cols: np.ndarray) -> None:
        i, j = np.nonzero(x)
        parts.append(pd.DataFrame({"part": part, "row": i, "col": cols[j], "val": x[i, j]}))

    put("u", np.triu(lu[:n]), np.array(inner, int))
    put("c", c[:n], np.array(edge, int))
    put("line", c[n:], np.array(edge, int))
    parts.append(pd.DataFrame({"part": "y", "row": np.arange(n), "col": inner, "val": y[:n]}))
    parts.append(pd.DataFrame({"part": "line", "row": np.arange(len(rows) - n), "col": -1, "val": y[n:]}))
    behind = {x: len(rows) - n + k for k, x in enumerate(sorted(plain.row))}
    parts.append(pd.DataFrame({"part": "line", "row": full.row.map(behind).to_numpy(int), "col": full.col.to_numpy(int), "val": full.val.to_numpy(float)}))
    parts.append(pd.DataFrame({"part": "line", "row": plain.row.map(behind).to_numpy(int), "col": -1, "val": plain.val.to_numpy(float)}))
    return pd.concat([p for p in parts if len(p)] or parts).assign(block=int(t.block.iloc[0]))[["block", "part", "row", "col", "val"]].astype({"block": "int32", "row": "int32", "col": "int32", "val": "float64"})


def _back(t: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
    """The interior's solution from its rows and the border's."""
    known, right = dict(zip(x.i, x.x, strict=True)), t[t.part == "y"].sort_values("row")
    y, n = right.val.to_numpy(float).copy(), len(right)
    at = {c: k for k, c in enumerate(right.col)}
    c, u = t[t.part == "c"], t[t.part == "u"]
    np.subtract.at(y, c.row.to_numpy(), c.val.to_numpy() * np.array([known[k] for k in c.col], float))
    full = np.zeros((n, n))
    full[u.row, u.col.map(at).to_numpy(int)] = u.val
    for j in range(n - 1, -1, -1):
        y[j] /= full[j, j]
        y[:j] -= full[:j, j] * y[j]
    return pd.DataFrame({"i": right.col.to_numpy(), "x": y}).astype({"i": "int32"})


def _dense_border(t: pd.DataFrame) -> pd.DataFrame:
    n = int((t.j < 0).sum())
    a, b = np.zeros((n, n)), np.zeros(n)
    right, e = t[t.j < 0], t[t.j >= 0]
    b[right.i], a[e.i, e.j] = right.val, e.val
    lu, order, singular = dense_lu(a)
    if singular:
        raise ZeroDivisionError("the border system is singular")
    return pd.DataFrame({"j": np.arange(n), "x": FA.dense_solve(lu, order, b)}).astype({"j": "int32"})


def border_system(lines: DataFrame, cols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, val; j -1: right-hand side) and (i, block) of the blocks' lines; cols: the border's numbers (idx, pos)."""
    counts = lines.where("col = -1").groupBy("block").agg(F.count(F.lit(1)).alias("n"))  # a row for each block
    before = counts.select(F.col("block").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = lines.join(F.broadcast(before), F.col("block") == F.col("of")).select((F.col("before") + F.col("row")).cast("int").alias("i"), "block", "col", "val")
    j = F.when(F.col("col") == -1, F.lit(-1)).otherwise(F.col("pos"))
    e = materialize(at.join(cols, F.col("col") == F.col("idx"), "left").select("i", j.cast("int").alias("j"), "val", "block"))
    return e.select("i", "j", "val"), e.where("j = -1").select("i", "block")


def solve(a: Matrix, b: DataFrame, assigned: DataFrame, params: SolverParams | None = None, nested: bool = True) -> DataFrame:
    """(i, x) of A x = b; assigned: (row, block)."""
    p = params or SolverParams()
    cols = materialize(B.col_blocks(a.entries, assigned))
    edge = cols.where("block is null").select("col")
    f = FA.factorize(a, p, border=edge)
    v = FA.forward(f, b)
    kind = cols.select("col", F.col("block").alias("cb"))
    own = f.dense.join(assigned, "row").join(kind, "col").select("block", F.lit("e").alias("part"), "row", "col", "val", F.col("cb").isNotNull().alias("interior"))
    right = v.join(f.d.select("row"), F.col("i") == F.col("row"), "left_anti").join(assigned, F.col("i") == F.col("row"))
    parts = own.union(right.select("block", F.lit("b"), "i", F.lit(-1), "x", F.lit(True)))
    parts = materialize(parts.groupBy("block").applyInPandas(_eliminated, ELIMINATED), metrics={"lines": "count_if(part = 'line' and col = -1)"})
    lines = parts.where("part = 'line'").select("block", "row", "col", "val")
    numbers = materialize(numbered(edge, "col"))
    n = numbers.count()
    if n != FA.metrics_of(parts)["lines"]:
        raise ValueError("the border system isn't square")
    e, of = border_system(lines, numbers)
    if n <= p.max_dense_schur:
        x = e.groupBy().applyInPandas(_dense_border, "j int, x double")
    else:
        system, rhs = Matrix(e.where("j >= 0").select(F.col("i").alias("row"), F.col("j").alias("col"), "val"), n, n), e.where("j = -1").select("i", F.col("val").alias("x"))
        pairs = of.select(F.col("i").alias("row"), F.expr("block div 2").cast("int").alias("block"))
        again = nested and pairs.select("block").distinct().count() > 1
        x = (solve(system, rhs, pairs, p) if again else FA.solve(FA.factorize(system, p), rhs)).withColumnRenamed("i", "j")
    border_x = materialize(x.join(numbers, F.col("j") == F.col("pos")).select(F.col("idx").alias("i"), "x"))
    wanted = parts.where("part = 'c'").select(F.col("block").alias("of"), F.col("col").alias("k")).distinct().join(border_x, F.col("k") == F.col("i")).select("of", "i", "x")
    inner = parts.where("part in ('u', 'c', 'y')").groupBy("block").cogroup(wanted.groupBy("of")).applyInPandas(_back, "i int, x double")
    return FA.backward(f, v, materialize(inner.union(border_x)))


def fill(a: Matrix, assigned: DataFrame, params: SolverParams | None = None) -> dict[str, float]:
    """Entries of the factors and of the border's system, and their ratio to the matrix's."""
    cols = materialize(B.col_blocks(a.entries, assigned))
    f = FA.factorize(a, params, border=cols.where("block is null").select("col"))
    return FA.accounting(f, a.entries.count())


def run(a: Matrix, b: DataFrame, params: BorderedParams | None = None) -> dict:
    """Partitions, checks the form, solves and measures: assigned, stats (by block), border, x, backward_error."""
    p = params or BorderedParams()
    a = Matrix(materialize(a.entries), a.m, a.n)
    assigned = materialize(partition(a, p))
    rows = materialize(B.row_blocks(assigned))
    cols = materialize(B.col_blocks(a.entries, rows))
    if wrong := B.violations(a.entries, rows, cols).first()[0]:
        raise ValueError(f"the block form has {wrong} violations")
    b = materialize(b)
    x = materialize(solve(a, b, assigned, p.solver, p.nested))
    return {
        "assigned": assigned, "stats": B.block_stats(B.block_sizes(a.entries, rows, cols)), "border": B.border_stats(a.entries, cols).first().asDict(), "x": x,
        "backward_error": A.backward_error(a.entries, x, b, a.m).first()[0],
    }
