"""The factorisation loop, the dense tail and triangular solves."""

from __future__ import annotations

import time
from contextlib import nullcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Factors, Matrix, SolverParams
from ..operators import checks as C
from ..operators import pivots as P
from ..operators import update as UP
from ..operators.layout import numbered
from ..storage import discard, materialize, metrics_of
from . import dense as D
from .dense import dense_lu
from .triangular import GROWTH, Levels, joined


#: Panels of a dense part that a factorisation may turn to before it is dense.
MOST_PANELS = 24


def stop_reason(nnz: int, m: int, n: int, done: int, last: list[int], p: SolverParams, bordered: bool = False) -> str | None:
    """Why no more steps are made, if so. A step costs a handful of jobs however small it is, so "small" is, after nb_previous_pivots steps, a rest that the dense part takes with fewer:
    one task if the last step found less than a quarter of the rows, or a few panels if it found fewer pivots than a panel has. With a border
    (n is without its columns then) a block's inner columns that are left must fit a task, and rows of the border don't count."""
    if done >= min(m, n) or not nnz:
        return "finished"
    if nnz > (n - done) * (m - done) * p.density_tolerance:
        return "density"
    if len(last) >= p.nb_previous_pivots and sum(last[-p.nb_previous_pivots :]) < p.min_pivot_per_steps:
        return "stalled"
    left, late = (n if bordered else m) - done, len(last) >= p.nb_previous_pivots
    few = late and last[-1] < p.dense_block
    if late and left <= p.max_dense_schur and (last[-1] * 4 < left + last[-1] or bordered and few) or few and not bordered and left <= MOST_PANELS * p.dense_block:
        return "small"
    return None


class _Kept:
    """Intermediate tables of a step, deleted after it."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, **options) -> DataFrame:
        self.held.append(materialize(df, **options))
        return self.held[-1]

    def drop(self) -> None:
        discard(*self.held)
        self.held = []


#: Parts of a step whose times are measured.
PARTS = ("candidates", "merging", "ld", "u", "s")
STEP_PARTS = {k: f"count_if(part = '{k}')" for k in ("L", "D", "U", "S")}


class _Stages:
    """Writes each intermediate result of a step as a table of its own and takes the time, by state (for a trace) and part."""

    def __init__(self, trace, keep: _Kept):
        self.trace, self.keep, self.seconds = trace, keep, dict.fromkeys(PARTS, 0.0)

    def __call__(self, state: str, df: DataFrame, part: str) -> DataFrame:
        began = time.perf_counter()
        with self.trace.span(state) if self.trace else nullcontext():
            out = self.keep(df)
        self.seconds[part] += time.perf_counter() - began
        return out


def factorize(a: Matrix, params: SolverParams | None = None, border: DataFrame | None = None, trace=None, checks: frozenset[str] = frozenset(), measured: bool = False, most_steps: int | None = None) -> Factors:
    """Steps of independent pivots until the rest is dense, small or stalls. Each step is one table; only counts reach the driver.

    border: columns (col) that get no pivot, left for the dense part. trace: a report.Trace; checks: names of CHECKS made in each step.
    most_steps: a stop after so many, for a look at the first. measured (as with a trace): each part of a step is a job of its own, so that its time is known; that is slower.
    """
    p = params or SolverParams()
    measured = measured or trace is not None
    if a.n > a.m:
        raise ValueError("more columns than rows")
    if border is not None and p.pivot_strategy == "blocks":
        raise ValueError("the search by blocks doesn't know a border")
    edge = border.count() if border is not None else 0
    s = materialize(a.entries)
    nnz, done, steps, tables, found = s.count(), 0, [], [], []
    lines = materialize(P.line_stats(s, border)) if p.pivot_strategy != "blocks" else None
    while (why := stop_reason(nnz, a.m, a.n - edge, done, found, p, border is not None)) is None and (most_steps is None or len(steps) < most_steps):
        began, keep, k = time.perf_counter(), _Kept(), len(steps)
        stages = _Stages(trace, keep) if measured else None
        stage = stages or P.as_it_is
        if p.pivot_strategy == "blocks":
            piv = P.block_search(s, a.n, done, k, p.value_tol, p.marko_tol, p.nb_candidates_per_block, keep, stage)
        else:
            piv = P.search(s, a.n, done, k, p.value_tol, p.marko_tol, border, edge, keep, needed=a.n - edge - done, lines=lines, most=a.m - done, stage=stage)
        piv = keep(piv, metrics=P.KINDS)
        kinds = metrics_of(piv)
        searched = time.perf_counter()
        count = sum(kinds.values())
        if not count:
            keep.drop()
            why = "stalled"
            break
        table = materialize(UP.step(s, piv, count, nnz, stage), metrics=STEP_PARTS)
        sizes = metrics_of(table)
        after, rest = sizes["S"], table.where("part = 'S'").select("row", "col", "val")
        last = most_steps is not None and k + 1 >= most_steps or stop_reason(after, a.m, a.n - edge, done + count, [*found, count], p, border is not None) is not None
        if lines is not None and (not last or "statistics" in checks):  # only a further step asks for them
            was, lines = lines, materialize(P.updated_lines(lines, rest, piv, table, border, count, sizes["L"] + sizes["U"]))
            discard(was)
        if lines is not None and "statistics" in checks and (bad := C.same_lines(lines, P.line_stats(rest, border)).first()[0]):
            raise ValueError(f"step {k}: check statistics found {bad} violations")
        for name in sorted(checks - {"statistics"}):
            bad = CHECKS[name](s, piv, table).first()[0]
            if bad:
                raise ValueError(f"step {k}: check {name} found {bad} violations")
        keep.drop()
        s = rest
        tables.append(table)
        steps.append({"step": k, "nnz_before": nnz, "row_singletons": kinds["RS"], "col_singletons": kinds["CS"], "luby": kinds["LUBY"] + kinds["TP"], "pivots": count, "nnz_l": sizes["L"], "nnz_u": sizes["U"], "nnz_after": after, "search_s": searched - began, "update_s": time.perf_counter() - searched, **{f"{part}_s": stages.seconds[part] if stages else None for part in PARTS}})
        nnz, done = after, done + count
        found.append(count)
    spark = a.entries.sparkSession
    every = spark.createDataFrame([], "part string, pivot int, row int, col int, val double, kind string, step int")
    for k, table in enumerate(tables):
        every = every.union(table.where("part <> 'S'").withColumn("step", F.lit(k)))
    if len(tables) != 1:  # one step's table has its parts already, and serves as it is
        every, s = materialize(every), materialize(s)
        discard(*tables)
    part = lambda name: every.where(f"part = '{name}'")
    perm = part("D").select(F.col("pivot").alias("pos"), "row", "col", "step", "kind")
    discard(*([lines] if lines is not None else []))
    return Factors(a.m, a.n, part("L").select("pivot", "row", "val"), part("D").select("pivot", "row", "col", "val"), part("U").select("row", "col", "val", "pivot"), perm, s, done, p, steps, why or "finished")


#: Checks of a step's input matrix, pivots and result; beside them, "statistics" compares the lines' updated figures with fresh ones.
CHECKS = {
    "doubles": lambda s, piv, t: C.duplicates(t.where("part = 'S'")),
    "pivots": lambda s, piv, t: C.pivots_emptied(t.where("part = 'S'"), piv),
    "independence": lambda s, piv, t: C.independence(s, piv.where("kind in ('LUBY', 'TP')")),
    "logical_sum": lambda s, piv, t: C.logical_sum(s, piv, t),
    "counters": lambda s, piv, t: C.touched_once(s, piv.where("kind in ('LUBY', 'TP')")),
}


def dense_solve(x: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution's k entries, and after them what rows beyond the k-th leave of b (0 if the system can be solved)."""
    k = x.shape[1]
    y = b[order].astype(float)
    for j in range(k):
        y[j + 1 :] -= x[j + 1 :, j] * y[j]
    for j in range(k - 1, -1, -1):
        y[j] /= x[j, j]
        y[:j] -= x[:j, j] * y[j]
    return y


def plain_lu(x: np.ndarray) -> np.ndarray:
    """LU of a square array without pivoting, in place; for comparison."""
    x = x.astype(float).copy()
    for j in range(len(x)):
        if x[j, j] == 0:
            raise ZeroDivisionError("a pivot is 0")
        x[j + 1 :, j] /= x[j, j]
        x[j + 1 :, j + 1 :] -= np.outer(x[j + 1 :, j], x[j, j + 1 :])
    return x


def _tail(s: pd.DataFrame, rhs: dict, rows_left: list, cols_left: list) -> dict:
    """Solution of what is left, by column. More rows than columns must agree with each other."""
    if len(rows_left) < len(cols_left):
        raise ZeroDivisionError("the matrix is singular")
    b = np.array([rhs[r] for r in rows_left], float)
    if not cols_left:
        y, scale = b, np.abs(b).max(initial=1.0)
    else:
        ri, ci = {r: k for k, r in enumerate(rows_left)}, {c: k for k, c in enumerate(cols_left)}
        x = np.zeros((len(ri), len(ci)))
        x[s.b.map(ri).to_numpy(int), s.c.map(ci).to_numpy(int)] = s.v
        lu, order, singular = dense_lu(x)
        if singular:
            raise ZeroDivisionError("the matrix is singular")
        y, scale = dense_solve(lu, order, b), max(1.0, np.abs(b).max())
    if np.abs(y[len(cols_left) :]).max(initial=0.0) > 1e-6 * scale:
        raise ValueError("rows beyond the square part contradict the others")
    return dict(zip(cols_left, y, strict=False))


def _levels(f: Factors) -> list[tuple[int, int, str]]:
    """(step, rank, kind) of all pivots in order: pivots of one level don't meet. At most three a step."""
    if "levels" not in f.kept:
        f.kept["levels"] = sorted((r.step, {"RS": 0, "CS": 1, "LUBY": 2, "TP": 2}[r.kind], r.kind) for r in f.perm.select("step", "kind").distinct().collect())
    return f.kept["levels"]


def _numbered_pivots(f: Factors, levels: list[tuple[int, int, str]]) -> DataFrame:
    numbers = f.perm.sparkSession.createDataFrame([(s, kind, k) for k, (s, _, kind) in enumerate(levels)], "step int, kind string, level int")
    return f.perm.join(F.broadcast(numbers), ["step", "kind"])  # a row for each level


def lower_levels(f: Factors, growth: float = GROWTH) -> Levels:
    """L as an operator on right-hand sides, by rows; column singletons have no L entries."""
    if ("lower", growth) not in f.kept:
        levels = [x for x in _levels(f) if x[2] != "CS"]
        own = _numbered_pivots(f, levels).select("pos", F.col("row").alias("own"), "level")
        f.kept["lower", growth] = joined(f.l.join(own, F.col("pivot") == F.col("pos")).select("level", "row", F.col("own").alias("col"), (-F.col("val")).alias("val")), len(levels), growth)
    return f.kept["lower", growth]


def upper_levels(f: Factors, growth: float = GROWTH) -> Levels:
    """The pivots' own part of D^-1 (D + U) as an operator on solutions, by columns, the last level first."""
    if ("upper", growth) not in f.kept:
        levels = _levels(f)[::-1]
        at = _numbered_pivots(f, levels).select(F.col("col").alias("k"), "level")
        d = f.d.select(F.col("pivot").alias("p"), F.col("col").alias("own"), F.col("val").alias("by"))
        e = f.u.join(d, F.col("pivot") == F.col("p")).join(at, F.col("col") == F.col("k")).select("level", F.col("own").alias("row"), "col", (-F.col("val") / F.col("by")).alias("val"))
        f.kept["upper", growth] = joined(e, len(levels), growth)
    return f.kept["upper", growth]


def forward(f: Factors, b: DataFrame, growth: float = GROWTH) -> DataFrame:
    """(i, x): L solved for b."""
    return materialize(lower_levels(f, growth).apply(b.select("i", "x")))


def backward(f: Factors, v: DataFrame, x: DataFrame, growth: float = GROWTH) -> DataFrame:
    """(i, x) of all columns from forward() and the columns without a pivot."""
    less = f.u.join(x.select(F.col("i").alias("k"), "x"), F.col("col") == F.col("k")).groupBy(F.col("pivot").alias("p")).agg(F.sum(F.col("val") * F.col("x")).alias("less"))
    own = f.d.join(v, F.col("row") == F.col("i")).join(less, F.col("pivot") == F.col("p"), "left")
    return upper_levels(f, growth).apply(own.select(F.col("col").alias("i"), ((F.col("x") - F.coalesce("less", F.lit(0.0))) / F.col("val")).alias("x"))).union(x)


def open_columns(f: Factors) -> DataFrame:
    """(col) without a pivot, whether they have entries or not."""
    return f.dense.sparkSession.range(f.n).select(F.col("id").cast("int").alias("col")).join(f.d.select("col"), "col", "left_anti")


def open_rows(f: Factors) -> DataFrame:
    return f.dense.sparkSession.range(f.m).select(F.col("id").cast("int").alias("row")).join(f.d.select("row"), "row", "left_anti")


def _solve_tail_task(f: Factors, rhs: DataFrame) -> DataFrame:
    none = F.lit(0)
    tail = f.dense.select(F.lit("s").alias("part"), F.col("row").alias("b"), F.col("col").alias("c"), F.col("val").alias("v")).union(rhs.select(F.lit("b"), "i", none, "x"))
    tail = tail.union(open_columns(f).select(F.lit("c"), none, "col", F.lit(0.0)))

    def dense(t: pd.DataFrame) -> pd.DataFrame:
        s, r = t[t.part == "s"], t[t.part == "b"]
        right = dict(zip(r.b, r.v, strict=True))
        x = _tail(s, right, sorted(right), sorted(t[t.part == "c"].c))
        return pd.DataFrame({"i": list(x), "x": list(x.values())})

    return tail.groupBy().applyInPandas(dense, "i int, x double")


def tail_blocks(f: Factors, trace=None) -> tuple[D.DenseFactors, DataFrame, DataFrame]:
    """The dense part's factors over blocks, and the numbers (idx, pos) of its rows and columns."""
    if "tail" not in f.kept:
        span, began = trace.span if trace else lambda _: nullcontext(), time.perf_counter()
        rows, cols = materialize(numbered(open_rows(f), "row")), materialize(numbered(open_columns(f), "col"))
        e = f.dense.join(rows.select(F.col("idx").alias("row"), F.col("pos").alias("i")), "row").join(cols.select(F.col("idx").alias("col"), F.col("pos").alias("j")), "col").select("i", "j", "val")
        m, n, size = f.m - f.done, f.n - f.done, f.params.dense_block
        with span("convert matrix"):
            blocks = D.table(D.blocked(e, m, n, size), size)
        converted = time.perf_counter()
        with span("dense factorization"):
            f.kept["tail"] = D.factorize_blocks(blocks, m, n, size), rows, cols
        discard(blocks)
        f.kept["seconds"] = {"convert": converted - began, "dense": time.perf_counter() - converted}
    return f.kept["tail"]


def solve_tail(f: Factors, rhs: DataFrame) -> DataFrame:
    """(i, x) of the columns without a pivot; rhs: (i, x) of the rows without one. In one task up to max_dense_schur rows, else over blocks."""
    if f.n == f.done:
        worst = rhs.agg(F.max(F.abs("x"))).first()[0] or 0.0
        if worst > 1e-6 * max(1.0, f.kept.get("scale", 1.0)):
            raise ValueError("rows beyond the square part contradict the others")
        return rhs.limit(0)
    if f.m - f.done <= f.params.max_dense_schur and "tail" not in f.kept:
        return materialize(_solve_tail_task(f, rhs))
    factors, rows, cols = tail_blocks(f)
    right = rhs.join(rows, F.col("i") == F.col("idx")).select(F.col("pos").alias("i"), "x")
    x = D.solve_blocks(factors, right).withColumnRenamed("i", "j")
    return x.join(cols, F.col("j") == F.col("pos")).select(F.col("idx").alias("i"), "x")


def solve(f: Factors, b: DataFrame, growth: float = GROWTH, seconds: dict[str, float] | None = None) -> DataFrame:
    """(i, x) of A x = b: joined levels of L, the dense part, joined levels of U. Levels and the dense part's factors are kept for further solves.

    seconds: gets the times of the three parts (l, dense, u); the solution is written as a table then.
    """
    times = [time.perf_counter()]
    v = forward(f, b, growth)
    f.kept["scale"] = v.agg(F.max(F.abs("x"))).first()[0] or 1.0
    times.append(time.perf_counter())
    tail = solve_tail(f, v.join(f.d.select("row"), F.col("i") == F.col("row"), "left_anti"))
    times.append(time.perf_counter())
    x = backward(f, v, tail, growth)
    if seconds is not None:
        x = materialize(x)
        times.append(time.perf_counter())
        seconds.update(zip(("l", "dense", "u"), (y - x_ for x_, y in zip(times, times[1:], strict=False)), strict=True))
    return x


def reconstruction(f: Factors) -> DataFrame:
    """(row, col, val) of L (D + U) plus the rest: what the factors say the matrix was."""
    u = f.u.select("pivot", "col", "val").union(f.d.select("pivot", "col", "val"))
    own = f.d.select(F.col("pivot").alias("p"), "row")
    unit = f.l.select(F.col("pivot").alias("p"), "row", F.col("val").alias("lv")).union(own.withColumn("lv", F.lit(1.0)))
    product = u.join(unit, F.col("pivot") == F.col("p")).select("row", "col", (F.col("lv") * F.col("val")).alias("val"))
    return product.union(f.dense.select("row", "col", "val")).groupBy("row", "col").agg(F.sum("val").alias("val"))


def permutation(f: Factors) -> DataFrame:
    """perm with the dense tail's lines after the pivots, in order of their ids."""
    rows = numbered(open_rows(f), "row").select(F.col("idx").alias("row"), F.col("pos").alias("k"))
    cols = numbered(open_columns(f), "col").select(F.col("idx").alias("col"), F.col("pos").alias("j"))
    tail = rows.join(cols, F.col("k") == F.col("j")).select((F.col("k") + f.done).cast("int").alias("pos"), "row", "col", F.lit(len(f.steps)).alias("step"), F.lit("DENSE").alias("kind"))
    return f.perm.union(tail)


def accounting(f: Factors, nnz: int) -> dict[str, float]:
    """Entries of the factors: L and U with the dense part's halves, the diagonal once; fill: of all to those of the matrix."""
    l, u, k = f.l.count(), f.u.count(), f.n - f.done  # noqa: E741
    dense = k * (f.m - f.done)
    out = {"nnz_l": l, "nnz_u": u + f.done, "nnz_dense": dense, "nnz_final": l + u + f.done + dense, "schur_density": f.dense.count() / dense if dense else 0.0}
    return out | {"fill": out["nnz_final"] / max(1, nnz)}


def cross_check(a: Matrix, f: Factors) -> float:
    """Largest difference between P A Q and the product of its plain dense factors under f's permutation; for small matrices in one task."""
    p, n = permutation(f), a.n
    e = a.entries.join(p.select("row", F.col("pos").alias("i")), "row").join(p.select("col", F.col("pos").alias("j")), "col").select("i", "j", "val")

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((n, n))
        x[t.i, t.j] = t.val
        lu, order, _ = dense_lu(x)
        back = (np.tril(lu, -1) + np.eye(n)) @ np.triu(lu)
        return pd.DataFrame({"error": [float(np.abs(back - x[order]).max(initial=0.0))]})

    return e.groupBy().applyInPandas(compare, "error double").first()[0]


def cross_check_permuted(a: Matrix, b: DataFrame, params: SolverParams | None = None) -> float:
    """The other direction: the whole of a square A is factorised densely over blocks, and A with its rows in that factorisation's order
    sparsely. Largest difference of both solutions."""
    p = params or SolverParams()
    if a.m != a.n:
        raise ValueError("a square matrix is expected")
    whole = D.factorize_blocks(D.blocked(a.entries.select(F.col("row").alias("i"), F.col("col").alias("j"), "val"), a.m, a.n, p.dense_block), a.m, a.n, p.dense_block)
    dense_x = D.solve_blocks(whole, b)
    order = materialize(whole.pivots.select("k", F.posexplode("ids").alias("at", "was")).select("was", (F.col("k") * p.dense_block + F.col("at")).cast("int").alias("pos")))
    e = a.entries.join(order, F.col("row") == F.col("was")).select(F.col("pos").alias("row"), "col", "val")
    moved = b.join(order, F.col("i") == F.col("was")).select(F.col("pos").alias("i"), "x")
    x = solve(factorize(Matrix(e, a.m, a.n), p), moved)
    both = dense_x.select(F.col("i").alias("k"), F.col("x").alias("y")).join(x, F.col("k") == F.col("i"), "full")
    return both.agg(F.max(F.coalesce(F.abs(F.col("x") - F.col("y")), F.lit(float("inf"))))).first()[0] or 0.0


def refine(a: Matrix, f: Factors, b: DataFrame, x: DataFrame, target: float = 1e-14, rounds: int = 20) -> DataFrame:
    """x += solve(b - A x) until the backward error is small or stops shrinking."""
    from ..operators import algebra as A

    best = A.backward_error(a.entries, x, b, a.m).first()[0]
    for _ in range(rounds):
        if best <= target:
            break
        r = A.axpby(b, 1.0, A.spmv(a.entries, x, a.m), -1.0)
        better = materialize(A.axpby(x, 1.0, solve(f, r), 1.0))
        error = A.backward_error(a.entries, better, b, a.m).first()[0]
        if error >= best:
            break
        x, best = better, error
    return x
