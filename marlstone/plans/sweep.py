"""Parameter sweeps: fresh runs over a geometric (value_tol) or arithmetic (others) series."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Matrix, SolverParams
from ..operators import algebra as A
from ..sources.triplets import default_vector
from ..storage import NEAR_ROWS, discard, materialize
from .factorize import PARTS, accounting, factorize, solve, tail_blocks

SWEPT = ("value_tol", "marko_tol", "nb_candidates_per_block", "nb_previous_pivots", "min_pivot_per_steps", "density_tolerance")


def values(param: str, init: float, inc: float, steps: int) -> list[float]:
    if param not in SWEPT:
        raise ValueError(f"{param} can't be swept")
    return [init * inc**k if param == "value_tol" else init + inc * k for k in range(steps)]


RUN = (
    "run int, param_value double, steps int, sparse_pivots int, dense_pivots int, nnz_l long, nnz_u long, nnz_final long, schur_density double, search_s double, update_s double, candidates_s double, merging_s double, ld_s double, u_s double, s_s double, "
    "convert_s double, dense_s double, solve_s double, solve_l_s double, solve_dense_s double, solve_u_s double, forward_error double, backward_error double, solved boolean, reason string"
)


def _run(a: Matrix, k: int, v: float, params: SolverParams, x0: DataFrame, b: DataFrame, tolerance: float, measured: bool) -> dict:
    f = factorize(a, params, measured=measured)
    if measured and f.n > f.done:
        tail_blocks(f)
    began, parts = time.perf_counter(), {}
    x = solve(f, b, seconds=parts)
    took = time.perf_counter() - began
    error = float(A.backward_error(a.entries, x, b, a.m).first()[0])
    forward = A.norm2(A.axpby(x, 1.0, x0, -1.0)).first()[0] / max(1e-300, A.norm2(x0).first()[0])
    discard(x)
    total = lambda key: None if any(s[key] is None for s in f.steps) else float(sum(s[key] for s in f.steps))
    tail = f.kept.get("seconds", {"convert": 0.0, "dense": 0.0} if measured else {})
    return {
        "run": k, "param_value": float(v), "steps": len(f.steps), "sparse_pivots": f.done, "dense_pivots": a.n - f.done, **{c: accounting(f, 1)[c] for c in ("nnz_l", "nnz_u", "nnz_final", "schur_density")}, **{c: total(c) for c in ("search_s", "update_s", *(f"{p}_s" for p in PARTS))},
        "convert_s": tail.get("convert"), "dense_s": tail.get("dense"), "solve_s": took, **{f"solve_{c}_s": parts[c] for c in ("l", "dense", "u")}, "forward_error": float(forward), "backward_error": error, "solved": error < tolerance, "reason": f.reason,
    }


def sweep(a: Matrix, param: str, init: float, inc: float, steps: int, params: SolverParams | None = None, tolerance: float = 1e-9, measured: bool = False, at_once: int = 4) -> DataFrame:
    """run_stats: a row per run with its steps, pivots, factor sizes, times, errors and whether it solved. Swept blocks need pivot_strategy 'blocks'.

    The matrix and the right-hand side are written once for all runs. Runs go `at_once` at a time, each in a scheduler pool of its own, so that the
    many small stages of one fill what another leaves idle; with measured parts they go one after the other, as times would mix, and so they do
    with a matrix of more than NEAR_ROWS entries, whose stages fill the machines alone: what runs hold on the driver and the executors would add up.
    """
    spark, base = a.entries.sparkSession, params or SolverParams()
    a = Matrix(materialize(a.entries), a.m, a.n)
    x0 = default_vector(spark, a.n)
    b = materialize(A.spmv(a.entries, x0, a.m))
    if param == "nb_candidates_per_block" and base.pivot_strategy != "blocks":
        base = replace(base, pivot_strategy="blocks")  # the only search that reads it
    kind = type(getattr(base, param)) if param in SWEPT else float

    def one(job: tuple[int, float]) -> dict:
        k, v = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run {k}")
        try:
            return _run(a, k, v, replace(base, **{param: kind(v)}), x0, b, tolerance, measured)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(1 if measured or a.entries.count() > NEAR_ROWS else max(1, at_once)) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), enumerate(values(param, init, inc, steps))))
    discard(a.entries, b)
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in RUN.split(", ")) for r in rows], RUN)


def step_stats(spark, f) -> DataFrame:
    schema = "step int, nnz_before long, row_singletons int, col_singletons int, luby int, pivots int, nnz_l long, nnz_u long, nnz_after long, search_s double, update_s double, " + ", ".join(f"{p}_s double" for p in PARTS)
    return spark.createDataFrame([tuple(s[c.split()[0]] for c in schema.split(", ")) for s in f.steps], schema)


def run_stats(steps: DataFrame) -> DataFrame:
    return steps.agg(F.count(F.lit(1)).alias("steps"), F.sum("pivots").alias("pivots"), F.avg("pivots").alias("pivots_mean"), F.stddev_pop("pivots").alias("pivots_std"), F.sum("search_s").alias("search_s"), F.sum("update_s").alias("update_s"))
