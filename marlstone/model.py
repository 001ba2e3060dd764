"""Matrices as DataFrames entry(row, col, val), 0-based, and the parameters of a factorisation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matrix:
    """entries: row INT, col INT, val DOUBLE, each (row, col) at most once; m rows, n columns."""

    entries: DataFrame
    m: int
    n: int

    @staticmethod
    def of(df: DataFrame, m: int, n: int, duplicates: str = "reject") -> Matrix:
        """Checks ranges and duplicates; duplicates='sum' adds equal places up."""
        e = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("val").cast("double").alias("val"))
        bad = e.where(f"row is null or col is null or val is null or row < 0 or col < 0 or row >= {m} or col >= {n}").limit(1).count()
        if bad:
            raise ValueError("an entry is null or out of range")
        if duplicates == "sum":
            e = e.groupBy("row", "col").agg(F.sum("val").alias("val"))
        elif e.groupBy("row", "col").count().where("count > 1").limit(1).count():
            raise ValueError("duplicate entries")
        return Matrix(e, m, n)


@dataclass(frozen=True)
class SolverParams:
    value_tol: float = 0.1
    marko_tol: float = 4.0
    nb_candidates_per_block: int = 10
    nb_previous_pivots: int = 5
    min_pivot_per_steps: int = 5
    density_tolerance: float = 0.2
    #: Largest dense part, in rows, that one task factorises; a larger one is held in blocks of dense_block rows and columns.
    max_dense_schur: int = 2_000
    dense_block: int = 512
    #: 'independent': singletons, then an independent set by score; 'blocks': sets of nb_candidates_per_block, merged in pairs.
    pivot_strategy: str = "independent"

    def __post_init__(self):
        for name in ("value_tol", "density_tolerance"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in 0..1")
        for name in ("marko_tol", "nb_candidates_per_block", "nb_previous_pivots", "max_dense_schur", "dense_block"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.pivot_strategy not in ("independent", "blocks"):
            raise ValueError("pivot_strategy must be independent or blocks")
        if self.min_pivot_per_steps < self.nb_previous_pivots:
            raise ValueError("min_pivot_per_steps must be at least nb_previous_pivots")


@dataclass
class Factors:
    """l(pivot, row, val), d(pivot, row, col, val), u(row, col, val, pivot), perm(pos, row, col, step, kind) of the
    sparse part; dense(row, col, val): what is left, to be factorised densely."""

    m: int
    n: int
    l: DataFrame  # noqa: E741
    d: DataFrame
    u: DataFrame
    perm: DataFrame
    dense: DataFrame
    done: int
    params: SolverParams
    steps: list[dict] = field(default_factory=list)
    reason: str = ""
    #: What solves keep for further ones.
    kept: dict = field(default_factory=dict)
