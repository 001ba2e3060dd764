"""Consistency checks; each gives one row with the number of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations"))


def duplicates(e: DataFrame, *by: str) -> DataFrame:
    return _count(e.groupBy(*(by or ("row", "col"))).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def same_pattern(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("row", "col"), b.select("row", "col")
    return _count(x.subtract(y).union(y.subtract(x)))


def permutation(perm: DataFrame, n: int, index: str = "idx") -> DataFrame:
    """Positions and indices each 0..n-1 once."""
    facts = perm.agg(F.count(F.lit(1)).alias("c"), F.countDistinct("pos").alias("p"), F.countDistinct(index).alias("i"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min(index).alias("il"), F.max(index).alias("ih"))
    ok = (F.col("c") == n) & (F.col("p") == n) & (F.col("i") == n) & ((F.col("c") == 0) | ((F.col("lo") == 0) & (F.col("hi") == n - 1) & (F.col("il") == 0) & (F.col("ih") == n - 1)))
    return facts.select(F.when(ok, 0).otherwise(1).cast("long").alias("violations"))


def pivots_emptied(s: DataFrame, pivots: DataFrame) -> DataFrame:
    return _count(s.join(pivots.select("row"), "row", "left_semi").select("row", "col").union(s.join(pivots.select("col"), "col", "left_semi").select("row", "col")))


def independence(e: DataFrame, pivots: DataFrame) -> DataFrame:
    """Entries off the diagonal of the square that the pivots' rows and columns span."""
    p = pivots.select(F.col("row").alias("r"), F.col("col").alias("own"))
    inside = e.join(p, F.col("row") == F.col("r")).join(pivots.select("col"), "col", "left_semi").where("col <> own")
    return _count(inside)


def logical_sum(e: DataFrame, pivots: DataFrame, step: DataFrame) -> DataFrame:
    """Columns and rows that a step's pivots cross, computed from the matrix, against those that U and L of the step have outside the pivots."""
    u = step.where("part = 'U'").select("col").distinct().join(pivots.select("col"), "col", "left_anti")
    l = step.where("part = 'L'").select("row").distinct().join(pivots.select("row"), "row", "left_anti")  # noqa: E741
    cols = e.join(pivots.select("row"), "row", "left_semi").select("col").distinct().join(pivots.select("col"), "col", "left_anti")
    rows = e.join(pivots.select("col"), "col", "left_semi").select("row").distinct().join(pivots.select("row"), "row", "left_anti")
    return _count(cols.exceptAll(u).union(u.exceptAll(cols)).union(rows.exceptAll(l)).union(l.exceptAll(rows)))


def touched_once(e: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pivots' rows and columns that other pivots of the set cross: each must be touched by its own pivot alone."""
    in_rows = e.join(pivots.select("row"), "row", "left_semi").join(pivots.select("col"), "col", "left_semi")
    return _count(in_rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n <> 1").select("row").union(in_rows.groupBy("col").agg(F.count(F.lit(1)).alias("n")).where("n <> 1").select("col")))


def maximal(e: DataFrame, pivots: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates that no pivot's row or column crosses, though they aren't pivots."""
    cols = e.join(pivots.select("row"), "row", "left_semi").select("col").distinct()
    rows = e.join(pivots.select("col"), "col", "left_semi").select("row").distinct()
    return _count(cands.join(cols, "col", "left_anti").join(rows, "row", "left_anti"))


def same_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(violations): lines whose statistics aren't the same in both."""
    both = a.select("*", F.lit(1).alias("n")).union(b.select("*", F.lit(-1)))
    return both.groupBy("line", "id", "deg", "biggest", "other").agg(F.sum("n").alias("n")).agg(F.count(F.when(F.col("n") != 0, 1)).alias("violations"))
