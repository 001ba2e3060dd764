"""What a step's pivots do to the matrix: factors out, Schur update in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import near

def _at(e: DataFrame, pivots: DataFrame, count: int | None = None, *more: str) -> DataFrame:
    """e with the positions of its row's and its column's pivot, where they are pivots. count: of the pivots, if known."""
    r = near(pivots.select(F.col("row").alias("pr"), F.col("pos").alias("row_pos"), *more), count)
    c = near(pivots.select(F.col("col").alias("pc"), F.col("pos").alias("col_pos")), count)
    return e.join(r, F.col("row") == F.col("pr"), "left").join(c, F.col("col") == F.col("pc"), "left").select("row", "col", "val", "row_pos", "col_pos", *more)


def diagonal(e: DataFrame, pivots: DataFrame) -> DataFrame:
    """d(pivot, row, col, val)."""
    return e.join(pivots.select("row", "col", "pos"), ["row", "col"]).select(F.col("pos").alias("pivot"), "row", "col", "val")


def lower(e: DataFrame, pivots: DataFrame) -> DataFrame:
    """l(pivot, row, val): the rest of pivot columns over the pivot; entries left of their row's own pivot."""
    d = diagonal(e, pivots).select(F.col("pivot").alias("p"), F.col("val").alias("by"))
    below = _at(e, pivots).where("col_pos is not null and (row_pos is null or row_pos > col_pos)")
    return below.join(d, F.col("col_pos") == F.col("p")).select(F.col("col_pos").alias("pivot"), "row", (F.col("val") / F.col("by")).alias("val"))


def upper(e: DataFrame, pivots: DataFrame) -> DataFrame:
    """u(row, col, val, pivot): the rest of pivot rows, unscaled."""
    return _at(e, pivots).where("row_pos is not null and (col_pos is null or row_pos < col_pos)").select("row", "col", "val", F.col("row_pos").alias("pivot"))


def schur(e: DataFrame, pivots: DataFrame, l: DataFrame, u: DataFrame) -> DataFrame:  # noqa: E741
    """S - L U on what is no pivot's; cancelled entries stay as 0."""
    rest = e.join(pivots.select("row"), "row", "left_anti").join(pivots.select("col"), "col", "left_anti").select("row", "col", "val")
    left = l.join(pivots.select("row"), "row", "left_anti").select(F.col("pivot").alias("p"), "row", F.col("val").alias("lv"))
    right = u.join(pivots.select("col"), "col", "left_anti").select("pivot", "col", F.col("val").alias("uv"))
    less = right.join(left, F.col("pivot") == F.col("p")).select("row", "col", (-F.col("uv") * F.col("lv")).alias("val"))
    return rest.unionByName(less).groupBy("row", "col").agg(F.sum("val").alias("val"))


def step(e: DataFrame, pivots: DataFrame, count: int | None = None, nnz: int | None = None, stage=lambda state, df, part: df) -> DataFrame:
    """(part, pivot, row, col, val, kind): L, D, U and S of a step in one relation, so a step is one table. kind: D rows' alone.

    count: of the pivots, nnz: of e, if known: then small sides of joins are broadcast, and only the sum of S is shuffled.
    stage: sees each part, see pivots.as_it_is().
    """
    none, nobody = F.lit(None).cast("int"), F.lit(None).cast("string")
    at = _at(e, pivots, count, "kind")
    d = at.where("row_pos = col_pos").select(F.lit("D").alias("part"), F.col("row_pos").alias("pivot"), "row", "col", "val", "kind", F.lit(False).alias("rest"))
    by = near(e.join(near(pivots.select("row", "col", "pos"), count), ["row", "col"]).select(F.col("pos").alias("p"), F.col("val").alias("by")), count)
    l = at.where("col_pos is not null and (row_pos is null or row_pos > col_pos)").join(by, F.col("col_pos") == F.col("p"))  # noqa: E741
    l = l.select(F.lit("L"), "col_pos", "row", none, (F.col("val") / F.col("by")).alias("val"), nobody, F.col("row_pos").isNull())  # noqa: E741
    ld = stage("update L", d.union(l), "ld")
    u = at.where("row_pos is not null and (col_pos is null or row_pos < col_pos)")
    u = stage("update S rows", u.select(F.lit("U").alias("part"), F.col("row_pos").alias("pivot"), "row", "col", "val", nobody.alias("kind"), F.col("col_pos").isNull().alias("rest")), "u")
    left = ld.where("part = 'L' and rest").select(F.col("pivot").alias("p"), F.col("row").alias("i"), F.col("val").alias("lv"))
    less = u.where("rest").join(near(left, nnz), F.col("pivot") == F.col("p")).select(F.col("i").alias("row"), "col", (-F.col("val") * F.col("lv")).alias("val"))
    s = at.where("row_pos is null and col_pos is null").select("row", "col", "val").union(less).groupBy("row", "col").agg(F.sum("val").alias("val"))
    s = stage("update S cols", s.select(F.lit("S").alias("part"), none.alias("pivot"), "row", "col", "val", nobody.alias("kind")), "s")
    return ld.drop("rest").union(u.drop("rest")).union(s)
