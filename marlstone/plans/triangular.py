"""Triangular solves by levels that are multiplied together.

Pivots of one level (a kind of a step) don't meet, so a level of L or U is an operator v -> v + N v with N N = 0, and a solve
is the product of all levels. Going level by level costs a job each, many of them tiny. Here neighbouring
levels are joined first: (I + N2)(I + N1) = I + N1 + N2 + N2 N1, and the products N2 N1 of all pairs of a round are one join
over one table, so k levels take about log2(k) rounds. A pair is joined only if its product has at most `growth` times the
entries that its levels had to begin with; what can't be joined stays a level of its own. Solving then is one join and one sum for each level that is
left, and the joined levels serve any number of right-hand sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize, near

#: Entries of a product to those of the levels behind it.
GROWTH = 4.0


@dataclass(frozen=True)
class Levels:
    """entries(level, row, col, val): v[row] += val * v[col], level 0 first; k levels, `before` before any were joined. most: bounds on the levels' entries.

    Where a level's entries are few they are broadcast, else both sides are shuffled: the vector, as long as the matrix, never meets the driver.
    """

    entries: DataFrame
    k: int
    before: int
    most: tuple[int, ...]

    def apply(self, v: DataFrame) -> DataFrame:
        """(i, x) after all levels; the last sum isn't written."""
        was = None
        for level in range(self.k):
            v = materialize(v)
            if was is not None:
                discard(was)
            was = v
            here = self.entries.where(F.col("level") == level).select("row", "col", "val")
            more = near(here, self.most[level]).join(v.hint("merge"), F.col("col") == F.col("i")).select(F.col("row").alias("i"), (F.col("val") * F.col("x")).alias("x"))
            v = v.select("i", "x").union(more).groupBy("i").agg(F.sum("x").alias("x"))
        return v


def _renamed(new: list[int], old: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in new)), old + 1)


def joined(entries: DataFrame, k: int, growth: float = GROWTH) -> Levels:
    """The levels 0 to k - 1 of (level, row, col, val), pairs of neighbours joined for as long as they stay sparse."""
    now, before = materialize(entries.select("level", "row", "col", "val"), by=["level"]), k
    sizes = {r.level: r["count"] for r in now.groupBy("level").count().collect()}  # a row for each level
    own = [sizes.get(t, 0) for t in range(k)]
    most = list(own)
    while k > 1:
        pair = F.expr("level div 2").cast("int")
        second = now.where(f"level % 2 = 1 and level < {k // 2 * 2}").select(pair.alias("t"), "row", F.col("col").alias("mid"), F.col("val").alias("a"))
        first = now.where(f"level % 2 = 0 and level < {k // 2 * 2}").select(pair.alias("t"), F.col("row").alias("mid"), "col", F.col("val").alias("b"))
        product = materialize(second.join(first, ["t", "mid"]).groupBy("t", "row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("val")))
        made = {r.t: r["count"] for r in product.groupBy("t").count().collect()}
        fine = [made.get(t, 0) <= growth * max(1, own[2 * t] + own[2 * t + 1]) for t in range(k // 2)]
        if not any(fine):
            discard(product)
            break
        new, sums, bounds = [], [], []
        for level in range(k):
            if level % 2 and fine[level // 2]:
                new.append(new[-1])
                sums[-1] += own[level]
                bounds[-1] += most[level] + made.get(level // 2, 0)
            else:
                new.append(len(sums))
                sums.append(own[level])
                bounds.append(most[level])
        kept = product.where(F.element_at(F.array(*(F.lit(x) for x in fine)), F.col("t") + 1))
        both = now.select(_renamed(new, F.col("level")).alias("level"), "row", "col", "val").union(kept.select(_renamed(new, F.col("t") * 2).alias("level"), "row", "col", "val"))
        was, now = now, materialize(both.groupBy("level", "row", "col").agg(F.sum("val").alias("val")), by=["level"])
        discard(was, product)
        k, own, most = len(sums), sums, bounds
    return Levels(now, k, before, tuple(most))
