"""Pivot search: singletons, then an independent set of cheap entries; and the older search by blocks.

e is the active matrix; done counts earlier pivots. Ties go to the smaller row or column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import NEAR_ROWS, metrics_of, near

def col_stats(e: DataFrame) -> DataFrame:
    return e.groupBy("col").agg(F.count(F.lit(1)).alias("col_deg"), F.max(F.abs("val")).alias("col_max"))


def row_degrees(e: DataFrame) -> DataFrame:
    return e.groupBy("row").agg(F.count(F.lit(1)).alias("row_deg"))


def line_stats(e: DataFrame, border: DataFrame | None = None) -> DataFrame:
    """(line, id, deg, biggest, other) of each row and column with entries: their number, largest size, and the least line that crosses.

    line: R rows, C columns, I rows over columns that aren't on the border, C without border columns then. What a step's search asks of the matrix.
    """
    inner = e if border is None else e.join(border.select("col"), "col", "left_anti")
    of = lambda name, x, by, other: x.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("deg"), F.max(F.abs("val")).alias("biggest"), F.min(other).alias("other")).select(F.lit(name).alias("line"), "id", "deg", "biggest", "other")
    both = of("R", e, "row", "col").union(of("C", inner, "col", "row"))
    return both if border is None else both.union(of("I", inner, "row", "col"))


def updated_lines(lines: DataFrame, s: DataFrame, pivots: DataFrame, table: DataFrame, border: DataFrame | None = None, count: int | None = None, touches: int | None = None) -> DataFrame:
    """line_stats() of a step's result s from those before it: only lines that pivots touched are counted anew, pivots' own go.

    table: the step's parts. count: number of pivots, touches: a bound on the touched lines, both if known.
    """
    l, u = table.where("part = 'L'").select(F.lit("R").alias("t_line"), F.col("row").alias("t_id")), table.where("part = 'U'").select(F.lit("C").alias("t_line"), F.col("col").alias("t_id"))  # noqa: E741
    touched = near(l.union(u).distinct(), touches)
    own = pivots.select(F.lit("R").alias("t_line"), F.col("row").alias("t_id")).union(pivots.select(F.lit("C"), "col"))
    kind = F.when(F.col("line") == "C", "C").otherwise("R")
    same = (kind == F.col("t_line")) & (F.col("id") == F.col("t_id"))
    kept = lines.join(touched, same, "left_anti").join(near(own, count and 2 * count), same, "left_anti")
    rows, cols = (s.join(touched.where(f"t_line = '{k}'"), F.col(c) == F.col("t_id"), "left_semi") for k, c in (("R", "row"), ("C", "col")))
    fresh = line_stats(rows, border).where("line <> 'C'").union(line_stats(cols, border).where("line = 'C'"))
    return kept.select("line", "id", "deg", "biggest", "other").union(fresh)


def eligible(e: DataFrame, value_tol: float) -> DataFrame:
    """Entries of at least value_tol times their column's largest."""
    return e.join(col_stats(e), "col").where(F.abs("val") >= F.col("col_max") * value_tol).select("row", "col", "val", "col_max", "col_deg")


def row_singletons(e: DataFrame, border: DataFrame | None = None) -> DataFrame:
    """(row, col) of rows with one entry, one row for each column; border columns don't count."""
    alone = e.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("col")).where("n = 1")
    if border is not None:
        alone = alone.join(border.select("col"), "col", "left_anti")
    return alone.groupBy("col").agg(F.min("row").alias("row")).select("row", "col")


def col_singletons(e: DataFrame, taken: DataFrame) -> DataFrame:
    """(row, col) of columns with one entry whose row and column aren't taken, one column for each row."""
    alone = e.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).where("n = 1")
    free = alone.join(taken.select("row"), "row", "left_anti").join(taken.select("col"), "col", "left_anti")
    return free.groupBy("row").agg(F.min("col").alias("col")).select("row", "col")


def short_columns(e: DataFrame, nb_cols: int) -> DataFrame:
    """Columns no longer than the average, rounded down."""
    limit = e.agg(F.floor(F.count(F.lit(1)) / nb_cols).alias("limit"))
    return col_stats(e).join(F.broadcast(limit), F.col("col_deg") <= F.col("limit")).select("col", "col_deg", "col_max")


def best_rows(e: DataFrame, taken: DataFrame, nb_cols: int, value_tol: float) -> DataFrame:
    """(col, row, val, col_deg, col_max, row_deg, cost): of each short column the eligible row with the least degree."""
    free = e.join(short_columns(e, nb_cols), "col").where(F.abs("val") >= F.col("col_max") * value_tol)
    free = free.join(taken.select("row"), "row", "left_anti").join(taken.select("col"), "col", "left_anti").join(row_degrees(e), "row")
    best = free.groupBy("col").agg(F.min(F.struct("row_deg", "row", "val", "col_deg", "col_max")).alias("b"))
    return best.select("col", "b.row", "b.val", "b.col_deg", "b.col_max", "b.row_deg", ((F.col("b.row_deg") - 1) * (F.col("b.col_deg") - 1)).alias("cost"))


def allowed_cost(best: DataFrame, marko_tol: float) -> DataFrame:
    """(best, allowed), one row; no columns give no allowance."""
    least = F.when(F.min("cost") == 0, 1).otherwise(F.min("cost"))
    return best.agg(least.alias("best")).select("best", F.floor(F.col("best") * marko_tol).cast("long").alias("allowed"))


def candidates(best: DataFrame, marko_tol: float) -> DataFrame:
    """(col, row, cost, score); the larger score wins."""
    return scored(best, allowed_cost(best, marko_tol))


def scored(best: DataFrame, bound: DataFrame) -> DataFrame:
    bound = bound.select("allowed")  # one row
    return best.join(F.broadcast(bound), F.col("cost") <= F.col("allowed")).select("col", "row", "cost", (F.col("cost") / F.col("allowed") + F.col("val") / F.col("col_max")).alias("score"))


def conflicts(e: DataFrame, cands: DataFrame, count: int | None = None) -> DataFrame:
    """(loser): columns that lose to another candidate in whose row they have an entry, or the other way round. count: of the candidates, if known."""
    p = cands.select(F.col("row").alias("p_row"), F.col("col").alias("p_col"), F.col("score").alias("p_score"))
    q = cands.select(F.col("col").alias("q_col"), F.col("score").alias("q_score"))
    met = e.select("row", "col").join(near(p, count), F.col("row") == F.col("p_row")).where("col <> p_col").join(near(q, count), F.col("col") == F.col("q_col"))
    loser = F.when(F.col("p_score") < F.col("q_score"), F.col("p_col")).when(F.col("p_score") > F.col("q_score"), F.col("q_col")).otherwise(F.greatest("p_col", "q_col"))
    return met.select(loser.alias("loser")).distinct()


def independent(e: DataFrame, cands: DataFrame) -> DataFrame:
    return cands.join(conflicts(e, cands), F.col("col") == F.col("loser"), "left_anti")


def ranked(df: DataFrame, groups: list[str]) -> DataFrame:
    """df with at: each row's place from 0 by groups, then col. Summed over blocks of 65,536 columns, so no task orders all rows."""
    df = df.withColumn("block", F.floor(F.col("col") / 65536))
    counts = df.groupBy(*groups, "block").count()
    order = W.orderBy(*groups, "block").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"{c}_") for c in [*groups, "block"]], F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    same = F.col("block") == F.col("block_")
    for c in groups:
        same = same & (F.col(c) == F.col(f"{c}_"))
    inside = F.row_number().over(W.partitionBy(*groups, "block").orderBy("col")) - 1
    return df.join(F.broadcast(before), same).withColumn("at", F.col("before") + inside).drop("before", "block", "block_", *[f"{c}_" for c in groups])


def capped(cands: DataFrame, needed: int) -> DataFrame:
    """The first `needed` candidates by column. Those cut off still knock out others (see conflicts)."""
    return ranked(cands, []).where(F.col("at") < needed).drop("at")


def ordered(rs: DataFrame, cs: DataFrame, luby: DataFrame, done: int, step: int, kind: str = "LUBY") -> DataFrame:
    """perm(pos, row, col, step, kind): row singletons, column singletons, the others; by column within each."""
    every = None
    for rank, name, df in ((0, "RS", rs), (1, "CS", cs), (2, kind, luby)):
        part = df.select(F.lit(rank).alias("rank"), F.lit(name).alias("kind"), "row", "col")
        every = part if every is None else every.union(part)
    return ranked(every, ["rank"]).select((F.col("at") + done).cast("int").alias("pos"), "row", "col", F.lit(step).alias("step"), "kind")


def as_it_is(state: str, df: DataFrame, part: str = "") -> DataFrame:
    """What a search does with its intermediate results unless their times are measured."""
    return df


KINDS = {k: f"count_if(kind = '{k}')" for k in ("RS", "CS", "LUBY", "TP")}


def proposed(e: DataFrame, nb_cols: int, value_tol: float, marko_tol: float, border: DataFrame | None = None, lines: DataFrame | None = None, most: int | None = None, stage=as_it_is) -> DataFrame:
    """(kind, row, col, cost, score): row singletons, column singletons and candidates, in one relation, from line_stats(). most: a bound on the lines, if known."""
    lines = line_stats(e, border) if lines is None else lines
    rows, cols = lines.where("line = 'R'"), lines.where("line = 'C'")
    single = rows.where("deg = 1").select(F.col("id").alias("row"), F.col("other").alias("col"))
    if border is not None:
        single = single.join(border.select("col"), "col", "left_anti")
    rs = single.groupBy("col").agg(F.min("row").alias("row")).select("row", "col")
    alone = cols.where("deg = 1").select(F.col("id").alias("col"), F.col("other").alias("row"))
    cs = alone.join(near(rs.select("row"), most), "row", "left_anti").join(near(rs.select("col"), most), "col", "left_anti").groupBy("row").agg(F.min("col").alias("col")).select("row", "col")
    taken = stage("get singletons", rs.select(F.lit("RS").alias("kind"), "row", "col").union(cs.select(F.lit("CS"), "row", "col")), "candidates")
    limit = cols.agg(F.floor(F.sum("deg") / nb_cols).alias("limit"))
    short = cols.join(F.broadcast(limit), F.col("deg") <= F.col("limit")).select(F.col("id").alias("col"), F.col("deg").alias("col_deg"), F.col("biggest").alias("col_max"))
    short = short.join(near(taken.select("col"), most), "col", "left_anti")
    degrees = lines.where(f"line = '{'R' if border is None else 'I'}'").select(F.col("id").alias("row"), F.col("deg").alias("row_deg")).join(near(taken.select("row"), most), "row", "left_anti")
    free = e.join(near(short, most), "col").where(F.abs("val") >= F.col("col_max") * value_tol).join(near(degrees, most), "row")
    best = free.groupBy("col").agg(F.min(F.struct("row_deg", "row", "val", "col_deg", "col_max")).alias("b"))
    best = stage("get eligible", best.select("col", "b.row", "b.val", "b.col_deg", "b.col_max", "b.row_deg", ((F.col("b.row_deg") - 1) * (F.col("b.col_deg") - 1)).alias("cost")), "candidates")
    bound = stage("auxiliary", allowed_cost(best, marko_tol), "candidates")
    cands = stage("assign score", scored(best, bound), "candidates")
    none = [F.lit(None).cast("long").alias("cost"), F.lit(None).cast("double").alias("score")]
    return taken.select("kind", "row", "col", *none).union(cands.select(F.lit("LUBY"), "row", "col", "cost", "score"))


def search(e: DataFrame, n: int, done: int, step: int, value_tol: float, marko_tol: float, border: DataFrame | None = None, border_cols: int = 0, keep=lambda df, **_: df, needed: int | None = None, lines: DataFrame | None = None, most: int | None = None, stage=as_it_is) -> DataFrame:
    """All pivots of a step. keep: makes an intermediate result cheap to read again. needed: columns to find at most. lines: line_stats(e, border), most: a bound on them, if known.

    Pivots of a step have rows and columns of their own, so singletons can't be more than the columns left. stage: sees each intermediate result, see as_it_is().
    """
    every = keep(proposed(e, max(1, n - done - border_cols), value_tol, marko_tol, border, lines, most, stage), metrics=KINDS)
    rs, cs, cands = (every.where(f"kind = '{k}'").drop("kind") for k in ("RS", "CS", "LUBY"))
    chosen, found = cands, most
    if needed is not None:
        counts = metrics_of(every)
        found = counts["LUBY"]
        left = max(1, needed - 1 - counts["RS"] - counts["CS"])
        chosen = cands if found <= left else capped(cands, left)
    losers = stage("first pass", conflicts(e, cands, found), "merging")
    return stage("discarding pivots", ordered(rs, cs, chosen.join(near(losers, found), F.col("col") == F.col("loser"), "left_anti"), done, step), "merging")


def block_search(e: DataFrame, n: int, done: int, step: int, value_tol: float, marko_tol: float, per_block: int, keep=lambda df: df, stage=as_it_is) -> DataFrame:
    """All pivots of a step by the older search: sets of candidates, each independent, merged in pairs."""
    sets = stage("getting pivots", block_sets(e, keep(block_candidates(e, max(1, n - done), value_tol)), marko_tol, per_block, seed=step), "candidates")
    found = stage("getting pivots", merged_sets(e, sets, keep), "merging")
    none = found.select("row", "col").limit(0)
    return ordered(none, none, found, done, step, kind="TP")


def touched(e: DataFrame, pivots: DataFrame, line: str) -> DataFrame:
    """Lines of the other kind that a pivot line crosses, without pivots: line='row' gives columns."""
    other = "col" if line == "row" else "row"
    crossed = e.join(pivots.select(line), line, "left_semi").select(other).distinct()
    return crossed.join(pivots.select(other), other, "left_anti")


def structures(e: DataFrame, pivots: DataFrame, line: str) -> DataFrame:
    """Lines of the other kind that pivot lines cross, without pivots', and how many of the pivot lines cross each (touches)."""
    other = "col" if line == "row" else "row"
    crossed = e.join(pivots.select(line), line, "left_semi").groupBy(other).agg(F.count(F.lit(1)).alias("touches"))
    return crossed.join(pivots.select(other), other, "left_anti")


def by_cost(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sets of cells as one, in order of cost; equal costs by column."""
    return a.select("row", "col", "cost").union(b.select("row", "col", "cost")).orderBy("cost", "col", "row")


def block_candidates(e: DataFrame, nb_cols: int, value_tol: float) -> DataFrame:
    """(col, row, cost): of each column up to twice the average length, the entry with the least Markowitz product."""
    limit = e.agg((2 * F.floor(F.count(F.lit(1)) / nb_cols)).alias("limit"))
    free = e.join(col_stats(e), "col").where(F.abs("val") >= F.col("col_max") * value_tol).join(F.broadcast(limit), F.col("col_deg") <= F.col("limit")).join(row_degrees(e), "row")
    cost = ((F.col("row_deg") - 1) * (F.col("col_deg") - 1)).alias("cost")
    return free.groupBy("col").agg(F.min(F.struct(cost, F.col("row"))).alias("b")).select("col", "b.row", "b.cost")


def _greedy(rows: list, cols: list, crossed: list) -> list[int]:
    """Positions of cells that no cell accepted before them crosses."""
    used_rows, used_cols, out = set(), set(), []
    for k, (r, c, (over_cols, over_rows)) in enumerate(zip(rows, cols, crossed, strict=True)):
        if r not in used_rows and c not in used_cols:
            out.append(k)
            used_cols.update(over_cols)
            used_rows.update(over_rows)
    return out


def block_sets(e: DataFrame, cands: DataFrame, marko_tol: float, per_block: int = 10, seed: int = 0) -> DataFrame:
    """(block, row, col, cost): within each block of about per_block candidates, those that a greedy pass by cost accepts.

    A candidate is accepted if neither its row nor its column is crossed by one accepted before: those cross each
    column with an entry in their row, and each row with an entry in their column.
    """
    bound = cands.agg(F.floor(F.when(F.min("cost") == 0, 1).otherwise(F.min("cost")) * marko_tol).alias("allowed"))
    cheap = cands.join(F.broadcast(bound), F.col("cost") <= F.col("allowed")).select("row", "col", "cost")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / per_block))
    dealt = cheap.join(F.broadcast(cheap.agg(F.count(F.lit(1)).alias("n")))).select("row", "col", "cost", F.pmod(F.xxhash64("col", F.lit(seed)), blocks).alias("block"))
    in_row = e.join(dealt.select("row"), "row", "left_semi").groupBy("row").agg(F.collect_set("col").alias("cols"))
    in_col = e.join(dealt.select("col"), "col", "left_semi").groupBy("col").agg(F.collect_set("row").alias("rows"))
    full = dealt.join(in_row, "row").join(in_col, "col")

    def accept(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["cost", "col"]).reset_index(drop=True)
        return t.iloc[_greedy(list(t["row"]), list(t["col"]), list(zip(t["cols"], t["rows"], strict=True)))][["block", "row", "col", "cost"]]

    return full.groupBy("block").applyInPandas(accept, "block long, row int, col int, cost long")


def _settled(t: pd.DataFrame) -> pd.DataFrame:
    """The rounds of merged_sets() on a short list (a, b), a before b: what goes."""
    a, b, lost = t["a"].to_numpy(), t["b"].to_numpy(), []
    while len(a):
        now = np.unique(b[~np.isin(a, b)])
        left = ~(np.isin(a, now) | np.isin(b, now))
        a, b = a[left], b[left]
        lost.append(now)
    return pd.DataFrame({"lost": np.concatenate(lost) if lost else np.zeros(0, int)}).astype("int32")


def merged_sets(e: DataFrame, sets: DataFrame, keep=lambda df: df, few: int = NEAR_ROWS) -> DataFrame:
    """One independent set of the blocks' sets: block after block, larger ones first, with what those before don't cross.

    Cells that cross each other are listed once, from the matrix. Then rounds settle all blocks at once: a cell stays once no open cell before it crosses
    it, and what it crosses goes, so a round settles every cell whose rivals before it are settled. What comes out is what going through
    the blocks one after the other would give; nothing orders all blocks, and the list shrinks from round to round, until one task takes its last `few` rows.
    """
    sets = keep(sets)
    sizes = sets.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    place = F.struct((-F.col("size")).alias("size"), F.xxhash64("block", F.lit(17)).alias("of"), "block", "cost", "col")
    cells = keep(sets.join(sizes, "block").select("row", "col", "cost", place.alias("place")))
    p, q = (cells.select(F.col("row").alias(f"row_{c}"), F.col("col").alias(c), F.col("place").alias(f"place_{c}")) for c in ("a", "b"))
    met = e.select("row", "col").join(p, F.col("row") == F.col("row_a")).where("col <> a").join(q, F.col("col") == F.col("b"))
    first = F.col("place_a") < F.col("place_b")
    rivals = keep(met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b")).distinct())
    gone = None
    while rivals.count() > few:
        later = rivals.select(F.col("b").alias("later"))
        now = keep(rivals.join(later, F.col("a") == F.col("later"), "left_anti").select(F.col("b").alias("lost")).distinct())
        gone = now if gone is None else gone.union(now)
        rivals = keep(rivals.join(now, F.col("a") == F.col("lost"), "left_anti").join(now, F.col("b") == F.col("lost"), "left_anti"))
    rest = keep(rivals.groupBy().applyInPandas(_settled, "lost int"))
    gone = rest if gone is None else gone.union(rest)
    return cells.select("row", "col", "cost").join(gone, F.col("col") == F.col("lost"), "left_anti")
