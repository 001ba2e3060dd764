"""Layouts, permutations and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def compressed(e: DataFrame, by: str) -> DataFrame:
    """(by, cells): CSC view with by='col', CSR view with by='row'."""
    other = "row" if by == "col" else "col"
    return e.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(other, "val"))).alias("cells"))


def line_extent(e: DataFrame, by: str) -> DataFrame:
    """(id, nnz, first, last) of each column or row that has entries."""
    other = "row" if by == "col" else "col"
    return e.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("nnz"), F.min(other).alias("first"), F.max(other).alias("last"))


def sizes(e: DataFrame, by: str, n: int) -> DataFrame:
    """(id, nnz) with empty ones."""
    every = e.sparkSession.range(n).select(F.col("id").cast("int").alias("id"))
    counted = e.groupBy(F.col(by).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return every.join(counted, F.col("id") == F.col("k"), "left").select("id", F.coalesce("c", F.lit(0)).cast("long").alias("nnz"))


def permute(e: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """rows and cols: perm(pos, idx); position pos takes line idx."""
    r = rows.select(F.col("pos").alias("rp"), F.col("idx").alias("ri"))
    c = cols.select(F.col("pos").alias("cp"), F.col("idx").alias("ci"))
    return e.join(r, F.col("row") == F.col("ri")).join(c, F.col("col") == F.col("ci")).select(F.col("rp").cast("int").alias("row"), F.col("cp").cast("int").alias("col"), "val")


def to_dense(e: DataFrame, m: int, n: int) -> DataFrame:
    """Every cell, missing ones 0; for small matrices."""
    spark = e.sparkSession
    cells = spark.range(m * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    return cells.join(e, (F.col("i") == F.col("row")) & (F.col("j") == F.col("col")), "left").select(F.col("i").alias("row"), F.col("j").alias("col"), F.coalesce("val", F.lit(0.0)).alias("val"))


def random_permutation(ids: DataFrame, seed: int = 0) -> DataFrame:
    """perm(pos, idx) in the order of hashes, by buckets of the hash, so no task sorts everything."""
    from pyspark.sql import Window as W

    h = ids.select(F.col("idx"), F.xxhash64("idx", F.lit(seed)).alias("h")).withColumn("b", F.shiftright("h", 52))
    counts = h.groupBy("b").count().select(F.col("b").alias("k"), F.coalesce(F.sum("count").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return h.join(F.broadcast(counts), F.col("b") == F.col("k")).select((F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("h", "idx")) - 1).cast("int").alias("pos"), "idx")


def numbered(ids: DataFrame, key: str) -> DataFrame:
    """(idx, pos): key's values, each at most once, and their places in order. Ranges are counted in tasks of their own; a row for each range meets the driver."""
    spark = ids.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    ranged = materialize(ids.select(F.col(key).alias("idx")).repartitionByRange(n, "idx").sortWithinPartitions("idx").select("idx", F.monotonically_increasing_id().alias("at")))
    split = ranged.select("idx", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    before, rows = 0, []
    for r in sorted(split.groupBy("range").count().collect()):
        rows.append((r[0], before))
        before += r[1]
    starts = F.broadcast(spark.createDataFrame(rows, "start long, before long"))
    return split.join(starts, F.col("range") == F.col("start")).select("idx", (F.col("before") + F.col("within")).cast("int").alias("pos"))


def random_dense(spark, m: int, n: int, seed: int = 0) -> DataFrame:
    """Deterministic values in [0, 10), the diagonal four times as large."""
    cells = spark.range(m * n).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    u = F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(10_000_019)) / 1_000_001.9
    return cells.withColumn("val", F.when(F.col("row") == F.col("col"), u * 4).otherwise(u))


def without(e: DataFrame, cells: DataFrame, strict: bool = False) -> DataFrame:
    """e less the cells; strict: cells that aren't there are refused."""
    if strict and cells.join(e.select("row", "col"), ["row", "col"], "left_anti").limit(1).count():
        raise ValueError("a cell to delete isn't there")
    return e.join(cells.select("row", "col"), ["row", "col"], "left_anti")


def added(e: DataFrame, more: DataFrame) -> DataFrame:
    return e.unionByName(more).groupBy("row", "col").agg(F.sum("val").alias("val"))


#: A node of level k spans 2^(BITS k) values; levels reach over all longs.
BITS, LEVELS = 2, 32


def _nodes(lo: str, hi: str):
    """The fewest aligned nodes that make up [lo, hi), as an array of (level, node): at each level what lacks a whole parent on either side."""
    def step(s, level):
        up, down = -F.shiftright(-s["lo"], BITS), F.shiftright(s["hi"], BITS)
        whole = (up <= down) & (level < LEVELS - 1)
        left, right = F.when(whole, F.shiftleft(up, BITS)).otherwise(s["hi"]), F.when(whole, F.shiftleft(down, BITS)).otherwise(s["hi"])
        run = lambda a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda n: F.struct(level.alias("level"), n.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        return F.struct(F.when(whole, up).otherwise(F.lit(0)).cast("long").alias("lo"), F.when(whole, down).otherwise(F.lit(0)).cast("long").alias("hi"), F.concat(s["nodes"], run(s["lo"], left), run(right, s["hi"])).alias("nodes"))

    start = F.struct(F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), F.array().cast("array<struct<level:int,node:bigint>>").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step)["nodes"]


def points_in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points' columns beside those of each range (with lo and hi, hi excluded) that holds their `at`; names must differ.

    A range is cut into aligned nodes, a few a level, and a point lies in one node of each level, so a hash join on (level, node) meets
    each pair once. Points look only into levels that some range uses (at most LEVELS, counted first).
    """
    nodes = ranges.where("lo < hi").withColumn("__n", F.explode(_nodes("lo", "hi"))).select("*", F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node")).drop("__n")
    used = sorted(r[0] for r in nodes.select("__level").distinct().collect())
    if not used:
        return points.join(ranges, F.lit(False))
    at = points.withColumn("__of", F.explode(F.array(*(F.lit(k) for k in used)))).withColumn("__in", F.expr(f"shiftright(cast(at as bigint), {BITS} * __of)"))
    return at.join(nodes, (F.col("__of") == F.col("__level")) & (F.col("__in") == F.col("__node"))).drop("__of", "__in", "__level", "__node")


def ranges_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How each range of a (id, lo, hi; hi excluded) meets those of b: begin, end, total or inner.

    Two ranges meet if one's start lies in the other: b's in a's, or a's in b's behind its start. Both are joins of points in ranges, by hash. Empty ranges meet nothing.
    """
    x, y = (df.where("lo < hi").select(F.col("id").alias(f"{c}_id"), F.col("lo").alias(f"{c}l"), F.col("hi").alias(f"{c}h")) for df, c in ((a, "a"), (b, "b")))
    first = points_in_ranges(y.withColumn("at", F.col("bl")), x.withColumn("lo", F.col("al")).withColumn("hi", F.col("ah")))
    behind = points_in_ranges(x.withColumn("at", F.col("al")), y.withColumn("lo", F.col("bl") + 1).withColumn("hi", F.col("bh")))
    kind = F.when((F.col("al") <= F.col("bl")) & (F.col("ah") >= F.col("bh")), "total").when((F.col("al") >= F.col("bl")) & (F.col("ah") <= F.col("bh")), "inner").when(F.col("al") < F.col("bl"), "end").otherwise("begin")
    both = first.select("a_id", "b_id", "al", "ah", "bl", "bh").union(behind.select("a_id", "b_id", "al", "ah", "bl", "bh"))
    return both.select("a_id", "b_id", kind.alias("kind"))
