"""Singly bordered block diagonal form: rows in blocks, columns interior to one block or on the border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialize


def contiguous(spark, m: int, num_blocks: int) -> DataFrame:
    """(row, block) by equal ranges; any other map does as well."""
    size = -(-m // num_blocks)
    return spark.range(m).select(F.col("id").cast("int").alias("row"), F.floor(F.col("id") / size).cast("int").alias("block"))


def grown(e: DataFrame, m: int, num_blocks: int, rounds: int = 8, slack: float = 1.25) -> DataFrame:
    """(row, block): a partition of the hypergraph of rows (vertices) and columns (edges) into blocks with few columns across.

    Starts from equal ranges. In each round every row looks at how many of its neighbours, rows that share a column with it, are in each
    block, long columns counting less (1 / length); a hashed half of the rows moves to the block with the most of them, as long
    as blocks stay below slack times their equal share: of those that want into a block, as many go as have room, by gain.
    Columns count rows by block first, so a column with many rows costs num_blocks rows, not pairs.
    """
    now = materialize(contiguous(e.sparkSession, m, num_blocks))
    room = int(slack * -(-m // num_blocks))
    pattern = materialize(e.select("row", "col").distinct())  # each round reads it three times
    best = None
    for k in range(rounds + 1):
        cut = pattern.join(now, "row").groupBy("col").agg(F.countDistinct("block").alias("n")).where("n > 1").count()
        if best is None or cut < best[0]:
            best = (cut, now)
        if k == rounds or not cut:
            break
        counts = pattern.join(now, "row").groupBy("col", "block").agg(F.count(F.lit(1)).alias("c"))
        size = counts.groupBy(F.col("col").alias("k")).agg(F.sum("c").alias("size"))
        pull = counts.join(size, F.col("col") == F.col("k")).select("col", F.col("block").alias("to"), (F.col("c") / F.col("size")).alias("w"))
        votes = pattern.join(pull, "col").groupBy("row", "to").agg(F.sum("w").alias("w"))
        top = votes.groupBy("row").agg(F.max(F.struct("w", (-F.col("to")).alias("to"))).alias("t"), F.map_from_entries(F.collect_list(F.struct("to", "w"))).alias("all"))
        moves = now.join(top, "row").select("row", "block", (-F.col("t.to")).alias("to"), (F.col("t.w") - F.coalesce(F.col("all")[F.col("block")], F.lit(0.0))).alias("gain")).where((F.col("to") != F.col("block")) & (F.col("gain") > 0) & (F.pmod(F.xxhash64("row", F.lit(k)), F.lit(2)) == 0))
        free = now.groupBy(F.col("block").alias("b")).agg((F.lit(room) - F.count(F.lit(1))).alias("free"))
        # Of those that want into a block as many go as have room, the largest gains first, in 1,000 classes of gain.
        classed = moves.withColumn("class", F.floor(F.least(F.col("gain"), F.lit(9.99)) * 100))
        by_class = classed.groupBy("to", "class").count().withColumn("up_to", F.sum("count").over(W.partitionBy("to").orderBy(F.desc("class"))))
        fits = by_class.join(free, F.col("to") == F.col("b")).where(F.col("up_to") <= F.col("free")).select("to", "class")
        going = classed.join(F.broadcast(fits), ["to", "class"]).select("row", F.col("to").alias("next"))
        now = materialize(now.join(going, "row", "left").select("row", F.coalesce("next", "block").cast("int").alias("block")))
    return best[1]


def row_blocks(assigned: DataFrame) -> DataFrame:
    """(row, block, pos): pos counts through blocks, by row within each."""
    sizes = assigned.groupBy("block").count()
    before = sizes.select(F.col("block").alias("b"), F.coalesce(F.sum("count").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return assigned.join(F.broadcast(before), F.col("block") == F.col("b")).select("row", "block", (F.col("before") + F.row_number().over(W.partitionBy("block").orderBy("row")) - 1).cast("int").alias("pos"))


def col_blocks(e: DataFrame, rows: DataFrame) -> DataFrame:
    """(col, block): block null on the border."""
    span = e.join(rows.select("row", "block"), "row").groupBy("col").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    return span.select("col", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("block"))


def border(e: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(block, col): border columns that a block's rows touch."""
    edge = cols.where("block is null").select("col")
    return e.join(edge, "col", "left_semi").join(rows.select("row", "block"), "row").select("block", "col").distinct()


def block_entries(e: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(block, row, col, val, interior): rows count from the block's first."""
    first = rows.groupBy("block").agg(F.min("pos").alias("first"))
    own = rows.join(first, "block").select("row", "block", (F.col("pos") - F.col("first")).alias("local"))
    kind = cols.select("col", F.col("block").alias("cb"))
    return e.join(own, "row").join(kind, "col").select("block", F.col("local").cast("int").alias("row"), "col", "val", F.col("cb").isNotNull().alias("interior"))


def local_columns(e: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(block, col, local): columns of each block counted from 0, interior ones first, by col within both kinds."""
    inside = cols.where("block is not null").select("block", "col", F.lit(0).alias("edge"))
    both = inside.union(border(e, rows, cols).select("block", "col", F.lit(1)))
    return both.select("block", "col", (F.row_number().over(W.partitionBy("block").orderBy("edge", "col")) - 1).cast("int").alias("local"))


def block_sizes(e: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(block, n_rows, n_interior, nnz, n_border)."""
    r = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))
    c = cols.where("block is not null").groupBy("block").agg(F.count(F.lit(1)).alias("n_interior"))
    z = e.join(rows.select("row", "block"), "row").groupBy("block").agg(F.count(F.lit(1)).alias("nnz"))
    b = border(e, rows, cols).groupBy("block").agg(F.count(F.lit(1)).alias("n_border"))
    out = r.join(c, "block", "left").join(z, "block", "left").join(b, "block", "left")
    return out.select("block", "n_rows", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_interior", "nnz", "n_border")])


def block_stats(sizes: DataFrame) -> DataFrame:
    out = None
    for what in ("n_rows", "n_interior", "nnz"):
        row = sizes.agg(F.lit(what).alias("what"), F.avg(what).alias("avg"), F.stddev_pop(what).alias("std"), F.max(what).alias("max"), F.min(what).alias("min"))
        out = row if out is None else out.union(row)
    return out


def border_stats(e: DataFrame, cols: DataFrame) -> DataFrame:
    """(n_border, nnz_border): columns on the border and their entries, one row."""
    edge = cols.where("block is null").select(F.col("col").alias("k"))
    counted = e.join(edge, F.col("col") == F.col("k"), "left_semi").agg(F.countDistinct("col").alias("n_border"), F.count(F.lit(1)).alias("nnz_border"))
    return counted


def violations(e: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(violations): interior columns that leave their block, border columns within one, and the identity of sizes."""
    span = e.join(rows.select("row", "block"), "row").groupBy("col").agg(F.countDistinct("block").alias("n")).join(cols.withColumnRenamed("block", "cb"), "col")
    wrong = span.agg(F.count(F.when((F.col("cb").isNotNull() & (F.col("n") > 1)) | (F.col("cb").isNull() & (F.col("n") < 2)), 1)).alias("w"))
    s = block_sizes(e, rows, cols).agg(F.sum(F.col("n_rows") - F.col("n_interior")).alias("left"))
    b = cols.agg(F.count(F.when(F.col("block").isNull(), 1)).alias("border"))
    return wrong.crossJoin(s).crossJoin(b).select((F.col("w") + F.when(F.col("left") == F.col("border"), 0).otherwise(1)).cast("long").alias("violations"))  # one row each
