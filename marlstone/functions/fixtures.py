"""Matrices derived from the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dominant(spark: SparkSession, off: DataFrame, n: int) -> DataFrame:
    """Off-diagonal sums with a diagonal one larger than each row's sum."""
    od = off.groupBy("row", "col").agg(F.sum("val").alias("val")).where("row <> col")
    every = od.select("row", "val").union(spark.range(n).select(F.col("id").cast("int"), F.lit(0.0)))
    dg = every.groupBy("row").agg((F.sum("val") + 1).alias("val")).select("row", F.col("row").alias("col"), "val")
    return od.select("row", "col", "val").union(dg)


def parts_square(spark: SparkSession, sf_dir: str) -> Matrix:
    n = table(spark, sf_dir, "part").count()
    li = table(spark, sf_dir, "lineitem").where("l_quantity <= 2")
    off = li.select(F.expr(f"cast((l_orderkey * 7) % {n} as int)").alias("row"), F.expr(f"cast(l_partkey % {n} as int)").alias("col"), F.col("l_quantity").alias("val"))
    return Matrix(_dominant(spark, off, n), n, n)


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, x): the parts' retail prices as a vector."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("i"), F.col("p_retailprice").alias("x"))


def parts_blocks(spark: SparkSession, sf_dir: str, num_blocks: int = 4) -> Matrix:
    n = table(spark, sf_dir, "part").count()
    bs = n // num_blocks
    li = table(spark, sf_dir, "lineitem").where("l_quantity <= 2")
    col = f"case when l_quantity = 1 and l_linenumber = 1 then l_partkey % {n} else ((l_orderkey * 7 % {n}) div {bs}) * {bs} + l_partkey % {bs} end"
    off = li.select(F.expr(f"cast((l_orderkey * 7) % {n} as int)").alias("row"), F.expr(f"cast({col} as int)").alias("col"), F.col("l_quantity").alias("val"))
    return Matrix(_dominant(spark, off, n), n, n)


def part_supplier(spark: SparkSession, sf_dir: str) -> Matrix:
    m, n = table(spark, sf_dir, "part").count(), table(spark, sf_dir, "supplier").count()
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("int").alias("row"), F.col("l_suppkey").cast("int").alias("col")).agg(F.sum("l_quantity").alias("val"))
    return Matrix(e, m, n)


def user_event(spark: SparkSession, sf_dir: str) -> Matrix:
    """Counts by user_id and the event type's rank."""
    events = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    types = events.select("event_type").distinct().withColumn("col", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))
    e = events.join(F.broadcast(types), "event_type").groupBy(F.col("user_id").cast("int").alias("row"), "col").agg(F.count(F.lit(1)).cast("double").alias("val"))
    last = events.agg(F.max("user_id")).first()[0]
    return Matrix(e, 0 if last is None else last + 1, types.count())
