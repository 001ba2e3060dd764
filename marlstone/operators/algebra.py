"""Vectors, products and norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def axpby(a: DataFrame, alpha: float, b: DataFrame, beta: float) -> DataFrame:
    """alpha a + beta b; an index that one of them lacks fails the query."""
    y = b.select(F.col("i").alias("j"), F.col("x").alias("y"))
    same = F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), F.col("i")).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("int"))
    return a.join(y, F.col("i") == F.col("j"), "full").select(same.alias("i"), (F.col("x") * alpha + F.col("y") * beta).alias("x"))


def permute_vector(v: DataFrame, perm: DataFrame) -> DataFrame:
    """v'[pos] = v[idx]."""
    return perm.join(v, F.col("idx") == F.col("i")).select(F.col("pos").alias("i"), "x")


def norm2(v: DataFrame) -> DataFrame:
    return v.agg(F.coalesce(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(0.0)).alias("norm2"))


def spmv(e: DataFrame, v: DataFrame, m: int) -> DataFrame:
    """A x with rows that have no entry as 0."""
    every = e.sparkSession.range(m).select(F.col("id").cast("int").alias("i"))
    y = e.join(v.withColumnRenamed("i", "k"), F.col("col") == F.col("k")).groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("y"))
    return every.join(y, F.col("i") == F.col("row"), "left").select("i", F.coalesce("y", F.lit(0.0)).alias("x"))


def norm_inf(e: DataFrame) -> DataFrame:
    return e.groupBy("row").agg(F.sum(F.abs("val")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norm_inf"))


def density(e: DataFrame, m: int, n: int) -> DataFrame:
    return e.agg(F.count(F.lit(1)).alias("nnz"), (F.count(F.lit(1)) / F.lit(float(m) * n)).alias("density"))


def max_abs(v: DataFrame) -> DataFrame:
    return v.agg(F.coalesce(F.max(F.abs("x")), F.lit(0.0)).alias("max_abs"))


def backward_error(e: DataFrame, x: DataFrame, b: DataFrame, m: int) -> DataFrame:
    """|A x - b| / (|A|inf |x| + |b|)."""
    r = norm2(axpby(spmv(e, x, m), 1.0, b, -1.0)).withColumnRenamed("norm2", "r")
    parts = r.crossJoin(norm_inf(e)).crossJoin(norm2(x).withColumnRenamed("norm2", "nx")).crossJoin(norm2(b).withColumnRenamed("norm2", "nb"))  # one row each
    return parts.select((F.col("r") / (F.col("norm_inf") * F.col("nx") + F.col("nb"))).alias("backward_error"))
