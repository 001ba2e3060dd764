"""Text formats: triplet files ('n nnz', then 'col row val', 1-based, by column), vectors, Rutherford-Boeing."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import Matrix


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file with their numbers, from Spark's text reader."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    part = lines.withColumn("part", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND((1 << 33) - 1))
    sizes = part.groupBy("part").count()
    before = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return part.join(F.broadcast(before), F.col("part") == F.col("p")).select((F.col("before") + F.col("at")).alias("n"), "value")


def read_triplets(spark: SparkSession, path: str) -> Matrix:
    """A square matrix. Entries must be as many as the header says, in order of columns, no column skipped."""
    lines = _numbered(spark, path)
    head = lines.where("n = 0").first()
    fields = (head.value if head else "").split()
    if len(fields) < 2:
        raise ValueError("header 'n nnz' expected")
    n, nnz = int(fields[0]), int(fields[1])
    parts = F.split(F.trim("value"), "\\s+")
    body = lines.where("n > 0 and trim(value) <> ''").select("n", (F.try_element_at(parts, F.lit(2)).try_cast("int") - 1).alias("row"), (F.try_element_at(parts, F.lit(1)).try_cast("int") - 1).alias("col"), F.try_element_at(parts, F.lit(3)).try_cast("double").alias("val"))
    step = F.col("col") - F.lag("col").over(W.partitionBy("chunk").orderBy("n"))
    chunked = body.withColumn("chunk", F.floor(F.col("n") / 100_000))
    edges = chunked.groupBy("chunk").agg(F.min_by("col", "n").alias("first"), F.max_by("col", "n").alias("last")).withColumn("gap", F.col("first") - F.lag("last").over(W.orderBy("chunk")))
    wrong = chunked.withColumn("step", step).where("step is not null and step not in (0, 1)").limit(1).count() + edges.where("gap is not null and gap not in (0, 1)").limit(1).count()
    if wrong:
        raise ValueError("entries aren't sorted by column, or a column is empty")
    if body.count() != nnz:
        raise ValueError(f"{nnz} entries expected")
    return Matrix.of(body.select("row", "col", "val"), n, n)


def read_rutherford_boeing(spark: SparkSession, path: str) -> Matrix:
    """Assembled real (or pattern, as ones) matrices in fixed columns; the lower triangle of symmetric ones is mirrored."""
    lines = _numbered(spark, path)
    head = {r.n: r.value for r in lines.where("n < 4").collect()}
    _, ptr, ind, _ = (int(x) for x in head[1].split()[:4])
    kind, m, n, nnz = head[2].split()[:4]
    widths = [int(re.search(r"[IEDFGiedfg](\d+)", f)[1]) for f in re.findall(r"\([^)]*\)", head[3])]
    m, n, nnz = int(m), int(n), int(nnz)

    def numbers(start: int, count: int, width: int, most: int, kind_: str) -> DataFrame:
        per = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length(F.rtrim("value")) - 1) / width).cast("int")), lambda k: F.trim(F.substring(F.col("value"), k * width + 1, F.lit(width)))))
        cells = lines.where(f"n >= {start} and n < {start + count}").select((F.col("n") - start).alias("line"), per.alias("k", "text"))
        each = cells.where("line = 0").count() or 1
        return cells.select((F.col("line") * each + F.col("k")).alias("i"), F.regexp_replace("text", "[dD]", "E").cast(kind_).alias("x")).where(f"i < {most}")

    pointers = numbers(4, ptr, widths[0], n + 1, "long")
    rows = numbers(4 + ptr, ind, widths[1], nnz, "int")
    spans = pointers.withColumn("to", F.lead("x").over(W.orderBy("i"))).where("to is not null").select(F.col("i").cast("int").alias("col"), F.explode(F.when(F.col("to") > F.col("x"), F.sequence("x", F.col("to") - 1))).alias("k"))
    base = spans.join(rows, F.col("k") - 1 == F.col("i")).select((F.col("x") - 1).alias("row"), "col", (F.col("k") - 1).alias("k"))
    if kind[0].lower() == "p":
        entries = base.withColumn("val", F.lit(1.0))
    else:
        vals = numbers(4 + ptr + ind, 1 << 40, widths[2], nnz, "double")
        entries = base.join(vals, F.col("k") == F.col("i")).withColumnRenamed("x", "val")
    entries = entries.select("row", "col", "val")
    if kind[1].lower() in "sz":
        sign = -1 if kind[1].lower() == "z" else 1
        entries = entries.union(entries.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("val") * sign))
    return Matrix.of(entries, m, n)


def read_matrix(spark: SparkSession, path: str, fmt: str | None = None) -> Matrix:
    """By format, else by extension: .mtl or .rb."""
    fmt = fmt or PurePosixPath(path).suffix.lstrip(".")
    readers = {"mtl": read_triplets, "rb": read_rutherford_boeing}
    if fmt not in readers:
        raise ValueError(f"unknown format {fmt!r}")
    return readers[fmt](spark, path)


def default_vector(spark: SparkSession, n: int) -> DataFrame:
    """x_i = i + 1."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1).cast("double").alias("x"))


def read_vector(spark: SparkSession, n: int, path: str | None = None) -> DataFrame:
    """'index unused value' lines of a .mtl file, whose indices must be 1..n in order; else x_i = i + 1."""
    if not path or not path.endswith(".mtl"):
        return default_vector(spark, n)
    parts = F.split(F.trim("value"), "\\s+")
    rows = _numbered(spark, path).where("trim(value) <> ''").select("n", F.get(parts, F.lit(0)).try_cast("long").alias("index"), F.get(parts, F.lit(2)).try_cast("double").alias("x"))
    if rows.where("index is null or x is null or index <> n + 1").limit(1).count() or rows.count() != n:
        raise ValueError("vector lines must be numbered 1 to n")
    return rows.select(F.col("n").cast("int").alias("i"), "x")


def write_triplets(matrix: Matrix, path: str) -> None:
    """One text file in order of columns, values in full precision."""
    spark, e = matrix.entries.sparkSession, matrix.entries
    body = e.select(F.col("col").alias("a"), F.col("row").alias("b"), F.concat_ws("\t", (F.col("col") + 1).cast("string"), (F.col("row") + 1).cast("string"), F.col("val").cast("string")).alias("value"))
    head = spark.createDataFrame([(-1, -1, f"{matrix.n}\t{e.count()}")], "a int, b int, value string")
    head.union(body).repartitionByRange(1, "a", "b").sortWithinPartitions("a", "b").select("value").write.text(path)
