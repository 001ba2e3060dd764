"""y = A x kept up to date while entries of A arrive; x is a static vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_spmv(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(row, y) of all entries so far; a streaming input gives an update-mode aggregate, a static one the product."""
    return entries.join(x, F.col("col") == F.col("i")).groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("y"))
