"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Whether shuffle files go when a query ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, one in /tmp, but only for a local master:
    on a cluster every machine would write to its own disk."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        shared_dir.own = root
    return f"{root.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


#: Most bytes that a Python worker is sent at once while long rows are written.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOCK, _WRITERS = threading.Lock(), {}


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold while any thread writes such a table; what they were before comes back after the last."""
    with _LOCK:
        for key, value in values.items():
            n, before = _WRITERS.get(key, (0, None))
            if not n:
                before = spark.conf.get(key)
                spark.conf.set(key, value)
            _WRITERS[key] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            for key in values:
                n, before = _WRITERS[key]
                _WRITERS[key] = n - 1, before
                if n == 1:
                    spark.conf.set(key, before)


def materialize(df: DataFrame, by: list[str] | None = None, metrics: dict[str, str] | None = None, group: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once.

    by: columns of few values that get a folder for each value, so that a filter on them reads no other.
    metrics: aggregates (SQL) that are observed while the table is written, so that they take no job of their own; metrics_of() has them.
    group: rows of a row group at most, for long rows: a read holds up to 4,096 rows of a row group at once.

    The table stands in for the shuffles behind it, so their files go as soon as it is written.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    seen = Observation() if metrics else None
    if seen:
        df = df.observe(seen, *(F.expr(c).alias(k) for k, c in metrics.items()))
    with _set(spark, **{CLEANUP: "true"} | ({BATCH: "16m"} if group else {})):
        write = df.write.option("compression", "zstd")  # half of what the default leaves of texts
        (write.option("parquet.block.row.count.limit", group) if group else write).parquet(path, partitionBy=by)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path, table._metrics = path, seen.get if seen else {}
    return table


def metrics_of(table: DataFrame) -> dict[str, int]:
    return table._metrics


#: Rows of a few numbers that may be broadcast (some 10 MB).
NEAR_ROWS = 200_000


def near(df: DataFrame, rows: int | None) -> DataFrame:
    """df as a broadcast side if its number of rows, or a bound on it, is known to be small; with more, a side that is shuffled and merged, as
    Spark would broadcast a table whose compressed file is small, however many rows it has; as it is if nothing is known."""
    if rows is None:
        return df
    return F.broadcast(df) if rows <= NEAR_ROWS else df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that no later step reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._shared_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
