"""What the operators share: shared storage, word splitting, components, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_dir

__all__ = ["SPACE", "arrow_map", "blank_null", "connected_components", "discard", "materialize", "one_row_per_id", "parallelism", "possible", "shared_dir", "slices", "table"]

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def blank_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def one_row_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows without an id go; of rows that repeat an id, the smallest text stays (null counts as empty)."""
    return docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(blank_null(text)).alias(text))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that a task's memory holds what a few texts need; at the end memory goes back to the system,
    as Python workers live on."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)
    pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def possible(rows: DataFrame, ids: DataFrame, key: str = "doc_id", most_words: int = 1 << 20) -> DataFrame:
    """The rows whose key is among ids (one column, any number), and a few others: spares most others the shuffle of a join.

    The ids set bits in 64-bit words, about four in each, so one row in sixteen passes by chance. At most `most_words`
    words are broadcast, so beyond four times as many ids more rows pass by chance, but none is ever lost.
    """
    name = ids.columns[0]
    words = max(1, min(most_words, ids.count() // 4 + 1))
    word = lambda c: f"pmod(xxhash64(cast({c} as bigint), 5), {words})"
    bit = lambda c: f"shiftleft(1L, cast(pmod(xxhash64(cast({c} as bigint), 6), 64) as int))"
    bits = ids.groupBy(F.expr(word(name)).alias("__word")).agg(F.expr(f"bit_or({bit(name)})").alias("__bits"))
    return rows.join(F.broadcast(bits), (F.expr(word(key)) == F.col("__word")) & (F.col("__bits").bitwiseAND(F.expr(bit(key))) != 0)).select(rows.columns)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of an edge list: component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node links its larger (then its smaller) neighbours
    to the least one it sees, so edges never multiply and long chains halve. Every round is written to the
    shared folder; only a count reaches the driver: of nodes that still have two links down, or one down and one up. Nodes
    without an edge don't appear; null ends and self-loops are left out.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(now.select("v", F.lit(0)))
        open_ = ends.groupBy("node").agg(F.sum("down").alias("downs"), F.count(F.lit(1)).alias("links")).where("downs > 1 or (downs = 1 and links > 1)")
        if open_.count() == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        was, now = now, materialize(small.where("u <> v").distinct())
        discard(was)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
