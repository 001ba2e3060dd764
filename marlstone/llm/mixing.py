"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is budget * weight / size, where size is the number of its characters and budget
the number of characters wanted. Each document gets a Poisson count with that mean by inverting the
distribution at a uniform number hashed from (seed, doc_id): the same document always gets the same count. A rate over
PIECE is split into equal parts, each inverted at a uniform number of its own (the part's number is hashed too), and the
counts are added: a sum of Poissons is one, and exp(-rate) stays far from the least double.
Copies are exploded and shuffled globally by a second hash, under which each partition is sorted.
DataFrame operations only. The weights are a parameter, so the rate table has at most as many rows as the
weights have keys and may be broadcast; sizes are summed before they are shuffled.

Nulls: a null source is the source ''; a null n_chars counts as the text's length, a null text has length 0;
a null doc_id hashes as the word 'null'. Rows that repeat a doc_id get the same count each. A source that
has no characters gets rate 1. An empty table gives an empty result. Further columns pass through; columns
named copy and shuffle_key in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_null, table

SEED = "mix-1"
#: Target weights of the query by source; the other sources share `other` by size.
WEIGHTS = {f"src{i}": w for i, w in enumerate([0.04, 0.04, 0.06, 0.06, 0.08, 0.08, 0.10, 0.10, 0.06, 0.06])}
OTHER = 0.32
#: Largest rate that is inverted at once.
PIECE = 500.0


def uniform(seed: str, *parts: Column) -> Column:
    """52 hashed bits in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cumulative(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, ... up to beyond all 52-bit uniforms."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s, k):
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def rates(docs: DataFrame, weights: dict[str, float], other: float, budget: float | None) -> DataFrame:
    """(source, rate), at most len(weights) + 1 rows; the last has source null and stands for all others."""
    spark = docs.sparkSession
    bad = [w for w in [*weights.values(), other] if not w >= 0 or w == float("inf")]
    if bad or sum(weights.values()) + other <= 0:
        raise ValueError(f"weights must be finite, not negative and not all 0: {bad}")
    wanted = spark.createDataFrame([*weights.items(), (None, other)], "source string, weight double")
    named = F.col("source").isin(*weights) if weights else F.lit(False)
    size = F.coalesce(F.col("n_chars"), F.length(blank_null())).cast("long")
    sizes = docs.select(F.coalesce("source", F.lit("")).alias("source"), size.alias("size")).select(F.when(named, F.col("source")).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    share = F.col("weight") / F.lit(sum(weights.values()) + other)
    total = sizes.agg(F.sum("size").alias("total"))
    wish = (F.lit(float(budget)) if budget is not None else F.col("total").cast("double")) * share
    joined = wanted.join(F.broadcast(sizes.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).join(F.broadcast(total))
    return joined.select("source", F.when(F.col("size") > 0, wish / F.col("size")).otherwise(1.0).alias("rate"))


def _free(count: int, taken: list[str]) -> list[str]:
    """Names of columns that the input doesn't have, in any case."""
    known, out, k = {c.lower() for c in taken}, [], 0
    while len(out) < count:
        if f"mix_{k}" not in known:
            out.append(f"mix_{k}")
        k += 1
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, other: float = OTHER, budget: float | None = None, seed: str = SEED) -> DataFrame:
    """docs replicated to the weights and shuffled; adds copy (from 0) and shuffle_key."""
    weights = WEIGHTS if weights is None else weights
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    s, cdf, m, n = _free(4, docs.columns)
    table_ = rates(docs, weights, other, budget).select(F.col("source").alias(s), cumulative(F.col("rate") / pieces).alias(cdf), pieces.alias(m))
    named = F.coalesce("source", F.lit(""))
    key = F.when(named.isin(*weights), named) if weights else F.lit(None).cast("string")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    uniforms = F.transform(F.sequence(F.lit(0), F.col(m) - 1), lambda k: F.when(k == 0, uniform(seed, id_)).otherwise(uniform(seed, id_, k.cast("string"))))
    count = F.aggregate(uniforms, F.lit(0), lambda k, u: k + F.size(F.filter(cdf, lambda c: c <= u)))
    rows = docs.drop("copy", "shuffle_key").join(F.broadcast(table_), key.eqNullSafe(F.col(s)))
    copies = rows.withColumn(n, count).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n, s, cdf, m)
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed + "-order"), id_, F.col("copy"))))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


_CASES = " ".join(f"WHEN '{k}' THEN '{k}'" for k in WEIGHTS)
_ROWS = ", ".join([*(f"('{k}', {v!r}::DOUBLE)" for k, v in WEIGHTS.items()), f"(NULL, {OTHER!r}::DOUBLE)"])
ORACLE = f"""
WITH RECURSIVE d AS (SELECT *, CASE source {_CASES} END AS s FROM documents),
w(s, weight) AS (VALUES {_ROWS}),
z AS (SELECT s, sum(coalesce(n_chars, length(coalesce(text, ''))))::BIGINT AS size FROM d GROUP BY s),
r AS (SELECT w.s, CASE WHEN size > 0 THEN ((SELECT sum(size) FROM z)::DOUBLE * (weight / {sum(WEIGHTS.values()) + OTHER!r}::DOUBLE)) / size ELSE 1 END AS rate
      FROM w JOIN z ON w.s IS NOT DISTINCT FROM z.s),
c AS (SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
      UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
u AS (SELECT d.*, ('0x' || substr(md5('{SEED}|' || doc_id), 1, 13))::BIGINT::DOUBLE / {float(2**52)!r} AS u FROM d),
n AS (SELECT any_value(u.text) AS text, u.doc_id, any_value(u.lang) AS lang, any_value(u.source) AS source, any_value(u.n_chars) AS n_chars, count(*) FILTER (c.cdf <= u.u) AS n
      FROM u JOIN c ON u.s IS NOT DISTINCT FROM c.s GROUP BY u.doc_id)
SELECT doc_id, text, lang, source, n_chars, i::INT AS copy, md5('{SEED}-order|' || doc_id || '|' || i) AS shuffle_key
FROM (SELECT *, unnest(range(n)) AS i FROM n)
"""
