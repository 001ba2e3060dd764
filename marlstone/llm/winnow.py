"""Document fingerprints by winnowing.

A text's units are its words, longer ones cut every 12 code points, so texts without white space have
units too. Each unit is hashed once (XXH64 modulo the prime 2^31 - 1), and the k-grams get Rabin and Karp's rolling hash, the units'
hashes as digits of a number to a fixed base modulo that prime: from one k-gram to the next the first digit leaves and another
enters, no unit is read twice. Of every `window`
consecutive hashes the least is chosen, the rightmost of equals, and kept with its position. So any match of
at least window + k - 1 units shares a chosen hash (10 with the defaults), and matches under k units are
never seen. Texts with fewer hashes than a window choose their least one; texts under k units hash as a whole (those without any to 0).

The fingerprint is written as one 16-digit hex number per chosen position, in order of position: 31 bits of
hash, 32 bits that count down from the greatest position. Likeness is Jaccard's of the sets of chosen hashes.
DataFrame expressions only: the window's minimum is found by doubling (minima of 2, 4, 8, ... neighbours), as hash
and position share a number that makes the rightmost of equals the least.

Next document: ids are range partitioned; each partition finds its neighbours by a window, and the first of
the partition below follows the last of the one above. Only ids take part (with a row per partition at
the end); texts are shuffled by id, then once more, cut to what the edit needs, to the document before.

Nulls: a null text is empty; rows without doc_id are left out; of rows that repeat an id the smallest text
stays. Other columns aren't read. An empty table gives no rows. A document that is alone follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import blank_null, materialize, one_row_per_id, parallelism, table

K = 3
#: A power of two.
WINDOW = 8
UNIT = "[\\x20\\x09-\\x0D]+|(?<=\\G.{12})"
_LOW = 2**32 - 1
PRIME, BASE = 2**31 - 1, 1_103_515_245


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen (hash, position) numbers of a text, in order of position."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    return F.transform(F.array(F.filter(F.split(text, UNIT), lambda x: x != "")), lambda units: _minima(_hashes(units, k), window))[0]


def _hashes(units: Column, k: int) -> Column:
    def rolled(u: Column) -> Column:
        def gram(i: Column) -> Column:
            h = F.coalesce(F.get(u, i), F.lit(0))
            for j in range(1, k):
                h = (h * BASE + F.coalesce(F.get(u, i + j), F.lit(0))) % PRIME
            return h

        n = F.greatest(F.size(u) - (k - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(gram(i), 32) + (F.lit(_LOW) - i))

    return F.transform(F.array(F.transform(units, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME)))), rolled)[0]


def _with_later(step: int):
    """Each element or the one step further on, whichever is less."""
    return lambda a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + step)))


def _minima(h: Column, window: int) -> Column:
    span = 1
    while span < window:
        h = F.transform(F.array(h), _with_later(span))[0]
        span *= 2
    size = window - 1

    def last(a: Column) -> Column:
        full = F.greatest(F.size(a) - size, F.lit(1))
        return F.array_distinct(F.slice(a, 1, full))

    return F.transform(F.array(h), last)[0]


def hashes_of(numbers: Column) -> Column:
    return F.array_distinct(F.transform(numbers, lambda x: F.shiftrightunsigned(x, 32).cast("int")))


def written(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard's of two sets that aren't empty."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def followers(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, next_id): the next lower id; after the lowest comes the highest."""
    spark = ids.sparkSession
    dealt = materialize(ids.repartitionByRange(parallelism(spark), key).withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("next_id", F.lag(key).over(W.partitionBy("part").orderBy(key)))
    ends = dealt.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))  # a row per partition
    order = W.orderBy("part")
    below = ends.select(F.col("part").alias("p"), F.coalesce(F.lag("high").over(order), F.max("high").over(W.partitionBy())).alias("under"))
    return inside.join(F.broadcast(below), F.col("part") == F.col("p")).select(key, F.coalesce("next_id", "under").alias("next_id"))


def fingerprint_pairs(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint, that of its edit, and how like it is to its edit and to the next document."""
    base = one_row_per_id(docs)
    links = followers(docs.where("doc_id is not null").select("doc_id").distinct())
    sized = base.withColumn("n_chars", F.length("text").cast("long"))
    own = sized.withColumn("numbers", chosen(F.col("text"), k, window))
    back = links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"))
    need = sized.select("doc_id", "n_chars").join(back.withColumnRenamed("doc_id", "n"), F.col("doc_id") == F.col("before")).select(F.col("n").alias("doc_id"), "before", F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    sent = own.join(need, "doc_id").select(F.col("before").alias("b"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"), hashes_of(F.col("numbers")).alias("next_hashes"))
    joined = own.join(sent, F.col("doc_id") == F.col("b"))
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    edited = joined.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), keep), F.col("head"))).withColumn("edited_numbers", chosen(F.col("edited"), k, window)).withColumn("hashes", hashes_of(F.col("numbers")))
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), written(F.col("numbers")).alias("fingerprint"), written(F.col("edited_numbers")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes_of(F.col("edited_numbers"))).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
