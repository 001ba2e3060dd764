"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir); docs has the columns of documents. Each but the last returns those columns and
no others; extra ones, whatever their names, are dropped. What all stages do with odd rows: a null text counts as empty and stays null; a
null lang, source or n_chars is kept as it is; texts are read whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm import decontaminate, mixing, near_copies, quality, token_binary
from marlstone.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, that is, with a probability over one half of low quality or toxicity.

    Ties at one half stay, and so do null and empty texts (nothing speaks against them) and rows without a doc_id, if their
    text is fine. Rows that repeat a doc_id are judged each.
    """
    return quality.filter_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in 5-word shingles only the one with the least doc_id stays.

    Exactly 0.8 links. Null, empty and blank texts are copies of each other. Of rows that repeat a doc_id the one
    with the least text stays (null least, then the least of the other columns), linked through the id to what any of them is linked to. Rows without a doc_id
    can't be told apart and all stay.
    """
    docs = docs.select(COLUMNS)
    keep = near_copies.near_copies(docs).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    left = docs.join(keep, F.col("doc_id") == F.col("id"), "left_semi")
    first = W.partitionBy("doc_id").orderBy(*COLUMNS[1:])
    one = left.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(COLUMNS)
    return one.union(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    All rows of a doc_id go if any of them holds one. Null and empty texts hold none. Rows without a doc_id stay. Items
    without an item_id or without words aren't looked for.
    """
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in a global shuffle.

    A count comes from a row's doc_id, so rows that repeat one get the same count each, and rows without one share a
    count. A null source is a source of its own without a named weight.
    """
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the mix's order, read back: doc_id, start, n_tokens, ids_crc32 of each copy.

    Each row gives a row, repeated or not, also without a doc_id; null and empty texts are the end id alone.
    """
    return token_binary.encode_documents(docs, by_id=False)


STAGES = [
    ("quality classifier", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix_sources),
    ("token binary", write_tokens),
]

#: EM, components and a tokenizer are beyond SQL. tests/llm hold near duplicates, decontamination and token files against brute force, the classifier against labels held out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
