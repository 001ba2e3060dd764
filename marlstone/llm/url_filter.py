"""URL filters by a temporal list join.

List entries are dated events on a host or a domain: (key, action, listed_on), action being block, allow or
remove. An entry is valid from its date to the day before the next event on the same key; remove only ends
the one before. Every capture is joined as of its fetch date with the entries of its host and of each parent
domain; the longest key that is active decides. DataFrame operations only. Intervals are cut into buckets
of `bucket_days`, so the join is an equality on (key, bucket) with at most one bucket's intervals per
capture; a small interval table, whose size is counted first, is broadcast, a larger one is shuffled and
left to the skew join.

Events of one key on one day: block beats allow beats remove. Events without key or date and unknown actions
are left out. Captures without url, with a host over 253 characters or without one get verdict 'invalid',
those without a date 'undated'. Rows repeated in whole collapse; other columns of the captures aren't read,
so names that clash do no harm. Empty tables: no captures give no rows, no entries make all 'keep'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: A broadcast interval table has at most so many rows (of about 100 bytes).
BROADCAST_ROWS = 200_000
FIRST = "2024-01-01"
DAYS = 365


def host(url: Column) -> Column:
    h = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when((F.length(h) > 0) & (F.length(h) <= 253), h)


def keys(h: Column) -> Column:
    """The host and its parents down to two labels."""
    labels = F.split(h, "\\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): valid_to excluded, null where open."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    days = entries.select(F.lower("key").alias("key"), rank.alias("rank"), F.col("listed_on").cast("date").alias("valid_from")).where("key is not null and valid_from is not null and rank is not null").groupBy("key", "valid_from").agg(F.max("rank").alias("rank"))
    spans = days.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("key").orderBy("valid_from")))
    return spans.where("rank > 0").select("key", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), "valid_from", "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_on", bucket_days: int = 30, last_day: str = "2035-12-31", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per distinct capture: id, url, fetched_on, host, verdict, entry_key, entry_from.

    Open intervals are cut at last_day; a capture after it is looked up in the last bucket.
    """
    number = lambda c: F.floor(F.datediff(F.least(c, F.lit(last_day).cast("date")), F.lit("1970-01-01").cast("date")) / bucket_days)
    spans = intervals(entries)
    end = F.coalesce(F.date_sub("valid_to", 1), F.lit(last_day).cast("date"))
    few = spans.limit(broadcast_rows + 1).count() <= broadcast_rows
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("date").alias("fetched_on"))
    exploded = base.distinct().withColumn("host", host(F.col("url"))).withColumn("key", F.explode_outer(keys(F.col("host"))))
    if few:
        joined = exploded.join(F.broadcast(spans.withColumnRenamed("key", "k")), (F.col("key") == F.col("k")) & (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))), "left")
    else:
        cut = spans.withColumn("bucket", F.explode(F.sequence(number(F.col("valid_from")), F.greatest(number(end), number(F.col("valid_from")))))).withColumnRenamed("key", "k")
        joined = exploded.withColumn("b", number(F.col("fetched_on"))).join(cut, (F.col("key") == F.col("k")) & (F.col("b") == F.col("bucket")) & (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to"))), "left")
    best = F.max(F.when(F.col("k").isNotNull(), F.struct(F.length("k").alias("n"), F.col("k"), F.col("action"), F.col("valid_from"))))
    found = joined.groupBy("id", "url", "fetched_on", "host").agg(best.alias("best"))
    verdict = F.when(F.col("host").isNull(), "invalid").when(F.col("fetched_on").isNull(), "undated").when(F.col("best.action") == "block", "block").when(F.col("best.action") == "allow", "allow").otherwise("keep")
    return found.select(F.col("id").alias(id_col), "url", "fetched_on", "host", verdict.alias("verdict"), F.col("best.k").alias("entry_key"), F.col("best.valid_from").alias("entry_from"))


def dated_list(pages: DataFrame) -> DataFrame:
    """The query's list, made by a rule from the hosts seen: about a third of hosts and every domain get dated events."""
    h = pages.select(host(F.col("url")).alias("host")).where("host is not null").distinct()
    every = h.select(F.explode(keys(F.col("host"))).alias("key")).distinct()
    u = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit(FIRST).cast("date"), n.cast("int"))
    marked = every.withColumn("u", u)
    events = F.array(
        F.struct(F.lit("block").alias("action"), day(F.col("u") % 200).alias("listed_on"), (F.col("u") % 3 == 0).alias("on")),
        F.struct(F.lit("remove").alias("action"), day(F.col("u") % 200 + 60).alias("listed_on"), ((F.col("u") % 3 == 0) & (F.col("u") % 2 == 0)).alias("on")),
        F.struct(F.lit("allow").alias("action"), day(F.col("u") % 150 + 20).alias("listed_on"), (F.col("u") % 5 == 0).alias("on")),
        F.struct(F.lit("block").alias("action"), day(F.col("u") % 90 + 250).alias("listed_on"), (F.size(F.split("key", "\\.")) == 2).alias("on")),
    )
    return marked.select("key", F.explode(events).alias("e")).where("e.on").select("key", "e.action", "e.listed_on")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no fetch dates: capture i counts as fetched on day i mod 365 of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_on", F.date_add(F.lit(FIRST).cast("date"), (F.col("page_id") % DAYS).cast("int")))
    return filter_urls(pages, dated_list(pages))


ORACLE = f"""
WITH p AS (SELECT DISTINCT page_id, url, (DATE '{FIRST}' + (page_id % {DAYS})::INT)::DATE AS fetched_on FROM pages),
h AS (SELECT *, nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') AS host FROM p),
x AS (SELECT *, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS key FROM h WHERE length(host) <= 253),
u AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::INT AS u FROM (SELECT DISTINCT key FROM x)),
e AS (SELECT key, 2 AS rank, DATE '{FIRST}' + u % 200 AS d FROM u WHERE u % 3 = 0
  UNION ALL SELECT key, 0, DATE '{FIRST}' + (u % 200 + 60) FROM u WHERE u % 6 = 0
  UNION ALL SELECT key, 1, DATE '{FIRST}' + (u % 150 + 20) FROM u WHERE u % 5 = 0
  UNION ALL SELECT key, 2, DATE '{FIRST}' + (u % 90 + 250) FROM u WHERE len(string_split(key, '.')) = 2),
s AS (SELECT key, max(rank) AS rank, d::DATE AS d, lead(d::DATE) OVER (PARTITION BY key ORDER BY d::DATE) AS till FROM e GROUP BY key, d::DATE),
m AS (SELECT x.page_id, x.url, x.fetched_on, x.key, s.rank, s.d, row_number() OVER (PARTITION BY x.page_id, x.url, x.fetched_on ORDER BY length(x.key) DESC, x.key DESC) AS n
  FROM x JOIN s ON x.key = s.key AND s.rank > 0 AND x.fetched_on >= s.d AND (s.till IS NULL OR x.fetched_on < s.till))
SELECT h.page_id, h.url, h.fetched_on, CASE WHEN length(host) <= 253 THEN host END AS host,
  CASE WHEN host IS NULL OR length(host) > 253 THEN 'invalid' WHEN h.fetched_on IS NULL THEN 'undated' WHEN m.rank = 2 THEN 'block' WHEN m.rank = 1 THEN 'allow' ELSE 'keep' END AS verdict,
  m.key AS entry_key, m.d AS entry_from
FROM h LEFT JOIN m ON n = 1 AND h.page_id = m.page_id AND h.url IS NOT DISTINCT FROM m.url
"""
