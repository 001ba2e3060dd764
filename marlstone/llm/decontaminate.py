"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders: a number is a run of digits with inner . or , and maybe a sign;
a unit is a word of UNITS right after a number; a name is a capitalised word within a sentence. Everything is
lower-cased and loses punctuation at the ends of words. Windows of `width` canonical words are hashed
and joined with those of the benchmark. Hits of a document and an item are counted by alignment (place in the
document less place in the item, so that a passage's hits meet). An alignment's coverage is counted together with those of its
neighbours within `slack` words, since an inserted or lost word shifts the rest; where it covers at least `threshold` of the
item's windows, the words themselves are compared, at the alignment with the most hits of its neighbours and at each that
reaches the threshold by itself. A word of the item counts as found if it lies in `width` words in a row that are equal there; else the
neighbours are asked in order of distance. At least `threshold` of the item's words must be found (that share is the coverage): hits of neighbours count
the same windows again where a text repeats itself, as tables of numbers do. What is found must be consistent in its slots, that is, equal values of the item stand for
equal values of the document and different ones for different ones. What passes is a leak: 'exact' if all words
are found in a row and all slots kept their values, 'edited' if words are lost, changed or inserted, 'reparameterised' if slots have other values.
Of an item's alignments in a document that pass, exact ones come first, then edited ones, then those
with the most hits, then the earliest.

Items under `width` words have no window. They are leaks, 'whole', where a line of a document has their words and no others; inside a
line they are too common to tell.

DataFrame expressions only. Documents are scanned once: their windows are exploded beside the scan and only those
whose hash the benchmark has go on, to a partial sum by (document, item, alignment). The benchmark's window hashes
are broadcast if a count finds at most `broadcast_rows` of them; else both sides are shuffled by hash. A window
that many items share names them all by one hash row, and hits are joined with the items after the filter. Only texts with hits, and a few others by
chance, are shuffled to be compared.

Nulls: null texts are empty; rows without an id (of either table) are left out. Rows that repeat a doc_id are texts of their own; the best leak of any
counts. Items that repeat an item_id keep the smallest text. Extra columns aren't read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_null, materialize, one_row_per_id, possible, table

WIDTH = 5
THRESHOLD = 0.8
SLACK = 3
BROADCAST_ROWS = 1_000_000
UNITS = "mm|cm|m|km|mg|g|kg|t|ml|l|s|sec|min|h|hours?|days?|weeks?|months?|years?|minutes?|seconds?|met(?:er|re)s?|kilomet(?:er|re)s?|miles?|feet|inch(?:es)?|pounds?|ounces?|grams?|kilograms?|lit(?:er|re)s?|percent|dollars?|euros?|cents?|degrees?|watts?|volts?"
#: Placeholders: private-use characters, which texts can't be taken to hold otherwise.
NUMBER, NAME, UNIT = "", "", ""


def clean(text: Column) -> Column:
    """Words parted by single spaces; private-use marks of the input become '?'."""
    return F.trim(F.regexp_replace(F.translate(text, NUMBER + NAME + UNIT, "???"), "[\\x20\\x09-\\x0D]+", " "))


def canonical(cleaned: Column) -> Column:
    """The template, word for word as long as the input."""
    t = F.regexp_replace(cleaned, "(?<=[^.!?:;] )\\p{Lu}\\p{Ll}[\\p{L}'’-]*", NAME)
    t = F.regexp_replace(t, "[+-]?\\d+(?:[.,]\\d+)*", NUMBER)
    t = F.regexp_replace(t, f"(?<={NUMBER}) ?(?i:{UNITS})(?![\\p{{L}}\\p{{N}}])", f" {UNIT}")
    t = F.regexp_replace(t, f"{NUMBER} {UNIT}", f"{NUMBER} {UNIT}")
    return F.lower(F.regexp_replace(t, "(?<=[\\p{L}\\p{N}-])[^\\p{L}\\p{N}\\s-]+(?= |$)", ""))


def words(t: Column) -> Column:
    return F.split(t, " ")


def windows(tokens: Column, width: int) -> Column:
    """Hashes of all runs of width words, by place; none for shorter texts."""

    def of(a: Column) -> Column:
        n = F.size(a) - (width - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(width)]))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(tokens), of)[0]


def slots(raw: Column, template: Column) -> Column:
    """(value, slot) of each word: the value where the template has a placeholder, else null."""
    return F.zip_with(raw, template, lambda r, t: F.struct(F.when(t.rlike(f"[{NUMBER}{NAME}{UNIT}]"), F.regexp_replace(r, "[^\\p{L}\\p{N}.,+-]|[.,]+$", "")).alias("v"), t.alias("t")))


def split_units(cleaned: Column) -> Column:
    """A unit that touches its number becomes a word of its own, so that words and template stay aligned."""
    return F.regexp_replace(cleaned, f"(?<=\\d)(?=(?i:{UNITS})(?![\\p{{L}}\\p{{N}}]))", " ")


def prepared(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, row (tells texts of one key apart), cleaned."""
    return df.where(F.col(key).isNotNull()).select(F.col(key), F.xxhash64(blank_null(text)).alias("row"), split_units(clean(blank_null(text))).alias("cleaned"))


def _supported(equal: Column, width: int) -> Column:
    """Which places lie in width true ones in a row."""
    whole = F.transform(F.sequence(F.lit(0), F.size(equal) - width), lambda q: F.forall(F.slice(equal, q + 1, width), lambda e: e))

    def of(w: Column) -> Column:
        return F.transform(equal, lambda _, p: F.exists(F.slice(w, F.greatest(p - width + 1, F.lit(0)) + 1, F.least(p + 1, F.lit(width))), lambda x: x))

    return F.when(F.size(equal) >= width, F.transform(F.array(whole), of)[0])


def _beside(doc: Column, shift: Column):
    return lambda i, p: F.struct(i["t"].alias("t"), i["v"].alias("i"), F.get(doc, p + shift)["t"].alias("dt"), F.get(doc, p + shift)["v"].alias("d"))


def _judge(width: int, straight: bool):
    def judged(h: Column) -> Column:
        mask = _supported(F.transform(h, lambda x: F.coalesce(x["t"] == x["dt"], F.lit(False))), width)
        return F.zip_with(h, mask, lambda x, m: F.when(m, F.struct(x["i"].alias("i"), x["d"].alias("d"), F.lit(straight).alias("straight"))))

    return judged


def _found(item: Column, doc: Column, shift: Column, width: int, slack: int) -> Column:
    """For each word of the item: (i, d, straight), its value and the document's (null beside slots) and whether no
    neighbour was asked; or null where it isn't found."""
    out = None
    for s in sorted(range(-slack, slack + 1), key=lambda s: (abs(s), s)):
        here = F.transform(item, _beside(doc, shift + s))

        one = F.transform(F.array(here), _judge(width, s == 0))[0]
        out = one if out is None else F.zip_with(out, one, lambda a, b: F.coalesce(a, b))
    return out


def bare(cleaned: Column) -> Column:
    """Lower-case words without punctuation at their ends; values stay."""
    return F.lower(F.regexp_replace(cleaned, "(?<=^| )[^\\p{L}\\p{N}\\s]+|[^\\p{L}\\p{N}\\s]+(?= |$)", ""))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, slack: int = SLACK, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, at_word, kind: a row for each item that a document holds."""
    every = prepared(one_row_per_id(benchmark, "item_id"), "item_id").withColumn("template", words(canonical(F.col("cleaned"))))
    items = every.where(F.size("template") >= width)
    item_windows = items.select("item_id", F.posexplode(windows(F.col("template"), width)).alias("item_pos", "h"))
    n_windows = item_windows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    known = item_windows.select("h").distinct()
    few = item_windows.limit(broadcast_rows + 1).count() <= broadcast_rows

    scanned = prepared(docs, "doc_id").select("doc_id", "row", F.posexplode(windows(words(canonical(F.col("cleaned"))), width)).alias("doc_pos", "h"))
    hits = scanned.join(F.broadcast(known) if few else known, "h", "left_semi")
    placed = hits.join(F.broadcast(item_windows) if few else item_windows, "h").select("doc_id", "row", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift"), "item_pos")
    counted = placed.groupBy("doc_id", "row", "item_id", "shift").agg(F.countDistinct("item_pos").alias("here"))
    near = counted.withColumn("to", F.explode(F.sequence(F.col("shift") - slack, F.col("shift") + slack)))
    around = near.groupBy("doc_id", "row", "item_id", F.col("to").alias("shift")).agg(F.sum("here").alias("n"), F.max("here").alias("most"), F.max(F.when(F.col("to") == F.col("shift"), F.col("here"))).alias("here")).where("here is not null")
    # Checked are places that reach the threshold by themselves and those with the most hits among their neighbours.
    reached = around.join(F.broadcast(n_windows) if few else n_windows, "item_id").withColumn("need", F.ceil(F.col("n_windows") * threshold - 1e-9)).where((F.col("n") >= F.col("need")) & ((F.col("here") >= F.col("need")) | (F.col("here") == F.col("most"))))
    wide = materialize(reached.groupBy("doc_id", "row", "item_id", "n_windows").agg(F.collect_list(F.struct("n", "here", F.col("shift").cast("int").alias("shift"))).alias("places")))

    texts = prepared(possible(docs, wide.select("doc_id")), "doc_id").distinct()
    doc_slots = slots(words(F.col("cleaned")), words(canonical(F.col("cleaned"))))
    both = wide.join(texts, ["doc_id", "row"]).withColumn("d", doc_slots).drop("cleaned").join(items.select("item_id", slots(words(F.col("cleaned")), F.col("template")).alias("i")), "item_id")

    def checked(place: Column) -> Column:
        """The place with how well it fits; null where slots are inconsistent or too few words are found."""

        def judged(found: Column) -> Column:
            slotted = F.filter(found, lambda x: x["i"].isNotNull() & x["d"].isNotNull())
            pairs = F.array_distinct(F.transform(slotted, lambda x: F.struct(x["i"].alias("i"), x["d"].alias("d"))))

            def fits(p: Column) -> Column:
                consistent = (F.size(p) == F.size(F.array_distinct(p["i"]))) & (F.size(p) == F.size(F.array_distinct(p["d"])))
                same = F.forall(p, lambda x: x["i"] == x["d"])
                rank = F.when(same & F.forall(found, lambda x: F.coalesce(x["straight"], F.lit(False))), 2).when(same, 1).otherwise(0)
                share = F.size(F.filter(found, lambda x: x.isNotNull())) / F.size(found)
                return F.when(consistent & (share >= threshold - 1e-9), F.struct(rank.alias("rank"), place["n"].alias("n"), place["here"].alias("here"), (-place["shift"]).alias("s"), share.alias("share")))

            return F.transform(F.array(pairs), fits)[0]

        return F.transform(F.array(_found(F.col("i"), F.col("d"), place["shift"], width, slack)), judged)[0]

    passed = both.select("doc_id", "item_id", "n_windows", F.array_max(F.transform("places", checked)).alias("b")).where("b is not null")
    best = passed.groupBy("doc_id", "item_id", "n_windows").agg(F.max("b").alias("b"))
    matched = F.least("b.n", "n_windows")
    kind = F.element_at(F.array(*map(F.lit, ("reparameterised", "edited", "exact"))), F.col("b.rank") + 1)
    long = best.select("doc_id", "item_id", matched.alias("n_matched"), "n_windows", F.col("b.share").alias("coverage"), (-F.col("b.s")).alias("at_word"), kind.alias("kind"))
    short = every.where((F.size("template") < width) & (F.col("cleaned") != "")).select("item_id", F.sha2(bare(F.col("cleaned")), 256).alias("b"))
    if not short.limit(1).count():
        return long
    line = F.explode(F.split(blank_null(), "\n"))
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", line.alias("line")).select("doc_id", split_units(clean(F.col("line"))).alias("cleaned")).where((F.col("cleaned") != "") & (F.size(words(F.col("cleaned"))) < width))
    said = lines.select("doc_id", F.sha2(bare(F.col("cleaned")), 256).alias("b")).join(F.broadcast(short) if few else short, "b").select("doc_id", "item_id").distinct()
    one = F.lit(1).cast("long")
    return long.union(said.select("doc_id", "item_id", one, one, F.lit(1.0), F.lit(None).cast("int"), F.lit("whole")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without those that hold an item; all columns stay."""
    bad = leaks(docs, benchmark, **parameters).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
