"""Quality classifier from weak labels.

Heuristic labellers vote on each document, 1 bad, 0 good, -1 abstaining, for two questions: is its text of low quality, and
is it toxic. Where a table of labels has a document, that is one more labeller. Expectation-maximisation over the
counts of vote patterns estimates how far each labeller is to be trusted and gives each pattern a posterior. The
posteriors of a bounded sample of documents (`sample` of them, those with a label first, then those with the least hashes of their
ids; without those on which no labeller votes) then train, for each question, a linear scorer over hashed features: the words that a document has, the stems that it repeats
(the lists of abuse are English; other languages' are learnt from labels), and shares of its tokens by shape. All
documents are scored; those with a probability over one half on either question are rejected.

All documents vote and count in the patterns, and whole texts are read. To the driver come the pattern counts (at most
3^5 for each question), the `MOST_FEATURES` features at most of each question that differ most between both sides of the sample, beyond
LEAST_SCORE standard deviations of chance, and the sample's documents as lists of those. Features hash to 30 bits and only those that enough
of the sample have get a weight (see LEAST_SHARE), so a long text gathers no weight from chance collisions.

Nulls: a null text is empty (kept: no labeller votes bad); a null doc_id has no label. Rows that repeat a doc_id are scored
each, and the least of their votes train. A probability of just the threshold is kept. Labels that repeat a doc_id count as bad if any says so; null labels don't vote. An empty table gives no
rows. Extra columns pass through filter_quality() and aren't read otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_null, discard, materialize, slices, table
from .pii import expectation_maximisation

SAMPLE = 4_000
#: A feature gets a weight that as many documents of the sample have as this share of the rarer class, but two at least.
LEAST_SHARE = 0.05
#: Standard deviations that a feature's share of bad documents must differ by, and at most so many features are weighed.
LEAST_SCORE, MOST_FEATURES = 4.0, 5_000
THRESHOLD = 0.5
#: Words of abuse in two lists, so that two labellers can agree or not.
ABUSE = ("idiot moron loser scum trash stupid dumb fool imbecile bastard filthy freak".split(), "pathetic worthless disgusting clown garbage jerk ugly coward liar hate creep pig".split())
_MARKS = re.compile(r"^[^\w\s]+$|[^\w\s]{2,}$|([#$%&*~^=_])\1")
_STRIP = re.compile(r"^[^\w]+|[^\w]+$")
PLAIN, MARKED, CAPITALS, BARS, ABUSE_1, ABUSE_2 = range(6)
QUESTIONS = ("quality", "toxic")


#: Frequent words of the language that the lists above are in; elsewhere their silence is no vote.
ENGLISH = frozenset("the and of to is that with for was".split())
#: A stem is a longer word's first letters; features say how often a text has one.
STEM = 4


class _Tokens(dict):
    """token -> shape << 60 | 30-bit hash of its stem (0: none) << 30 | 30-bit hash of its bare lower-case word; memory is bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        bare = _STRIP.sub("", token)
        low = bare.lower()
        if low in _ABUSE[0]:
            shape = ABUSE_1
        elif low in _ABUSE[1]:
            shape = ABUSE_2
        elif token.strip("|") == "":
            shape = BARS
        elif _MARKS.search(token):
            shape = MARKED
        elif len(bare) > 1 and bare.isupper() and bare.isalpha():
            shape = CAPITALS
        else:
            shape = PLAIN
        stem = xxhash.xxh32_intdigest(low[:STEM], 13) & 0x3FFFFFFF if len(low) > STEM and low.isalpha() else 0
        v = self[token] = shape << 60 | stem << 30 | xxhash.xxh32_intdigest(low, 11) & 0x3FFFFFFF
        return v


_ABUSE = [frozenset(x) for x in ABUSE]
_tokens = _Tokens()


def _forget_tokens() -> None:
    """Workers live on after a task; what follows needs their memory."""
    _tokens.clear()


_ENGLISH = np.array([xxhash.xxh32_intdigest(w, 11) & 0x3FFFFFFF for w in sorted(ENGLISH)], np.int64)
SHAPES = ["marked", "capitals", "bars", "repeats"]


def _stem_features(stems: np.ndarray, n: int) -> np.ndarray:
    """Hashed features of the stems that a text of n tokens has more than once, or in a hundredth of its tokens."""
    ids, counts = np.unique(stems[stems > 0], return_counts=True)
    levels = (counts >= 2, counts >= 3, counts > 0.01 * n, counts > 0.03 * n)
    return np.concatenate([(ids[at] * 2_654_435_761 + k * 40_503_001) & 0x3FFFFFFF | 1 << 31 for k, at in enumerate(levels)])


def profile(text: str, count_english: bool = False) -> tuple[np.ndarray, list[float], tuple[int, int], int, float]:
    """Distinct hashes of words and stems, shares of SHAPES, distinct abusive words by list, the number of tokens, and, if asked for, the share of ENGLISH."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), [0.0] * 4, (0, 0), 0, 0.0
    code = np.fromiter(map(_tokens.__getitem__, words), np.int64, n)
    shape = np.bincount(code >> 60, minlength=6)
    distinct = np.unique(code)
    kinds = distinct >> 60
    repeats = float((code[1:] == code[:-1]).sum()) / n
    known = np.concatenate([np.unique(distinct & 0x3FFFFFFF), _stem_features(code >> 30 & 0x3FFFFFFF, n)])
    english = float(np.isin(code & 0x3FFFFFFF, _ENGLISH).sum()) / n if count_english else 0.0
    return known, [shape[MARKED] / n, shape[CAPITALS] / n, shape[BARS] / n, repeats], (int((kinds == ABUSE_1).sum()), int((kinds == ABUSE_2).sum())), n, english


def votes(text: str) -> tuple[list[int], list[int]]:
    """Of the heuristic labellers, on quality and on toxicity."""
    _, (marked, capitals, bars, repeats), (one, two), n, english = profile(text, count_english=True)
    band = lambda x, bad, good: 1 if x >= bad else 0 if x < good else -1
    noisy = band(max(marked, bars), 0.25, 0.03)
    shouting = band(capitals, 0.3, 0.05) if n >= 5 else -1
    looping = band(repeats, 0.15, 0.03) if n >= 5 else -1
    clean = 0 if n and marked + capitals + bars + repeats < 0.1 else 1 if n >= 5 and marked + capitals + bars + repeats > 0.3 else -1
    none = 0 if one + two or english >= 0.05 else -1
    strong = 1 if one + two >= 2 else none if one + two == 0 else -1
    return [noisy, shouting, looping, clean], [1 if one else none, 1 if two else none, strong]


def _hash(name: str) -> int:
    return xxhash.xxh32_intdigest(name, 12) & 0x3FFFFFFF | 1 << 30


_SHAPE_IDS = [[_hash(f"{s}>{b}") for b in (0.02, 0.1, 0.3)] for s in SHAPES]


def features(text: str) -> np.ndarray:
    """Distinct hashed features: words, and for each shape the levels that its share passes."""
    words, shares, *_ = profile(text)
    extra = [i for ids, x in zip(_SHAPE_IDS, shares, strict=True) for i, b in zip(ids, (0.02, 0.1, 0.3), strict=True) if x > b]
    return np.concatenate([words, np.array(extra, np.int64)])


def train(rows: list[np.ndarray], target: np.ndarray, rounds: int = 300, ridge: float = 5e-4) -> dict[int, float]:
    """Logistic weights by hashed feature; -1 is the bias. target: probabilities."""
    if not len(rows):
        return {-1: -5.0}
    every = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids, col = np.unique(every, return_inverse=True)
    w, bias = np.zeros(len(ids)), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[col], len(rows)), -30, 30)))
        err = p - target
        g = np.bincount(col, err[doc], len(w)) / len(rows) + ridge * w
        gb = err.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        bias -= 0.1 * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.999**k)) + 1e-8)
    return {-1: float(bias)} | {int(i): float(x) for i, x in zip(ids, w, strict=True) if abs(x) > 0.05}


def _probability(x: np.ndarray, known: np.ndarray, weights: np.ndarray, bias: float) -> float:
    at = np.searchsorted(known, x)
    hit = known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(weights[at[hit]].sum())))))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text"))


def cast_votes(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, quality, toxic) with an array of votes for each question; the last is the label's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            q, t = zip(*(votes(x.as_py()) for x in b.column(1)), strict=True) if len(b) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q, pa.list_(pa.int32())), pa.array(t, pa.list_(pa.int32()))], ["doc_id", *QUESTIONS])

    own = _text(docs).mapInArrow(run, "doc_id long, quality array<int>, toxic array<int>")
    if labels is None:
        return own.select("doc_id", *[F.concat(q, F.array(F.lit(-1))).alias(q) for q in QUESTIONS])
    gold = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max(F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int"))).alias("low"), F.max((F.col("toxic") == 1).cast("int")).alias("abusive"))
    both = own.join(gold, F.col("doc_id") == F.col("d"), "left")
    return both.select("doc_id", F.concat("quality", F.array(F.coalesce("low", F.lit(-1)))).alias("quality"), F.concat("toxic", F.array(F.coalesce("abusive", F.lit(-1)))).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE) -> dict[str, dict[int, float]]:
    """Weights of both scorers."""
    cast = materialize(cast_votes(docs, labels))
    posterior = {}
    for q in QUESTIONS:
        counts = sorted((tuple(r[0]), float(r[1])) for r in cast.groupBy(q).count().collect())
        posterior[q] = expectation_maximisation(counts)[2]
    chosen = cast.where("doc_id is not null").groupBy("doc_id").agg(*[F.min(q).alias(q) for q in QUESTIONS]).orderBy(F.greatest(F.element_at("quality", -1), F.element_at("toxic", -1)) < 0, F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    target = [(r.doc_id, *(float(posterior[q][tuple(r[q])]) if max(r[q]) >= 0 else None for q in QUESTIONS)) for r in chosen.collect()]
    discard(cast)
    known = docs.sparkSession.createDataFrame(target, "id long, " + ", ".join(f"{q} double" for q in QUESTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([features(x.as_py()) for x in b.column(0)], pa.list_(pa.int64()))], ["doc_id", *QUESTIONS, "features"])

    texts = _text(docs).join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("text", "doc_id", *QUESTIONS)
    drawn = materialize(texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{q} double" for q in QUESTIONS) + ", features array<long>"))
    out = {q: _trained(drawn.where(F.col(q).isNotNull()).select("doc_id", F.col(q).alias("target"), "features")) for q in QUESTIONS}
    discard(drawn)
    return out


def _trained(drawn: DataFrame) -> dict[int, float]:
    """A scorer for (doc_id, target, features): only features come to the driver that tell both sides apart."""
    n, bad = drawn.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    if not n:
        return train([], np.zeros(0))
    share, least = bad / n, max(2.0, LEAST_SHARE * min(bad, n - bad))
    of = drawn.select(F.explode("features").alias("feature"), "target").groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("target").alias("a"))
    score = F.abs(F.col("a") - F.col("k") * share) / F.sqrt(F.col("k") * share * (1 - share) + 1)
    best = of.where((F.col("k") >= least) & (F.col("k") <= 0.5 * n) & (score >= LEAST_SCORE)).orderBy(score.desc(), "feature").limit(MOST_FEATURES)
    used = np.sort(np.array([r.feature for r in best.select("feature").collect()], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [x.values.to_numpy(zero_copy_only=False) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.sort(x[np.isin(x, used)]) for x in rows], pa.list_(pa.int64()))], ["doc_id", "target", "features"])

    got = drawn.mapInArrow(run, "doc_id long, target double, features array<long>").orderBy("doc_id", "features").toArrow()
    return train([np.array(x, np.int64) for x in got.column("features").to_pylist()], np.array(got.column("target")))


def _fresh(name: str, taken: list[str]) -> str:
    """name, with as many underscores as set it apart from taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def score(docs: DataFrame, weights: dict[str, dict[int, float]], columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """docs' columns (doc_id alone if none are given) with both probabilities, and the names of those."""
    known = {}
    for q in QUESTIONS:
        ids = sorted(k for k in weights[q] if k >= 0)
        known[q] = (np.array(ids, np.int64), np.array([weights[q][k] for k in ids] or [0.0]), weights[q][-1])
    kept = docs.select(*columns) if columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    names = [_fresh(c, kept.columns) for c in ("p_low_quality", "p_toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t.as_py()) for t in b.column(0)]
            p = [pa.array([_probability(f, *known[q]) for f in x], pa.float64()) for q in QUESTIONS]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *p], [*b.schema.names[1:], *names])
        if columns:  # the texts go on to other steps
            _forget_tokens()

    source = docs.select(blank_null().alias(_fresh("text_", kept.columns)), *([F.col(f"`{c}`") for c in columns] if columns else [F.col("doc_id").cast("long").alias("doc_id")]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return source.mapInArrow(run, f"{fields}, " + ", ".join(f"`{c}` double" for c in names)), names


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, keep."""
    scored, (low, toxic) = score(docs, fit(docs, labels, sample))
    return scored.withColumn("keep", (F.col(low) <= threshold) & (F.col(toxic) <= threshold))


def filter_quality(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those rejected; all columns stay."""
    scored, (low, toxic) = score(docs, fit(docs, labels, sample), docs.columns)
    return scored.where((F.col(low) <= threshold) & (F.col(toxic) <= threshold)).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
