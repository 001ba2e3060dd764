"""Languages of documents as mixtures: proportions by expectation-maximisation, the set of languages by penalised likelihood.

Model: for each language, counts of character n-grams (1 to 4) of lower-cased words with their ends, over all texts to learn
from. Tasks count, Spark sums; a language's counts are held in ORDERS tables of BUCKETS cells, so the model's size follows the
number of languages, not the corpus. A word's likelihood in a language is the product of its characters' probabilities,
each interpolated from the longest n-gram down (Dirichlet smoothing).

Document: its words are draws from a mixture of languages. EM over the words gives the proportions, starting with all
languages; those with less than half a word are let go, then the least one again and again for as long as that
costs less log-likelihood than `penalty` times the logarithm of the number of words. If one language is left, it is the one
of greatest likelihood times its share of the documents learned from. The prediction is the language of largest proportion (ties: the first by name);
the score is the share of the document's words expected to be in it, under proportions smoothed by one word dealt out by the languages' shares.

Nulls: a null or empty text, and one without a letter, is `und` with score 0, as is each text if nothing could be learned. Texts with a null
lang, null doc_id (held_out is false) or without letters aren't learned from. Rows that repeat a doc_id are judged each. An empty table gives no rows.
Texts are read whole: words of long texts are weighed piece by piece, then seen together. Columns other than doc_id, text and lang
aren't read, and lang, source and doc_id aren't used to predict.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

UNKNOWN = "und"
ORDERS = 4
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Strength of a shorter n-gram's estimate, in characters; the same for single characters that were never seen.
STRENGTH, UNSEEN = 4.0, 0.05
PENALTY = 1.0
HELD_OUT = 5
#: The model grows by 4 MB a language; more languages than these are refused.
MOST_LANGUAGES = 500
#: Characters weighed at once.
PIECE = 500_000


def _letters() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if it is a mark (goes on a word but makes none)."""
    if not hasattr(_letters, "table"):
        kinds = bytearray(sys.maxunicode + 1)
        for c in range(sys.maxunicode + 1):
            kinds[c] = 1 if chr(c).isalpha() else 2 if unicodedata.category(chr(c))[0] == "M" else 0
        _letters.table = np.frombuffer(bytes(kinds), np.uint8)
    return _letters.table


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all words, lower-cased, each word followed by a 0; and the number of words of each text that have a letter."""
    lower = [(t or "").lower() + " " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _letters()[codes]
    # A mark belongs to a word only after a letter or a mark that does.
    marks = np.flatnonzero(kind == 2)
    kind = (kind == 1).astype(np.uint8)
    for m in marks:
        kind[m] = m > 0 and kind[m - 1]
    after = np.concatenate([[0], kind[:-1]])
    end = (kind == 0) & (after == 1)
    kept = (kind == 1) | end
    doc_ends = np.cumsum([len(x) for x in lower])
    ends_before = np.concatenate([[0], np.cumsum(end)])
    per_text = np.diff(ends_before[doc_ends], prepend=0)
    return np.where(kind == 1, codes, 0)[kept].astype(np.uint64), per_text


def grams(stream: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that end at each character, by order; nothing reaches beyond a word's start."""
    shift = lambda x: np.concatenate([np.zeros(1, x.dtype), x[:-1]])
    out, key, before, open_ = [], stream.copy(), stream, None
    for n in range(ORDERS):
        if n:
            before = shift(before)
            open_ = before > 0 if open_ is None else open_ & (before > 0)
            # A word's first character has the end before it as its context, as a 0.
            key = key * np.uint64(0x100000001B3) + np.where(open_, before, 0).astype(np.uint64)
        mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return out


@dataclass(frozen=True)
class Model:
    """counts[order] has a row for each bucket and a column for each language, in order of names; shares: of the documents."""

    names: list[str]
    shares: np.ndarray
    counts: list[np.ndarray]
    totals: np.ndarray


def learn(docs: DataFrame, key: str = "text", label: str = "lang") -> Model:
    """The model of all rows of (text, lang); at most ORDERS * BUCKETS counts a language reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                cells = pa.array([lang]).take(pa.array(np.zeros(len(at) + 1, np.int64)))
                yield pa.RecordBatch.from_arrays([cells, pa.array(np.append(at, -1)), pa.array(np.append(counts[at], seen[lang]))], ["lang", "cell", "n"])
            held.clear()
            seen.clear()

        for b in slices(batches, 128):
            by: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                stream, per_text = words(texts)
                if not len(stream):
                    continue
                if lang not in held:
                    if len(held) == 32:
                        yield from flush()
                    held[lang], seen[lang] = np.zeros(ORDERS * BUCKETS, np.int64), 0
                seen[lang] += int((per_text > 0).sum())
                for k in range(0, len(stream), PIECE):
                    lead = min(k, ORDERS - 1)  # context of the piece's first characters
                    for n, g in enumerate(grams(stream[k - lead : k + PIECE])):
                        held[lang][n * BUCKETS : (n + 1) * BUCKETS] += np.bincount(g[lead:], minlength=BUCKETS)
        yield from flush()

    rows = docs.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("text"), F.col(label).alias("lang"))
    cells = rows.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = cells.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MOST_LANGUAGES}")
    lang = np.searchsorted(np.array(names, object), np.array(got.column("lang").to_pylist(), object)) if names else np.zeros(0, np.int64)
    cell, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    docs_of = np.zeros(len(names))
    docs_of[lang[cell < 0]] = n[cell < 0]
    counts = np.zeros((ORDERS * BUCKETS, len(names)), np.float32)
    counts[cell[cell >= 0], lang[cell >= 0]] = n[cell >= 0]
    counts = counts.reshape(ORDERS, BUCKETS, len(names))
    return Model(names, docs_of / max(1.0, docs_of.sum()), list(counts), counts[0].sum(axis=0, dtype=np.float64))


def word_likelihoods(m: Model, stream: np.ndarray) -> np.ndarray:
    """A row of log-likelihoods for each word of a stream."""
    ends = np.flatnonzero(stream == 0)
    out, start, w = np.zeros((len(ends), len(m.names)), np.float32), 0, 0
    while w < len(ends):
        upto = max(w + 1, int(np.searchsorted(ends, start + PIECE)))
        part = stream[start : ends[upto - 1] + 1]
        p, context = None, m.totals.astype(np.float32)
        firsts = np.flatnonzero(np.concatenate([[1], part[:-1] == 0]))
        ended = m.counts[0][grams(np.zeros(1, np.uint64))[0][0]]  # what a word's first character follows
        for n, g in enumerate(grams(part)):
            count = m.counts[n][g]
            p = (count + np.float32(UNSEEN)) / (context + np.float32(UNSEEN * BUCKETS)) if p is None else (count + np.float32(STRENGTH) * p) / (np.maximum(context, count) + np.float32(STRENGTH))
            context = np.concatenate([count[:1], count[:-1]])
            context[firsts] = ended
        np.log(p, out=p)
        out[w:upto] = np.add.reduceat(p, np.concatenate([[0], ends[w : upto - 1] + 1 - start]), axis=0)
        start, w = ends[upto - 1] + 1, upto
    return out


def _em(like: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        r = like * np.repeat(share, n, axis=0)
        r /= r.sum(axis=1, keepdims=True) + np.float32(1e-30)
        share = np.add.reduceat(r, starts, axis=0) / n[:, None].astype(np.float32)
    return share


def _log_likelihood(like: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.log((like * np.repeat(share, n, axis=0)).sum(axis=1) + np.float32(1e-30), dtype=np.float64), starts)


def mixtures(ll: np.ndarray, n: np.ndarray, shares: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages selected for each text (n words each, at least one), and the share of words expected in each language."""
    starts = np.cumsum(n) - n
    like = np.exp(ll - ll.max(axis=1, keepdims=True))
    share = _em(like, starts, n, np.full((len(n), ll.shape[1]), 1 / ll.shape[1], np.float32), 10)
    share[share < np.minimum(0.5 / n[:, None], share.max(axis=1, keepdims=True))] = 0
    share = _em(like, starts, n, share / share.sum(axis=1, keepdims=True), 3)
    now = _log_likelihood(like, starts, n, share)
    open_ = np.flatnonzero((share > 0).sum(axis=1) > 1)
    while len(open_):
        some, of, n_open = like[np.repeat(np.isin(np.arange(len(n)), open_), n)], share[open_], n[open_]
        first = np.cumsum(n_open) - n_open
        least = np.where(of > 0, of, 2).argmin(axis=1)
        of[np.arange(len(of)), least] = 0
        of = _em(some, first, n_open, of / of.sum(axis=1, keepdims=True), 5)
        without = _log_likelihood(some, first, n_open, of)
        fine = now[open_] - without <= penalty * np.log(n_open + 1)
        share[open_[fine]], now[open_[fine]] = of[fine], without[fine]
        open_ = open_[fine & ((of > 0).sum(axis=1) > 1)]
    alone = np.flatnonzero((share > 0).sum(axis=1) == 1)
    if len(alone):
        best = (np.add.reduceat(ll.astype(np.float64), starts, axis=0)[alone] + np.log(np.maximum(shares, 1e-300))).argmax(axis=1)
        share[alone] = 0
        share[alone, best] = 1
    smooth = (share * n[:, None] + shares) / (n[:, None] + 1)
    return share, _em(like, starts, n, smooth.astype(np.float32), 1)


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, and the languages selected with their proportions, of each row of (doc_id, text)."""
    names = np.array([*model.names, UNKNOWN], object)

    def judge(texts: list[str | None]) -> tuple[list, list, list]:
        pred, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        found: list[list] = [[] for _ in texts]
        stream, n = words(texts)
        has = np.flatnonzero(n)
        if len(has) and len(model.names):
            share, expected = mixtures(word_likelihoods(model, stream), n[has], model.shares, penalty)
            pred[has] = share.argmax(axis=1)
            score[has] = np.clip(expected[np.arange(len(has)), pred[has]], 0, 1)
            for k, row in zip(has, share, strict=True):
                found[k] = [{"lang": names[x], "share": float(row[x])} for x in np.flatnonzero(row)]
        return names[pred].tolist(), score.tolist(), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts, out, k = b.column(1).to_pylist(), ([], [], []), 0
            while k < len(texts):  # a few texts at once, by size
                to, size = k, 0
                while to < len(texts) and (to == k or size + len(texts[to] or "") <= 4 * PIECE):
                    size += len(texts[to] or "")
                    to += 1
                for held, got in zip(out, judge(texts[k:to]), strict=True):
                    held += got
                k = to
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang string, share double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT
    model = learn(docs.where(fold != 0))
    return identify(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
