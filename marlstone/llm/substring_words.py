"""Substring dedup over words by recompression.

A text is renamed in rounds: every maximal run of one symbol, however long, becomes a symbol, then every pair of a left and a right symbol (a
hashed bit of the name says which a symbol is). A name is a hash of what it stands for (symbol and length of a run, both parts of a pair), so
equal strings have equal names in all documents of all tasks, and no round needs to ask a dictionary.

What a window of 50 words looks like inside doesn't depend on its surroundings: in each round its first and last
runs, and an unpaired first right or last left symbol, are set aside, as they could belong to something that
begins or ends outside; the symbols between are the same wherever the window stands. So a window is in each round
a range of symbols, and the symbols set aside, round by round until nothing is left, spell it out: its name is
the 128-bit hash of that list, about two symbols a round instead of 50 words.

Revealing, in Spark: a window's key is a high-level symbol with two neighbours on each side, all inside the window after KEY_ROUNDS
rounds (or as many as leave NEED symbols); of those it takes the one with the least hash, so windows in a row mostly share it.
Keys that several documents have (see repeats) reveal the repeats.
Verifying, in Spark: windows in a row with one key are a context, named by its first and last window. One round of
grouping finds each context's least document; in others all its windows go. The windows of what is left, each distinct
context once, are grouped in another round by their names, and go where a smaller document has them. So a passage of many documents
costs one row for each context and document, cut down by each piece of the scan to one for each context.

Texts with equal words in equal order count as one from the start: only the first is searched, and
the others go whole (if they have 50 words).

Words are `[^\\x20\\x09-\\x0D]+`. Nulls: a null text has no words; rows without doc_id are left out; rows that
repeat a doc_id are documents of their own that don't count as smaller than each other. Texts of more than SEGMENT words are scanned
in parts that overlap by a window. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .repeats import KEY_BITS, U, described, joined, mix, name_of, pieces, segments, suspects

WINDOW = 50
#: Rounds before a key is taken, and symbols that a window must have left for it: the key's own and SIDE on both sides.
KEY_ROUNDS, SIDE = 4, 2
NEED = 2 * SIDE + 1
#: Words of a text that are scanned at once, and keys of a word of text, about.
SEGMENT = 500_000
DENSITY = 0.1
_SEPARATOR = U(0)


class _Words(dict):
    """Hashes of words, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7) or 1
        return h


_words = _Words()


def hashed(parts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all parts, a separator after each; starts and ends of the parts in them."""
    words: list[bytes] = []
    starts, ends = [], []
    for p in parts:
        starts.append(len(words))
        words += p
        ends.append(len(words))
        words.append(b" ")
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    h[ends] = _SEPARATOR
    return h, np.array(starts, np.int64), np.array(ends, np.int64)


def whole_windows(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each window begins that lies in one part."""
    many = np.maximum(ends - starts - WINDOW + 1, 0)
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())


class Rounds:
    """Ranges lo to hi of symbols that windows are inside, round by round. names: one array, or two for 128 bits."""

    def __init__(self, names: list[np.ndarray], windows: np.ndarray, spell: bool):
        self.names, self.lo, self.hi, self.round = names, windows.copy(), windows + WINDOW, 0
        self.at = np.arange(len(names[0]))  # the word that each symbol begins with
        self.left = [np.zeros(len(windows), U) for _ in names] if spell else []
        self.right = [np.zeros(len(windows), U) for _ in names] if spell else []

    def _aside(self, side: list[np.ndarray], rows: np.ndarray, places: np.ndarray, count: np.ndarray | None) -> None:
        for acc, s in zip(side, self.names, strict=bool(side)) if side else ():
            item = s[places] if count is None else joined(s[places], count.astype(U), 31)
            acc[rows] = joined(acc[rows], item, 17 + self.round)

    def _runs(self) -> None:
        s = self.names[0]
        new = np.concatenate([[True], s[1:] != s[:-1]]) | (s == _SEPARATOR)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(s)))
        to = np.cumsum(new) - 1
        rows = np.flatnonzero(self.lo < self.hi)
        lo, hi = self.lo[rows], self.hi[rows]
        after = np.minimum((first + size)[to[lo]], hi)
        self._aside(self.left, rows, lo, after - lo)
        more = after < hi
        before = np.where(more, first[to[hi - 1]], hi)
        self._aside(self.right, rows[more], hi[more] - 1, (hi - before)[more])
        self.lo[rows] = np.where(more, to[np.minimum(after, len(to) - 1)], 0)
        self.hi[rows] = np.where(more, to[np.minimum(before, len(to) - 1)], 0)
        run = np.flatnonzero(size > 1)
        for k, s in enumerate(self.names):
            s = s[first]
            s[run] = np.maximum(joined(s[run], size[run].astype(U), 101 + k), U(1))
            self.names[k] = s
        self.at = self.at[first]

    def _pairs(self) -> None:
        s = self.names[0]
        right = ((s >> U(21)) & U(1) == 1) & (s != _SEPARATOR)
        join = np.flatnonzero(~right[:-1] & right[1:] & (s[:-1] != _SEPARATOR))
        keep = np.ones(len(s), bool)
        keep[join + 1] = False
        to = np.cumsum(keep) - 1
        rows = np.flatnonzero(self.lo < self.hi)
        lo, hi = self.lo[rows], self.hi[rows]
        loose = right[lo]
        self._aside(self.left, rows[loose], lo[loose], None)
        lo = lo + loose
        loose = (lo < hi) & ~right[hi - 1]
        self._aside(self.right, rows[loose], hi[loose] - 1, None)
        hi = hi - loose
        to = np.append(to, to[-1] + 1)
        more = lo < hi
        self.lo[rows], self.hi[rows] = np.where(more, to[lo], 0), np.where(more, to[hi], 0)
        for k, s in enumerate(self.names):
            t = s.copy()
            t[join] = np.maximum(joined(s[join], s[join + 1], 201 + k), U(1))
            self.names[k] = t[keep]
        self.at = self.at[keep]

    def step(self) -> None:
        self.round += 1
        self._runs()
        self._pairs()


def keyed(h: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's key and a number for the place that it comes from (equal for neighbours that take the same symbol)."""
    key, place = np.zeros(len(windows), U), np.zeros(len(windows), np.int64)
    r = Rounds([h], windows, False)
    todo = np.arange(len(windows))
    for k in range(KEY_ROUNDS + 1):
        s, lo, hi, at = r.names[0], r.lo.copy(), r.hi.copy(), r.at
        if k < KEY_ROUNDS:
            r.step()
            done = (r.hi - r.lo < NEED)[todo]
        else:
            done = np.ones(len(todo), bool)
        now = todo[done]
        todo = todo[~done]
        if len(now):
            best = _least(mix(s ^ U(0x5851F42D4C957F2D)), lo[now] + SIDE, hi[now] - SIDE)
            name = np.full(len(now), k, U)
            for d in range(-SIDE, SIDE + 1):
                name = joined(name, s[best + d], 3)
            key[now], place[now] = name >> U(64 - KEY_BITS), at[best] * (KEY_ROUNDS + 1) + k
    return key, place


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where x[lo:hi] is least by its upper 40 bits, the leftmost of equals. x has at most 2 ** 24 elements."""
    low = U((1 << 24) - 1)
    minima = [(x & ~low) | np.arange(len(x), dtype=U)]
    while 2 ** len(minima) <= WINDOW:
        m, half = minima[-1], 2 ** (len(minima) - 1)
        minima.append(np.concatenate([np.minimum(m[:-half], m[half:]), m[len(m) - half :]]) if len(m) > half else m)
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.zeros(len(lo), np.int64)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = (np.minimum(minima[k][lo[at]], minima[k][hi[at] - 2**k]) & low).astype(np.int64)
    return out


def spelled(h: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of windows from the symbols that rounds set aside until nothing is left."""
    r = Rounds([h, mix(h ^ U(99))], windows, True)
    rounds = np.zeros(len(windows), U)
    while (open_ := r.lo < r.hi).any():
        rounds[open_] += U(1)
        r.step()
    a, b = (joined(joined(x, y, 7), rounds, 8).view(np.int64) for x, y in zip(r.left, r.right, strict=True))
    return a, b


def scanned(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of parts of texts: hashes; places of windows, their keys and the keys' places; their parts; each part's start, text number and offset."""
    number, offset, parts = (list(v) for v in zip(*segments([t.split() for t in texts], SEGMENT, WINDOW - 1), strict=True))
    for x, y in pieces(parts, SEGMENT):
        h, starts, ends = hashed(parts[x:y])
        windows = whole_windows(starts, ends)
        if len(windows):
            key, place = keyed(h, windows)
            yield h, windows, key, place, np.searchsorted(starts, windows, "right") - 1, starts, np.array(number[x:y]), np.array(offset[x:y])


def _rows_of(w: np.ndarray, place: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where windows in a row with one key begin."""
    return np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (w[1:] != w[:-1] + 1) | (part[1:] != part[:-1])]))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for _, windows, key, place, part, _, number, _ in scanned(texts):
        new = _rows_of(windows, place, part)
        keys.append(key[new])
        docs.append(number[part[new]])
    return np.concatenate(keys), np.concatenate(docs)


def _content(text: bytes) -> bytes:
    return b" ".join(text.split())


def _count(content: bytes) -> int:
    return content.count(b" ") + 1 if content else 0


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c1, c2, doc_id, part, at, many, names) of contexts whose key is repeated: many windows from at on.

    In a piece of texts each context is open once, for its least document, with the names of its windows; for the
    others names is null: they are settled, as a smaller document has the same windows.
    """
    for b in batches:
        ids, numbers, names, every = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), [_content(t) for t in b.column(3).cast(pa.binary()).to_pylist()]
        fits = [name_of(t) == n for t, n in zip(every, names, strict=True)]
        found = ((x, *s) for x, y in pieces(every) for s in scanned(every[x:y]))
        for x, h, windows, key, place, part, starts, number, offset in found:
            number = number + x
            edge = np.searchsorted(part, np.arange(len(number) + 1))
            hit = np.zeros(len(windows), bool)
            for k in range(len(number)):
                if edge[k] < edge[k + 1] and fits[number[k]]:
                    hit[edge[k] : edge[k + 1]] = np.isin(key[edge[k] : edge[k + 1]], b.column(4)[int(number[k])].values.to_numpy(zero_copy_only=False).view(U))
            w, part, place = windows[hit], part[hit], place[hit]
            if not len(w):
                continue
            s1, s2 = spelled(h, w)
            new = _rows_of(w, place, part)
            many = np.diff(np.append(new, len(w)))
            last = new + many - 1
            c1, c2 = (joined(joined(s[new].view(U), s[last].view(U), 5), many.astype(U), 6).view(np.int64) for s in (s1, s2))
            row = number[part[new]]
            owner, at = ids[row], w[new] - starts[part[new]] + offset[part[new]]
            order = np.lexsort((owner, c2, c1))
            first = np.concatenate([[True], (c1[order[1:]] != c1[order[:-1]]) | (c2[order[1:]] != c2[order[:-1]])])
            settled = np.zeros(len(order), bool)
            settled[order] = owner[order] > owner[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            both = np.column_stack([s1, s2]).astype("<i8")
            fill = [None if z else both[a : a + m].tobytes() for z, a, m in zip(settled.tolist(), new.tolist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(owner), pa.array(numbers[row]), pa.array(at), pa.array(many), pa.array(fill, pa.binary())], ["c1", "c2", "doc_id", "part", "at", "many", "names"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, doc_id, part, at) of each window of the contexts (doc_id, part, at, names)."""
    for b in batches:
        for lo in range(0, len(b), 2_000):
            c = b.slice(lo, 2_000)
            lists = c.column(3).cast(pa.binary()).to_pylist()
            both = np.frombuffer(b"".join(lists), "<i8").reshape(-1, 2)
            many = np.array([len(x) // 16 for x in lists], np.int64)
            which = np.repeat(np.arange(len(lists)), many)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(c.column(0).to_numpy()[which]), pa.array(c.column(1).to_numpy()[which]), pa.array(c.column(2).to_numpy()[which] + nth)], ["w1", "w2", "doc_id", "part", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, n_removed, kept_sha256) without the words that the windows cover."""
    for b in batches:
        out = []
        for doc, name, text, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3), strict=True):
            words = text.split()
            if name_of(b" ".join(words)) != name:
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            at, many = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "many"))
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + many - 1 + WINDOW, 1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = [words[k] for k in np.flatnonzero(~gone)]
            out.append((doc, name, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        if out:
            d, t, n, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(s)], ["doc_id", "t1", "n_removed", "kept_sha256"])


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, part, at, many): windows in a row that also start in a document with a smaller doc_id."""
    contexts = materialize(texts.mapInArrow(_emit, "c1 long, c2 long, doc_id long, part int, at long, many long, names binary"))
    opened = contexts.where("names is not null")
    least = opened.groupBy(F.col("c1").alias("g1"), F.col("c2").alias("g2")).agg(F.min("doc_id").alias("least"))
    placed = materialize(opened.join(least, (F.col("c1") == F.col("g1")) & (F.col("c2") == F.col("g2"))).select("doc_id", "part", "at", "many", F.when(F.col("doc_id") == F.col("least"), F.col("names")).alias("names")))
    windows = placed.where("names is not null").select("doc_id", "part", "at", "names").mapInArrow(_windows, "w1 long, w2 long, doc_id long, part int, at long")
    first = windows.groupBy(F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = windows.join(first, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).where("doc_id > least").select("doc_id", "part", "at", F.lit(1).cast("long").alias("many"))
    whole = [df.where("names is null").select("doc_id", "part", "at", "many") for df in (contexts, placed)]
    return whole[0].union(whole[1]).union(later)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    documents, texts = suspects(docs, materialize(described(docs, _count, _content)), _content, anchors, DENSITY)
    found = materialize(repeated_windows(texts).groupBy(F.col("doc_id").alias("d"), F.col("part").alias("p")).agg(F.collect_list(F.struct("at", "many")).alias("spans")))
    cut = texts.join(found, (F.col("doc_id") == F.col("d")) & (F.col("part") == F.col("p"))).select("doc_id", "t1", "text", "spans").mapInArrow(_cut, "doc_id long, t1 long, n_removed long, kept_sha256 string")
    cut = cut.distinct().select(F.col("doc_id").alias("d"), F.col("t1").alias("t"), "n_removed", F.col("kept_sha256").alias("cut_sha256"))
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n") >= WINDOW)
    return documents.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("t1") == F.col("t")), "left").select(
        "doc_id", F.col("n").alias("n_words"), F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
