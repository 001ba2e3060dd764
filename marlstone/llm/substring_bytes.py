"""Substring dedup over bytes by external recursive induced sorting of suffixes.

A window of 50 bytes picks an anchor, the 32-gram in it with the least hash; windows whose anchor other documents have
too (see repeats) are cut out with their neighbours as contexts: all windows in a row with one anchor, which is at
most 68 bytes. Equal windows have equal anchors, so contexts are dealt to shards by anchor. Equal contexts count once,
with the least doc_id; within a piece of the scan already, so a passage of many documents costs a shard one
row for each piece. Anchors that very many documents share are split: their contexts are dealt window by window, each to its
own hash's shard, so that no shard grows with the corpus. A shard leaves out contexts that can share no window: a window has half of its
other bytes on one side of its anchor's gram, so contexts are kept whose gram with that many bytes before, or after it, is in
another document's too. It concatenates the others, sorts all suffixes (see induced), and walks the suffix array: suffixes whose
common prefixes reach 50 bytes are equal windows, whose least doc_id is their first. Queues that outgrow memory go to the
shared folder, and so do served suffixes.

Windows of a context go where it occurs in a document after its first; in its first document those go whose window
has an earlier first. Equal texts count as one from the start: only the first is searched, and the others go
whole (if they have 50 bytes).

Nulls: a null text is empty; rows without doc_id are left out; rows that repeat a doc_id are documents of their own that
don't count as smaller than each other. Texts longer than SEGMENT are scanned in parts that overlap by a window. Extra
columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parallelism, shared_dir, table
from .induced import Queues, sorted_suffixes
from .repeats import KEY_BITS, U, described, joined, least_place, mix, name_of, pieces, segments, suspects

WINDOW = 50
GRAM = 32
#: Bytes of contexts that a shard gets on average, and entries that its queues keep in memory.
SHARD_BYTES = 8_000_000
QUEUE_ENTRIES = 4_000_000
#: An anchor is split that more documents have than HOT and than one HOT_SHARE-th of all places of repeated anchors; at most HOT_SHARE are.
HOT, HOT_SHARE = 2_000, 1_000_000
#: Bytes of a text that are scanned at once.
SEGMENT = 4_000_000
#: Anchors of a byte of text, about.
DENSITY = 2 / (WINDOW - GRAM + 2)
#: At least so many bytes of a window lie before its anchor's gram, or after it.
SIDE = -((GRAM - WINDOW) // 2)
_CONTEXT = "key int, context binary, doc_id long, part int, place long"


def grams(data: bytes) -> np.ndarray:
    """A name for each GRAM bytes in a row."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(U)
    return joined(joined(eight[:n], eight[8 : 8 + n]), joined(eight[16 : 16 + n], eight[24 : 24 + n]), 5)


def window_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of grams, starts of the texts in all, each window that lies in one text, and its anchor's place."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    g = grams(b"".join(texts))
    n = int(ends[-1]) - WINDOW + 1 if len(ends) else 0
    if n <= 0:
        return g, starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = least_place(g, WINDOW - GRAM + 1)
    whole = np.zeros(int(ends[-1]) + 1, np.int8)
    long = sizes >= WINDOW
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - WINDOW + 1, -1)
    windows = np.flatnonzero(np.cumsum(whole[:n], dtype=np.int8) > 0)
    return g, starts, windows, least[windows]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    number, _, parts = zip(*segments(texts, SEGMENT, WINDOW - 1), strict=True)
    g, starts, _, a = window_anchors(list(parts))
    a = a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a
    return mix(g[a]) >> U(64 - KEY_BITS), np.array(number)[np.searchsorted(starts, a, "right") - 1]


def _contexts(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, context, doc_id, part, place) of windows in a row with one repeated anchor.

    place: where the context begins, how many windows it has and where its anchor is in it, in 40, 12 and 12 bits.
    key is the low half of the anchor's; it only chooses the shard.

    In a piece of texts each context is open once, for its least document; for the others it is null, they are
    settled, as a smaller document has the same windows.
    """
    for b in batches:
        ids, numbers, names, every = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).cast(pa.binary()).to_pylist()
        fits = [name_of(t) == n for t, n in zip(every, names, strict=True)]
        number, offset, parts = (list(x) for x in zip(*segments(every, SEGMENT, WINDOW - 1), strict=True))
        for x, y in pieces(parts):
            texts, which, shift = parts[x:y], np.array(number[x:y]), np.array(offset[x:y])
            g, starts, windows, a = window_anchors(texts)
            if not len(windows):
                continue
            doc = np.searchsorted(starts, windows, "right") - 1
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
            last = np.append(new[1:], len(windows)) - 1
            key, doc, begin, end = mix(g[a[new]]) >> U(64 - KEY_BITS), doc[new], windows[new], windows[last] + WINDOW
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            hit = np.zeros(len(key), bool)
            for k in range(len(texts)):
                if edge[k] < edge[k + 1] and fits[which[k]]:
                    hit[edge[k] : edge[k + 1]] = np.isin(key[edge[k] : edge[k + 1]], b.column(4)[int(which[k])].values.to_numpy(zero_copy_only=False).view(U))
            hits = np.flatnonzero(hit)
            if not len(hits):
                continue
            at = begin[hits] - starts[doc[hits]]
            cut = [texts[d][p : p + m] for d, p, m in zip(doc[hits].tolist(), at.tolist(), (end - begin)[hits].tolist(), strict=True)]
            at += shift[doc[hits]]
            named = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, cut)), "<i8").reshape(-1, 2)
            gap = a[new][hits] - begin[hits]
            row = which[doc[hits]]
            owner, many, key = ids[row], (end - begin)[hits] - WINDOW + 1, key[hits].astype(np.int64)
            order = np.lexsort((at, owner, named[:, 1], named[:, 0]))
            first = np.concatenate([[True], (named[order[1:]] != named[order[:-1]]).any(axis=1)])
            least = owner[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            settled = np.zeros(len(order), bool)
            settled[order] = owner[order] > least
            split = np.flatnonzero(~settled & np.isin(key, hot))
            if len(split):
                at_once = np.setdiff1d(np.arange(len(key)), split)
                again, part = np.repeat(split, many[split]), np.arange(many[split].sum()) - np.repeat(np.cumsum(many[split]) - many[split], many[split])
                single = [cut[k][o : o + WINDOW] for k, o in zip(again.tolist(), part.tolist(), strict=True)]
                cut = [cut[k] for k in at_once.tolist()] + single
                key = np.concatenate([key[at_once], np.array([xxhash.xxh3_64_intdigest(c) for c in single], U).view(np.int64)])
                take, part = np.concatenate([at_once, again]), np.concatenate([np.zeros(len(at_once), np.int64), part])
                settled, owner, row, many = settled[take], owner[take], row[take], np.where(np.arange(len(take)) < len(at_once), many[take], 1)
                at, gap = at[take] + part, gap[take] - part
            key[settled] = owner[settled]
            fill = [None if z else c for z, c in zip(settled.tolist(), cut, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.int32)), pa.array(fill, pa.binary()), pa.array(owner), pa.array(numbers[row]), pa.array(at << 24 | many << 12 | gap)],
                ["key", "context", "doc_id", "part", "place"],
            )


def _saver(folder: str) -> Callable:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)

    def save(places: np.ndarray, prefixes: np.ndarray) -> Callable:
        path = f"{root}/{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as out:
            out.write(places.astype("<i8").tobytes())
            out.write(prefixes.tobytes())

        def again() -> tuple[np.ndarray, np.ndarray]:
            with fs.open_input_stream(path) as f:
                raw = f.read()
            n = len(raw) // 9
            return np.frombuffer(raw, "<i8", n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 8 * n).copy()

        def load() -> tuple[np.ndarray, np.ndarray]:
            chunk = again()
            fs.delete_file(path)
            return chunk

        load.again = again  # without deleting it
        return load

    return save


def first_windows(contexts: list[bytes], least: np.ndarray, queues: Callable[[], Queues]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context's number, offset) of windows that a context with a smaller least has too."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    raw = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8)
    t = np.append(np.where(raw == 255, 1, raw + 2), 0).astype(np.uint8)  # UTF-8 has no byte above 0xF4
    starts = np.cumsum(sizes + 1) - sizes - 1
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(places: np.ndarray, prefixes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin = np.flatnonzero(prefixes < WINDOW) if len(prefixes) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(places)))
        group = np.repeat(np.arange(len(begin)), size)
        fit = size[group] > 1
        places, group = places[fit], group[fit]
        which = np.searchsorted(starts, places, "right") - 1
        fit = (places + WINDOW <= starts[which] + sizes[which]) & (which < len(contexts))
        places, group, which = places[fit], group[fit], which[fit]
        if len(places):
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            low = np.repeat(np.minimum.reduceat(least[which], at), np.diff(np.append(at, len(group))))
            late = least[which] > low
            yield which[late], places[late] - starts[which[late]]

    for places, prefixes in sorted_suffixes(t, queues):
        prefixes = prefixes.copy()
        prefixes[0] = 0 if not held else prefixes[0]
        held.append((places, prefixes))
        if sum(len(p) for p, _ in held) >= 1_000_000:
            places, prefixes = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.flatnonzero(prefixes < WINDOW)
            if len(cut) and cut[-1]:
                yield from settle(places[: cut[-1]], prefixes[: cut[-1]])
                held = [(places[cut[-1] :], prefixes[cut[-1] :])]
            else:
                held = [(places, prefixes)]
    yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _may_share(contexts: pa.LargeBinaryArray, gap: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which contexts may have a window that one with another least has. gap: where each one's anchor begins."""
    offsets, data = np.frombuffer(contexts.buffers()[1], np.int64)[contexts.offset : contexts.offset + len(contexts) + 1], contexts.buffers()[2].to_pybytes()
    begin, size, span = offsets[:-1], np.diff(offsets), GRAM + SIDE
    view = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    out = np.zeros(len(contexts), bool)
    for fit, shift in ((gap >= SIDE, gap - SIDE), (size - gap >= span, gap)):
        rows = np.flatnonzero(fit)
        if not len(rows):
            continue
        place = begin[rows] + shift[rows]
        name = view[place].astype(U)
        for k in [*range(8, span - 8, 8), span - 8]:
            name = joined(name, view[place + k].astype(U), k)
        order = np.argsort(name)
        name, low = name[order], least[rows][order]
        at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        several = np.minimum.reduceat(low, at) < np.maximum.reduceat(low, at)
        out[rows[order]] |= np.repeat(several, np.diff(np.append(at, len(name))))
    return out


def _sorter(folder: str, limit: int) -> Callable:
    def ranges(doc: np.ndarray, name: np.ndarray, first: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name), pa.array(first), pa.array(many.astype(np.int32))], ["doc_id", "part", "first", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cuts = [], []
        for b in batches:
            settled = np.array(b.column(0).is_null())
            doc, name, place = (b.column(k).to_numpy() for k in (1, 2, 3))
            at, many, gap = place >> 24, place >> 12 & 4095, place & 4095
            if settled.any():
                yield ranges(doc[settled], name[settled], at[settled], many[settled])
            if not settled.all():
                rest = b.filter(pa.array(~settled))
                cuts.append(rest.column(0).cast(pa.large_binary()))
                c1, c2 = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, rest.column(0).to_pylist())), "<i8").reshape(-1, 2).T
                held.append((c1, c2, *(x[~settled] for x in (doc, name, at, many, gap))))
        if not held:
            return
        c1, c2, doc, name, at, many, gap = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((c2, c1))
        new = np.concatenate([[True], (c1[order[1:]] != c1[order[:-1]]) | (c2[order[1:]] != c2[order[:-1]])])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        texts = pa.concat_arrays(cuts).take(pa.array(order[new]))
        gap = gap[order[new]]
        cuts.clear()
        least = np.full(len(texts), 2**63 - 1, np.int64)
        np.minimum.at(least, which, doc)
        later = doc > least[which]
        if later.any():
            yield ranges(doc[later], name[later], at[later], many[later])
        fit = _may_share(texts, gap, least)
        texts, number = texts.filter(pa.array(fit)).to_pylist(), np.cumsum(fit) - 1
        if not texts:
            return
        rest = ~later & fit[which]
        which, doc, name, at, least = number[which[rest]], doc[rest], name[rest], at[rest], least[fit]
        order = np.argsort(which, kind="stable")
        which, doc, name, at = which[order], doc[order], name[order], at[order]
        begin, size = np.searchsorted(which, np.arange(len(texts) + 1)), np.bincount(which, minlength=len(texts))
        save = []

        def queues() -> Queues:
            return Queues(lambda *c: (save or save.append(_saver(folder)) or save)[0](*c), limit)

        for found, offset in first_windows(texts, least, queues):
            for k in range(0, len(found), 100_000):
                f, o = found[k : k + 100_000], offset[k : k + 100_000]
                rows = np.repeat(begin[f], size[f]) + np.arange(size[f].sum()) - np.repeat(np.cumsum(size[f]) - size[f], size[f])
                yield ranges(doc[rows], name[rows], at[rows] + np.repeat(o, size[f]), np.ones(len(rows), np.int64))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, n_removed, n_spans, kept_sha256) without the bytes that the windows cover."""
    for b in batches:
        out = []
        for doc, name, text, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3), strict=True):
            if name_of(text) != name:
                continue
            edge = np.zeros(len(text) + 1, np.int64)
            spans = lists.values
            first, many = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "many"))
            np.add.at(edge, first, 1)
            np.subtract.at(edge, first + many - 1 + WINDOW, 1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            out.append((doc, name, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        if out:
            d, t, n, r, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s)], ["doc_id", "t1", "n_removed", "n_spans", "kept_sha256"])


def hot_anchors(texts: DataFrame, total: int, least: int = HOT) -> np.ndarray:
    """Keys that are split; at most HOT_SHARE."""
    count = texts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return count.where(F.col("n") > max(least, total // HOT_SHARE)).select("key").toArrow().column(0).to_numpy()


def repeated_windows(texts: DataFrame, shard_bytes: int = SHARD_BYTES, queue_entries: int = QUEUE_ENTRIES, hot: int = HOT) -> DataFrame:
    """(doc_id, part, first, many): windows in a row that also start in a document with a smaller doc_id."""
    spark = texts.sparkSession
    places = texts.agg(F.sum(F.size("keys"))).first()[0] or 0
    shards = max(parallelism(spark), -(-places * (WINDOW + 10) // shard_bytes))
    split = hot_anchors(texts, places, hot)
    contexts = texts.mapInArrow(lambda batches: _contexts(batches, split), _CONTEXT)
    return contexts.repartition(shards, "key").drop("key").mapInArrow(_sorter(shared_dir(spark), queue_entries), "doc_id long, part int, first long, many int")


def dedup(docs: DataFrame, shard_bytes: int = SHARD_BYTES, queue_entries: int = QUEUE_ENTRIES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    documents, texts = suspects(docs, materialize(described(docs, len, bytes)), bytes, anchors, DENSITY)
    found = materialize(repeated_windows(texts, shard_bytes, queue_entries, hot).groupBy(F.col("doc_id").alias("d"), F.col("part").alias("p")).agg(F.collect_list(F.struct("first", "many")).alias("spans")))  # before the texts are shuffled, so the contexts' files are gone by then
    cut = texts.join(found, (F.col("doc_id") == F.col("d")) & (F.col("part") == F.col("p"))).select("doc_id", "t1", "text", "spans").mapInArrow(_cut, "doc_id long, t1 long, n_removed long, n_spans long, kept_sha256 string")
    cut = cut.distinct().select(F.col("doc_id").alias("d"), F.col("t1").alias("t"), "n_removed", "n_spans", F.col("kept_sha256").alias("cut_sha256"))
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n") >= WINDOW)
    return documents.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("t1") == F.col("t")), "left").select(
        "doc_id", F.col("n").alias("n_bytes"), F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
