"""What both kinds of substring dedup share: anchors, and finding which anchors repeat across documents.

An anchor is a place that a window's own content picks, with a key hashed from content that every window which picks
it holds. So equal windows have equal keys, and only windows whose key is in several documents are looked at
further. Anchors leave the scan packed: a chunk of documents sends each key once, with its least
document, to the key's bucket; documents of one chunk that share a key are known at once. A group of
copies thus costs a bucket an entry per chunk, not per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import blank_null, discard, materialize, possible

KEY_BITS = 50
CHUNK_ANCHORS = 1_000_000
PIECE_BYTES = 2_000_000
#: A bucket gets about so many anchors; there are at least 2 ** 6 and at most 2 ** 20 buckets.
BUCKET_ANCHORS = 500_000

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= _C
    x ^= x >> U(29)
    return x


def joined(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A name for a followed by b."""
    return mix(a * _A + (b ^ (b >> U(31))) * _B + U(salt))


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def least_place(x: np.ndarray, width: int) -> np.ndarray:
    """Where in x[i : i + width] the upper 40 bits are least, the leftmost of equals, for each i."""
    low, step, n = U((1 << 24) - 1), (1 << 24) - width, len(x) - width + 1
    out = [np.zeros(0, np.int64)]
    for a in range(0, n, step):
        part = x[a : min(a + step, n) + width - 1]
        least = least_in((part & ~low) | np.arange(len(part), dtype=U), width)
        out.append(a + (least & low).astype(np.int64))
    return np.concatenate(out)


def segments(texts: list, size: int, overlap: int) -> Iterator[tuple[int, int, object]]:
    """(text's number, offset, part): whole texts, or parts of at most size + overlap units where they are longer."""
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - overlap), size):
            yield k, at, t if len(t) <= size + overlap else t[at : at + size + overlap]


def pieces(texts: list, units: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many units."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= units:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(b: bytes, width: int) -> np.ndarray:
    p = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :width] = p.T
    return out.reshape(-1).view("<u8")


_PACKED = "shard int, bucket int, known boolean, keys binary, docs binary"
_INFO = "doc_id long, n long, t1 long, t2 long, kept_sha256 string"


def by_doc(docs: np.ndarray, keys: np.ndarray) -> tuple[pa.Array, pa.Array]:
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return pa.array(docs[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(docs)).astype(np.int32)), pa.array(keys.view(np.int64)))


def bucket_bits(anchors: float) -> int:
    """Enough buckets for about so many anchors."""
    return max(6, min(20, int(np.ceil(np.log2(max(1.0, anchors / BUCKET_ANCHORS))))))


def pack(keys: np.ndarray, docs: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk's anchors by bucket: each key once, and once more, as known, with every document of several.

    What is known needs no meeting, so those rows go to any shard, not to their bucket's.
    """
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
    keys, docs = keys[new], docs[new]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    last = np.concatenate([first[1:], [True]])
    rest = -(-(KEY_BITS - bits) // 8)
    anywhere = int(mix(docs[:1].view(U))[0] & U(0xFFFFF))
    for known, fit in ((True, ~(first & last)), (False, first)):
        k, d = keys[fit], docs[fit]
        if not len(k):
            continue
        bucket = (k >> U(KEY_BITS - bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(k)]
        full = bucket[cut[:-1]]
        shard = (full + anywhere) % (1 << bits) if known else full
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard.astype(np.int32)), pa.array(full.astype(np.int32)), pa.array([known] * len(full)), pa.array([_planes(k[a:b], rest) for a, b in zip(cut[:-1], cut[1:], strict=True)]), pa.array([_planes(d[a:b].view(U), 8) for a, b in zip(cut[:-1], cut[1:], strict=True)])],
            ["shard", "bucket", "known", "keys", "docs"],
        )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text")).where("doc_id is not null")


def described(docs: DataFrame, units: Callable[[bytes], int], content: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, n (units), t1 and t2 (128-bit name of the content), kept_sha256 (of the whole content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 512):
                texts = [content(t) for t in b.column(1).slice(lo, 512).cast(pa.binary()).to_pylist()]
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512), pa.array([units(t) for t in texts], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["doc_id", "n", "t1", "t2", "kept_sha256"])

    return _rows(docs).mapInArrow(run, _INFO)


def packed(docs: DataFrame, content: Callable[[bytes], bytes], anchors: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """All anchors, as pack() gives them for 2 ** bits buckets. anchors(texts) gives keys and the texts' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo in range(0, len(b), 512):
                texts = [content(t) for t in b.column(1).slice(lo, 512).cast(pa.binary()).to_pylist()]
                for x, y in pieces(texts):
                    keys, which = anchors(texts[x:y])
                    held.append((keys, ids[lo + x : lo + y][which]))
                    many += len(keys)
                    if many >= CHUNK_ANCHORS:
                        yield from pack(*(np.concatenate(c) for c in zip(*held, strict=True)), bits)
                        held, many = [], 0
        if many:
            yield from pack(*(np.concatenate(c) for c in zip(*held, strict=True)), bits)

    return _rows(docs).mapInArrow(run, _PACKED)


def repeated(anchors: DataFrame, bits: int) -> DataFrame:
    """(doc_id, keys): each document's keys that other documents have too. anchors: packed()."""
    rest = -(-(KEY_BITS - bits) // 8)

    def meet(t: pa.Table) -> pa.Table:
        top = np.repeat(t.column("bucket").to_numpy().astype(U) << U(KEY_BITS - bits), [len(x) // rest for x in t.column("keys").to_pylist()])
        keys = np.concatenate([_from_planes(x, rest) for x in t.column("keys").to_pylist()]) | top
        docs = np.concatenate([_from_planes(x, 8) for x in t.column("docs").to_pylist()]).view(np.int64)
        known = np.repeat(t.column("known").to_numpy(), [len(x) // rest for x in t.column("keys").to_pylist()])
        told = keys[known], docs[known]
        keys, docs = keys[~known], docs[~known]
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        same = keys[1:] == keys[:-1]
        many = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(keys) else np.zeros(0, bool)
        ids, lists = by_doc(np.concatenate([told[1], docs[many]]), np.concatenate([told[0], keys[many]]))
        return pa.table({"doc_id": ids.cast(pa.int64()), "repeated": lists})

    found = anchors.groupBy("shard").applyInArrow(meet, "doc_id long, repeated array<long>")
    return found.groupBy("doc_id").agg(F.flatten(F.collect_list("repeated")).alias("keys"))


def suspects(docs: DataFrame, info: DataFrame, content: Callable, anchors: Callable, anchors_per_unit: float) -> tuple[DataFrame, DataFrame]:
    """(documents, texts). info: described(), written; content and anchors: as in packed().

    documents: doc_id, n, t1, t2, kept_sha256, first_id (least doc_id with the same text). texts: doc_id, part
    (a number that tells texts apart that repeat a doc_id), t1, text, keys of the first of each text that has repeated
    keys, written to the shared folder.
    """
    groups = info.groupBy(F.col("t1").alias("g1"), F.col("t2").alias("g2")).agg(F.min("doc_id").alias("first_id"))
    documents = info.join(groups, (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2"))).drop("g1", "g2")
    firsts = documents.where("doc_id = first_id").select(F.col("doc_id").alias("d"), "t1").distinct().withColumn("part", F.row_number().over(W.partitionBy("d").orderBy("t1")))
    bits = bucket_bits((info.agg(F.sum("n")).first()[0] or 0) * anchors_per_unit)
    todo = materialize(repeated(packed(docs, content, anchors, bits), bits).join(firsts, F.col("doc_id") == F.col("d")).select("d", "part", "t1", "keys"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text"))
    texts = materialize(possible(rows, todo.select("d")).join(todo, F.col("doc_id") == F.col("d")).select("doc_id", "part", "t1", "text", "keys"))
    discard(todo)
    return documents, texts


def name_of(content: bytes) -> int:
    return int(np.frombuffer(xxhash.xxh3_128_digest(content), "<i8")[0])
