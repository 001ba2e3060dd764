"""Token ids in binary shards, packed by Simple-8b.

A shard holds the ids of a range of documents in order, an end id after each. Its file, all little-endian:

    8 bytes  magic S8BSHRD1
    blocks   of up to 65,536 ids each, as 64-bit words
    footer   arrays of int64: docs' ids, docs' token counts, then per block byte offset, id count, word count
    3 int64  number of documents, number of blocks, offset of the footer
    8 bytes  magic S8BSHRD1

A word's top 4 bits select one of 14 layouts (count, bits) for its lower 60 bits, lowest id first; selector 15
is the escape: the next word is one raw 64-bit id. Blocks start at known offsets, so readers decode any of them
alone and all words of a selector at once.

Shards are range partitions by doc_id (or the input's own partitions, in order). A task writes its shard under a
name of its own and renames it, so repeated or lost attempts leave a whole file; only the manifest (a row per
shard) is gathered, to sum the starts. Memory: a block, a batch of texts, and 16 bytes for each document of
the shard. Text files go to the folder all executors share.

Nulls: a null text is empty, a null doc_id is stored as the least 64-bit integer and read back as null (it
sorts first). Rows that repeat a doc_id stay, smaller text first. An empty table gives no rows. Other columns
aren't read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import blank_null, materialize, parallelism, shared_dir, table

MAGIC = b"S8BSHRD1"
BLOCK = 65_536
#: (ids, bits) of selectors 0 to 13.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
NULL_ID = -(2**63)
END_ID = 2
#: For each layout's count, two shorter counts whose windows overlap to cover it.
COVERS = [(2, 1), (3, 2), (4, 2), (5, 4), (6, 4), (7, 4), (8, 4), (10, 8), (12, 8), (15, 8), (20, 15), (30, 15), (60, 30)]


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of non-negative ids (uint64)."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    need = np.zeros(n, np.uint8)
    rest = ids.copy()
    if rest.max() < 2**53:
        need[:] = np.frexp(ids.astype(np.float64))[1]
    else:
        while rest.any():
            need[rest > 0] += 1
            rest >>= np.uint64(1)
    need = np.maximum(need, 1)
    most = {1: need}
    pick = np.ones(n, np.uint8)
    pad = lambda a, k: np.concatenate([a[k:], np.full(min(k, n), 99, np.uint8)])[:n]
    bits = dict(LAYOUTS)
    for count, part in COVERS:
        most[count] = np.maximum(most[part], pad(most[part], count - part))
        pick[most[count] <= bits[count]] = count
    steps, starts, at = pick.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts)
    count = pick[first]
    escaped = need[first] > 60
    place = np.arange(len(first)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(first) + int(escaped.sum()), np.uint64)
    for selector, (k, b) in enumerate(LAYOUTS):
        here = np.flatnonzero((count == k) & ~escaped)
        if len(here):
            vals = ids[first[here][:, None] + np.arange(k)] << (np.arange(k, dtype=np.uint64) * np.uint64(b))
            words[place[here]] = np.bitwise_or.reduce(vals, axis=1) | np.uint64(selector << 60)
    here = np.flatnonzero(escaped)
    words[place[here]] = np.uint64(ESCAPE << 60)
    words[place[here] + 1] = ids[first[here]]
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a block's words."""
    words = np.asarray(words, dtype=np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # a raw word is no selector, whatever its top bits are
        raw, at = np.zeros(len(words), bool), 0
        for at in np.flatnonzero(sel == ESCAPE):
            if not raw[at]:
                raw[at + 1] = True
        sel[raw] = 16
    counts = np.zeros(17, np.int64)
    counts[: len(LAYOUTS)] = [k for k, _ in LAYOUTS]
    counts[16] = 1
    if ((sel == 14)).any():
        raise ValueError("unknown selector")
    ends = np.cumsum(counts[sel])
    out = np.zeros(int(ends[-1]), np.uint64)
    starts = ends - counts[sel]
    for selector, (k, b) in enumerate(LAYOUTS):
        here = np.flatnonzero(sel == selector)
        if len(here):
            out[starts[here][:, None] + np.arange(k)] = (words[here][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(b))) & np.uint64((1 << b) - 1)
    here = np.flatnonzero(sel == 16)
    out[starts[here]] = words[here]
    return out


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library, with a bounded memory of words and pre-tokens.

    Byte-level BPE never merges across pre-tokens. A text in which no space meets other white space, and whose
    letters have been letters in every Unicode version, splits into pre-tokens within its space-separated
    words, so the library's model sees each distinct pre-token once; any other text goes to the library whole.
    """

    #: What isn't printable ASCII, line feed, or a Latin letter or sign from U+00A1 to U+017F.
    odd = re.compile(r"[^\n -~\xa1-\xac\xae-\u017f]")
    #: Pre-tokens of byte-level BPE within those characters.
    parts = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zªµºÀ-ÖØ-öø-\u017f]+| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-\u017f0-9²³¹¼½¾]+|\s+(?!\S)|\s+")
    kept: dict[str, Encoder] = {}

    def __init__(self, path: str, most_words: int = 300_000):
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most_words
        self.tokenize = self.model.model.tokenize
        #: The characters that stand for bytes: printable ones for themselves, the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_signs = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.space, self.line = chr(self.byte_signs[32]), chr(self.byte_signs[10])
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This process's encoder, which keeps its words from task to task."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def part(self, p: str) -> bytes:
        if len(self.known) > self.most:
            self.known.clear()
        signs = p.replace(" ", self.space).replace("\n", self.line) if p.isascii() else p.encode().decode("latin-1").translate(self.byte_signs)
        ids = self.known[p] = array("I", [t.id for t in self.tokenize(signs)]).tobytes()
        return ids

    def word(self, w: str) -> bytes:
        known, bare = self.known, w[1:] if w[:1] == " " else w
        if bare.isalpha():
            return known.get(w) or self.part(w)
        parts = [w[:-1], w[-1]] if bare[-1:] in (",", ".") and bare[:-1].isalpha() else self.parts.findall(w)
        return b"".join([known[p] if p in known else self.part(p) for p in parts])

    def is_odd(self, t: str) -> bool:
        return "  " in t or " \n" in t or t.endswith(" ") or "<|" in t or bool(self.odd.search(t))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        strange = []
        first, later = self.first, self.later
        for i, t in enumerate(texts):
            if self.is_odd(t):
                strange.append(i)
                continue
            if len(first) + len(later) > self.most:
                first.clear()
                later.clear()
            w = t.split(" ")
            for x in set(w[1:]).difference(later):
                later[x] = self.word(" " + x)
            if w[0] not in first:
                first[w[0]] = self.word(w[0])
            out[i] = first[w[0]] + b"".join(map(later.__getitem__, w[1:]))
        for i, ids in zip(strange, self.plain([texts[i] for i in strange]), strict=True):
            out[i] = ids
        return out


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, out):
        self.out, self.left, self.held = out, [], 0
        self.docs: list[tuple[int, int]] = []
        self.blocks: list[tuple[int, int, int]] = []
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.left.append(ids)
        self.held += len(ids)
        while self.held >= BLOCK:
            every = np.concatenate(self.left)
            whole = len(every) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self.block(every[k : k + BLOCK])
            self.left, self.held = [every[whole:]], len(every) - whole

    def block(self, ids: np.ndarray) -> None:
        words = pack(ids).astype("<u8")
        self.out.write(words.tobytes())
        self.blocks.append((self.at, len(ids), len(words)))
        self.at += 8 * len(words)

    def close(self) -> None:
        if self.held:
            self.block(np.concatenate(self.left))
        docs, blocks = np.array(self.docs, "<i8").reshape(-1, 2), np.array(self.blocks, "<i8").reshape(-1, 3)
        self.out.write(docs.T.tobytes() + blocks.T.tobytes() + np.array([len(docs), len(blocks), self.at], "<i8").tobytes() + MAGIC)


def read_shard(f) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a shard in order, a block at a time; f is a random-access file."""
    size = f.size()
    tail = f.read_at(32, size - 32)
    if tail[24:] != MAGIC or f.read_at(8, 0) != MAGIC:
        raise ValueError("not a shard")
    n, blocks, at = np.frombuffer(tail[:24], "<i8").tolist()
    foot = np.frombuffer(f.read_at(size - 32 - at, at), "<i8")
    ids, counts, table_ = foot[:n].tolist(), foot[n : 2 * n].tolist(), foot[2 * n :].reshape(3, blocks).T.tolist()
    parts: list[np.ndarray] = []
    held, k = 0, 0
    for offset, many, words in [*table_, (0, 0, 0)]:
        if words:
            parts.append(unpack(np.frombuffer(f.read_at(8 * words, offset), "<u8")))
            if len(parts[-1]) != many:
                raise ValueError("a block is damaged")
            held += many
        if k < n and held >= counts[k]:
            rest = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            used = 0
            while k < n and len(rest) - used >= counts[k]:
                yield (None if ids[k] == NULL_ID else ids[k]), rest[used : used + counts[k]]
                used += counts[k]
                k += 1
            parts, held = [rest[used:]], len(rest) - used
    if k != n:
        raise ValueError("documents are missing")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, by_id: bool = True) -> DataFrame:
    """The manifest (shard, path, n_docs, n_tokens, start) of shards written below folder; one job writes."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text"))
    if by_id:
        rows = rows.repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, root = _open(folder)
        fs.create_dir(root)
        name, own = f"{root}/shard-{shard:06d}.s8b", f"{root}/.{shard:06d}-{TaskContext.get().taskAttemptId()}"
        encoder, end, tokens = Encoder.of(tokenizer), np.array([end_id], np.uint64), 0
        with fs.open_output_stream(own) as out:
            writer = ShardWriter(out)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                for k in range(0, len(texts), 64):
                    for doc, raw in zip(ids[k : k + 64], encoder.encode(texts.slice(k, 64).to_pylist()), strict=True):
                        got = np.concatenate([np.frombuffer(raw, "<u4").astype(np.uint64), end])
                        writer.add(NULL_ID if doc is None else doc, got)
                        tokens += len(got)
            writer.close()
        fs.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/shard-{shard:06d}.s8b"]), pa.array([len(writer.docs)], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    manifest = materialize(rows.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, at = _open(path)
                rows = []
                with fs.open_input_file(at) as f:
                    for doc, ids in read_shard(f):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.where("n_docs > 0").repartition(parallelism(manifest.sparkSession), "shard").select("path", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, by_id: bool = True) -> DataFrame:
    folder = folder or shared_dir(docs.sparkSession)
    return read_back(write_shards(docs, tokenizer or default_tokenizer(), folder, by_id=by_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
