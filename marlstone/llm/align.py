"""Alignment of two tokenizers' tokens, and how common each aligned pair of ids is.

A text, with a space before it, is cut into tokens by a byte-level BPE (A) and by a BPE of pieces (B, which adds that space
itself). An A token and a B token whose byte ranges overlap are linked; byte offsets where tokens of both end cut a
text into groups.

1. A scan encodes blocks of documents and writes, once, a row for each document and a posting row for each pair
   of ids of a block: which of its documents hold the pair, how many times each, and the sum.
2. Counts of pairs are summed before they are shuffled. They and the postings are shuffled by B id, sorted (a sort that
   spills) with the counts first, and read as one stream: an id's counts, at most as many as A has ids, give its maximum,
   then its postings pass by and each becomes a contribution to a document. Contributions of a task are summed by document,
   and those to one block of documents travel as one row; a last shuffle by block, again read as a stream, sums them all.

B ids with a large share of the postings are dealt out to several tasks by (A id, block), each of which gets the id's
counts; there are at most as many such ids as B has, so their list may be broadcast. No task holds more than a block of
texts, one B id's counts, an Arrow batch of rows and FLUSH contributions.

Words: both tokenizers never join what a lone space or line feed parts from what stands before it (B's vocabulary is checked
for that), so each distinct word is encoded once for as long as the worker remembers it. A comma or full stop after a letter is
a token of its own to both (checked as well).

Nulls: a null or empty text has no tokens: zeros and ''. So has a text that either tokenizer doesn't give back byte for byte.
A null doc_id stays null; rows that repeat a doc_id give a row each, and each counts. An empty table gives no rows. Other
columns aren't read. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, parallelism, slices, table

#: A block ends at so many documents or UTF-8 bytes.
DOCS_BITS = 12
BLOCK_BYTES = 3_000_000
#: Contributions that a task holds before it sums them up and hands them on.
FLUSH = 1_000_000

DOC_FIELDS = ["n_a", "n_b", "n_groups", "n_links"]
SCHEMA = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, b int, a int, n long, docs binary, times binary"
SUM_FIELDS = ["docs", "best", "total"]
SUMS = "block long, docs binary, best binary, total binary"
#: Pre-tokens of the byte-level BPE: fixed values.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers in a worker, with a bounded memory of words."""

    #: White space that isn't alone between two characters that aren't white space to any library.
    odd = re.compile("^\\s|\\s\\Z|\\s\\s|᠎")
    lone = re.compile("(?<=[^\\s᠎]) (?=[^\\s᠎])")
    #: Signs whose classes are the same in every version of Unicode.
    plain = re.compile("\n?[!-~\xa1-\xac\xae-ſ]*\\Z")
    kept: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, a_path: str, b_path: str, most_words: int = 200_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, signs = self.a.get_vocab(), byte_signs()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.parts_words = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        number = {p: k for k, p in enumerate(pieces)}
        self.start = number.get("▁")
        #: What a last comma or full stop adds to a word's ids.
        self.stops: dict[str, tuple[bytes, bytes]] = {}
        for c in ",.":
            if c in vocabulary and c in number and not any(p[k : k + 1] == c and p[k - 1].isalpha() for p in pieces for k in range(1, len(p))):
                self.stops[c] = array("i", [vocabulary[c]]).tobytes(), array("i", [number[c]]).tobytes()
        self.ranks = self._ranks(spec)
        #: Whether A's ids always give back their text: a token for each byte, and nothing that changes texts.
        self.lossless = spec.get("normalizer") is None and all(c in vocabulary for c in signs) and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        ends = [(k, end) for k, n in ((len(self.a_bytes), b",|"), (len(self.b_bytes), b",;")) for end in n.decode()]
        #: Texts of ids with what follows them: A's before a comma, before a bar, B's before a comma, before a semicolon.
        self.shown = np.array([f"{k}{end}".encode() for n, end in ends for k in range(n)])
        self.a_words: dict[str, bytes] = {}
        self.b_words: dict[str, bytes] = {}
        #: Words known before; those met again move on to the above.
        self.before: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.bad: set[str] = set()
        self.most = most_words

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Tokenizers:
        if (a_path, b_path) not in cls.kept:
            cls.kept[a_path, b_path] = cls(a_path, b_path)
        return cls.kept[a_path, b_path]

    def _ranks(self, spec: dict):
        """A faster encoder of the same vocabulary for plain words, where ids follow the order of merges; else None."""
        import tiktoken

        model, own = spec["model"], {t["id"] for t in spec.get("added_tokens", [])}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or any(model["vocab"].get(x + y) != 256 + k for k, (x, y) in enumerate(merges)):
            return None
        ranks = {x: k for k, x in enumerate(self.a_bytes) if x and k not in own}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def words(self, text: str) -> list[str]:
        """Parts of ' ' + text that both tokenizers encode apart: after a space (left out), or from a line feed on."""
        if not self.parts_words or text[0] == "\n":
            return [text]
        if not self.odd.search(text):
            return text.replace("\n", " \n").split(" ")
        parts = self.lone.split(f" {text}")
        # A part that begins with a line feed would be taken for one without a space.
        return [text] if any(p[:1] == "\n" for p in parts) else [parts[0][1:], *parts[1:]]

    @staticmethod
    def text_of(word: str) -> str:
        return word if word[:1] == "\n" else f" {word}"

    def learn(self, new: list[str]) -> None:
        """Ids of words that aren't known."""
        stopped = [w for w in new if w[-1:] in self.stops and w[-2:-1].isalpha()]
        if stopped:
            bare = dict.fromkeys(w for w in new if w[-1:] not in self.stops or not w[-2:-1].isalpha())
            bare.update(dict.fromkeys(w[:-1] for w in stopped if w[:-1] not in self.a_words))
            new = list(bare)
        plain = [self.ranks is not None and self.plain.match(w) is not None for w in new]
        rest = [self.text_of(w) for w, p in zip(new, plain, strict=True) if not p]
        others = iter(self.a.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        ranks = self.ranks
        a = [ranks(w if w[:1] == "\n" else f" {w}") if p else next(others).ids for w, p in zip(new, plain, strict=True)]
        b = [x[1:] if w[:1] == "\n" and x[:1] == [self.start] else x for w, x in zip(new, self.b.encode(new, num_threads=1), strict=True)]
        for to, ids in ((self.a_words, a), (self.b_words, b)):
            ends = np.cumsum([4 * len(x) for x in ids]).tolist()
            raw = array("i", chain.from_iterable(ids)).tobytes()
            to.update(zip(new, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        # All at once; if they aren't given back, which one isn't.
        if "".join(map(self.text_of, new)).encode() != self.joined(chain.from_iterable(b), self.b_bytes):
            self.bad.update(w for w, x in zip(new, b, strict=True) if self.joined(x, self.b_bytes) != self.text_of(w).encode())
        if not self.lossless:
            self.bad.update(w for w, x in zip(new, a, strict=True) if self.joined(x, self.a_bytes) != self.text_of(w).encode())
        for w in stopped:
            own, (x, y) = w[:-1], self.stops[w[-1]]
            self.a_words[w], self.b_words[w] = self.a_words[own] + x, self.b_words[own] + y
            if own in self.bad:
                self.bad.add(w)

    def meet(self, new: list[str]) -> None:
        if len(self.a_words) > self.most:
            self.before, self.a_words, self.b_words = (self.a_words, self.b_words), {}, {}
        for k, to in ((0, self.a_words), (1, self.b_words)):
            known = self.before[k]
            to.update((w, known[w]) for w in new if w in known)
        if new := [w for w in new if w not in self.a_words]:
            self.learn(new)

    @staticmethod
    def joined(ids, parts: list[bytes]) -> bytes:
        return b"".join(map(parts.__getitem__, ids))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of A and of B (32-bit) for each text; none for texts that aren't given back."""
        out = []
        for text in texts:
            if not text:
                out.append((b"", b""))
                continue
            words = self.words(text)
            if words[0][:1] == "\n":  # one word, with a space before its line feed
                a, b = (array("i", x).tobytes() for x in (self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)))
                words = [text]
                self.bad.add(text)  # is looked at below
            else:
                own = set(words)
                if new := [w for w in own if w not in self.a_words]:
                    full = len(self.a_words) > self.most
                    self.meet(list(own) if full else new)
                a, b = b"".join(map(self.a_words.__getitem__, words)), b"".join(map(self.b_words.__getitem__, words))
            if self.bad and not self.bad.isdisjoint(words):
                whole = f" {text}".encode()
                if self.joined(np.frombuffer(a, "i4").tolist(), self.a_bytes) != whole or self.joined(np.frombuffer(b, "i4").tolist(), self.b_bytes) != whole:
                    a = b = b""
                if len(self.bad) > self.most:
                    self.a_words, self.b_words, self.before, self.bad = {}, {}, ({}, {}), set()
            out.append((a, b))
        return out


def link(t: Tokenizers, encoded: list[tuple[bytes, bytes]]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """A row of DOC_FIELDS and digest for each text; and document, A id and B id of each link."""
    a, b = (np.frombuffer(b"".join(x[k] for x in encoded), "i4").astype(np.int64) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) // 4 for x in encoded], np.int64) for k in (0, 1))
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    every = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # two sorted runs
    twice = np.flatnonzero(every[1:] == every[:-1])
    common, cuts = every[twice], np.delete(every, twice)
    at_a, at_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)  # the tokens over the bytes before each cut
    doc = np.searchsorted(np.cumsum(n_a), at_a, "right")
    links = np.bincount(doc, minlength=len(encoded))
    last_a, last_b = np.searchsorted(a_end, common), np.searchsorted(b_end, common)
    groups = np.bincount(np.searchsorted(np.cumsum(n_a), last_a, "right"), minlength=len(encoded))
    # Ids in the digest's order: a group's A ids, then its B ids.
    count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    codes = np.empty(len(a) + len(b), np.int64)
    end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    end_a[last_a], end_b[last_b] = 1, 1
    size_a, size_b = len(t.a_bytes), len(t.b_bytes)
    codes[np.arange(len(a)) + np.repeat(np.cumsum(count_b) - count_b, count_a)] = a + size_a * end_a
    codes[np.arange(len(b)) + np.repeat(np.cumsum(count_a), count_b)] = b + 2 * size_a + size_b * end_b
    rows, shown = [], t.shown
    for k, (x, y) in enumerate(zip(n_a.tolist(), n_b.tolist(), strict=True)):
        start = first_a[k] + first_b[k]
        text = shown[codes[start : start + x + y]].tobytes().translate(None, b"\0")[:-1]
        rows.append((x, y, int(groups[k]), int(links[k]), hashlib.sha256(text).hexdigest() if x else ""))
    return rows, doc, a[at_a], b[at_b]


def _binary(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of x between the places of `ends`, as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _postings(doc: np.ndarray, a: np.ndarray, b: np.ndarray, a_bits: int) -> tuple:
    """b, a, sum, and as binaries documents (16 bits each) and times (8 bits each) for each pair of ids. More than 255 times are several entries."""
    every = np.sort(((b << a_bits | a) << DOCS_BITS) | doc)
    at = np.flatnonzero(np.diff(every, prepend=-1))
    times = np.diff(at, append=len(every))
    entries = (times + 254) // 255
    which = np.repeat(every[at], entries)
    part = np.full(len(which), 255, np.int64)
    part[np.cumsum(entries) - 1] = times - (entries - 1) * 255
    pair = which >> DOCS_BITS
    start = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.add.reduceat(part, start) if len(start) else part
    ends = np.append(start, len(pair))
    pair = pair[start]
    return pair >> a_bits, pair & ((1 << a_bits) - 1), n, _binary((which & ((1 << DOCS_BITS) - 1)).astype("<u2"), ends), _binary(part.astype(np.uint8), ends)


def scan(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (b null) and of postings (doc_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task, block = Tokenizers.of(a_path, b_path), TaskContext.get().partitionId() << 20, 0
        a_bits = max(1, (len(t.a_bytes) - 1).bit_length())
        ids: list = []
        encoded: list[tuple[bytes, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, doc, a, b = link(t, encoded)
            if block >= 1 << 20:
                raise OverflowError("more blocks in a partition than keys have room for")
            own, n = task + block, len(rows)
            cols = list(zip(*rows, strict=True))
            head = [pa.array(np.arange(n) + (own << DOCS_BITS)), pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4])]
            yield pa.RecordBatch.from_arrays([*head, *(pa.nulls(n, x.type) for x in TYPES[7:])], schema=OUT)
            if len(doc):
                pb, pa_, total, at, times = _postings(doc, a, b, a_bits)
                m = len(pb)
                body = [pa.array(np.full(m, own)), pa.array(pb.astype(np.int32)), pa.array(pa_.astype(np.int32)), pa.array(total.astype(np.int64)), at, times]
                whole = pa.RecordBatch.from_arrays([*(pa.nulls(m, x.type) for x in TYPES[:7]), *body], schema=OUT)
                yield from (whole.slice(k, 10_000) for k in range(0, m, 10_000))

        for part in slices(batches, 64):
            texts = part.column(1).to_pylist()
            for doc_id, text, got in zip(part.column(0).to_pylist(), texts, t.encode(texts), strict=True):
                ids.append(doc_id)
                encoded.append(got)
                size += len(text or "")
                if len(ids) == 1 << DOCS_BITS or size >= BLOCK_BYTES:
                    yield from flush()
                    ids, encoded, size, block = [], [], 0, block + 1
        if ids:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)


OUT = pa.schema([(x.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split(" ")[1]]) for x in SCHEMA.split(", ")])
TYPES = list(OUT)


def pair_counts(posts: DataFrame) -> DataFrame:
    """(b, a, n, size): how many links of the corpus hold the pair, and how much its postings weigh."""
    return posts.groupBy("b", "a").agg(F.sum("n").alias("n"), F.sum(F.length("docs") * 1.5 + 32).cast("long").alias("size"))


class _Sums:
    """Contributions by document, summed up when there are many."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, key: np.ndarray, best: np.ndarray, total: np.ndarray) -> None:
        self.parts.append((key, best, total))
        self.held += len(key)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            key, best, total = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            key, best, total = key[at], np.add.reduceat(best[order], at), np.add.reduceat(total[order], at)
            block = key >> DOCS_BITS
            start = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(start, len(block))
            docs = (key & ((1 << DOCS_BITS) - 1)).astype("<u2")
            whole = pa.RecordBatch.from_arrays([pa.array(block[start]), *(_binary(x, ends) for x in (docs, best, total))], ["block", "docs", "best", "total"])
            yield from (whole.slice(k, 100) for k in range(0, len(start), 100))
        self.parts, self.held = [], 0


def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, docs, best, total), as binaries, of a stream sorted by b and part, counts (block null, by a) before postings in each."""
    now, ids, counts, best = -1, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    sums = _Sums()
    for batch in (x for x in batches if len(x)):
        b = batch.column("b").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
        a, n = batch.column("a").to_numpy(), batch.column("n").to_numpy(zero_copy_only=False)
        counted = np.asarray(batch.column("block").is_null())
        block = batch.column("block").fill_null(0).to_numpy()
        starts = np.flatnonzero(np.diff(b, prepend=-1))
        own, top = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
            mid = lo + int(counted[lo:hi].sum())
            if b[lo] != now:
                now, ids, counts, best = b[lo], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            if mid > lo:
                ids, counts = np.concatenate([ids, a[lo:mid]]), np.concatenate([counts, n[lo:mid]]).astype(np.int64)
                best = counts.max()
            if hi > mid:
                own[mid:hi] = counts[np.searchsorted(ids, a[mid:hi])]
                top[mid:hi] = own[mid:hi] == best
        held = np.flatnonzero(~counted)
        if len(held):
            posts = batch.filter(pa.array(~counted))
            docs, times = (np.frombuffer(b"".join(posts.column(c).to_pylist()), kind) for c, kind in (("docs", "<u2"), ("times", np.uint8)))
            many = np.array([len(x) for x in posts.column("times").to_pylist()])
            times = times.astype(np.int64)
            sums.add((np.repeat(block[held], many) << DOCS_BITS) + docs, times * np.repeat(top[held], many), times * np.repeat(own[held], many))
            if sums.held >= FLUSH:
                yield from sums.take()
    yield from sums.take()
    pa.default_memory_pool().release_unused()


def contributions(posts: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, docs, best, total), several rows a block: postings meet their B id's counts in one sorted stream."""
    n = parallelism(posts.sparkSession)
    weights = counts.groupBy("b").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("ids"))
    room = F.lit(weights.agg(F.sum("size")).first()[0] or 1) / (4 * n)
    # A part weighs at least three times as much as the id's counts, which every part gets.
    parts = F.ceil(F.col("size") / F.greatest(room, F.col("ids") * 100)).cast("int")
    hot = F.broadcast(weights.select(F.col("b").alias("hot_b"), parts.alias("parts")).where("parts > 1"))  # at most B's vocabulary
    spread = lambda df: df.join(hot, F.col("b") == F.col("hot_b"), "left")
    many = F.coalesce("parts", F.lit(1))
    heads = spread(counts.select("b", "a", "n")).select("b", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"), "a", "n", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"))
    body = spread(posts).select("b", F.pmod(F.xxhash64("a", "block"), many).cast("int").alias("part"), "a", F.lit(0).cast("long").alias("n"), "block", "docs", "times")
    stream = heads.union(body).repartition(n, "b", "part").sortWithinPartitions("b", "part", F.col("block").isNotNull(), "a")
    return stream.select("b", "part", "a", "n", "block", "docs", "times").mapInArrow(contribute, SUMS)


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their sums, of a stream sorted by block, documents (by place) before contributions in each."""
    names = ["doc_id", *DOC_FIELDS, "n_best", "count_sum", "groups_sha256"]
    heads: list[pa.RecordBatch] = []
    now, sums = None, np.zeros((2, 1 << DOCS_BITS), np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        for h in heads:
            at = h.column("at").to_numpy()
            yield pa.RecordBatch.from_arrays([*(h.column(c) for c in names[:5]), pa.array(sums[0, at]), pa.array(sums[1, at]), h.column("groups_sha256")], names)

    for batch in (x for x in batches if len(x)):
        block = batch.column("block").to_numpy()
        starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for lo, hi in zip(starts, [*starts[1:], len(block)], strict=True):
            if block[lo] != now:
                yield from done()
                now, heads = block[lo], []
                sums[:] = 0
            part = batch.slice(lo, hi - lo)
            known = part.column("docs").is_null()
            if (mine := part.filter(known)).num_rows:
                heads.append(mine)
            more = part.filter(pa.compute.invert(known))
            for k in range(len(more)):
                docs, best, total = (np.frombuffer(more.column(c)[k].as_buffer(), kind) for c, kind in (("docs", "<u2"), ("best", "<i8"), ("total", "<i8")))
                sums[0, docs] += best
                sums[1, docs] += total
    yield from done()


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, DOC_FIELDS, n_best, count_sum, groups_sha256), and pairs (b, a, n): the corpus's counts."""
    own = default_tokenizers()
    rows = materialize(scan(docs, a_path or own[0], b_path or own[1]))
    posts = rows.where("b is not null").select("block", "b", "a", "n", "docs", "times")
    counts = materialize(pair_counts(posts))
    fields = ["doc_id", *DOC_FIELDS, "groups_sha256"]
    heads = rows.where("b is null").select(F.shiftright("key", DOCS_BITS).alias("block"), F.col("key").bitwiseAND(F.lit((1 << DOCS_BITS) - 1)).cast("int").alias("at"), *fields, *(F.lit(None).cast("binary").alias(c) for c in SUM_FIELDS))
    more = contributions(posts, counts).select("block", F.lit(None).cast("int").alias("at"), *(F.lit(None).cast("string" if c == "groups_sha256" else "long").alias(c) for c in fields), *SUM_FIELDS)
    stream = heads.union(more).repartition(parallelism(docs.sparkSession), "block").sortWithinPartitions("block", F.col("docs").isNotNull(), "at")
    out = materialize(stream.mapInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
    discard(rows)
    return out, counts.select("b", "a", "n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
