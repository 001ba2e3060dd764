"""Near duplicates by SimHash, linked by a binary trie joined with itself.

Each text gets 64 bits from the XXH64 (seed 42) of its 3-word shingles. Equal fingerprints are one node from then
on, with the least doc_id of its documents, so exact copies cost nothing. The distinct fingerprints form a
binary trie; pairs of its nodes are walked together from the root, adding up the bits in which they differ,
and a pair is dropped once it has more than `budget`. The top of the walk is dealt out by Spark: a
fingerprint goes to each pair of nodes, at a depth that leaves about `node_rows` fingerprints a node, that it
can still be part of; pairs with too many rows are walked down further before, round by round, with the
budget that they have left. Each remaining pair is walked in one task with arrays, and only a spanning
forest of the links found leaves it. Components come from large-star and small-star rounds.

Nulls: a null text is an empty one; rows without doc_id are left out; of rows that repeat a doc_id each is
fingerprinted and each is returned, the id belonging to the components of all (those are linked through the
id). Texts without words have fingerprint zero and link like any other. Extra columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_null, connected_components, materialize, parallelism, table

BITS = 64
BUDGET = 2
SHINGLE = 3
#: About so many fingerprints share a node where tasks take over, and at most so many rows form a task.
NODE_ROWS = 32_768
TASK_ROWS = 8 * NODE_ROWS
#: Bits that an overfull pair is walked down by in a round.
STEP = 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in pieces; of all words where there are fewer, of nothing without words."""
    words = text.encode().translate(_LOWER).split()  # bytes.split() parts at space and U+0009 to U+000D
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    count, digest = len(words) - width + 1, xxhash.xxh64_intdigest
    for k in range(0, count, 32_768):
        m = min(count, k + 32_768)
        yield np.array([digest(joined[a:b], 42) for a, b in zip(start[k:m].tolist(), end[k + width - 1 : m + width - 1].tolist(), strict=True)], np.uint64)


def fingerprint(pieces: Iterable[np.ndarray]) -> int:
    """Of shingles' hashes: bits that over half of them have."""
    tally, count = np.zeros(BITS, np.int64), 0
    for h in pieces:
        tally += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(h)
    return int(np.packbits(2 * tally > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py())) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) that differ in at most budget bits below depth: x of a and y of b, or of a alone.

    a and b: sorted distinct uint64, each with one prefix of depth bits. Node pairs are ranges in them;
    a level is walked for all at once, in pieces of bounded size, last found first.
    """
    own = b is None
    b = a if own else b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    prefix = BITS - depth
    mask = np.uint64((1 << prefix) - 1) if prefix < 64 else np.uint64(2**64 - 1)
    todo = [(depth, np.array([[0, len(a), 0, len(b), 0, int(own)]], np.int64))]
    while todo:
        d, p = todo.pop()
        small = ((p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]) <= 16) | (d >= BITS)
        if small.any():
            q = p[small]
            wa, wb = q[:, 1] - q[:, 0], q[:, 3] - q[:, 2]
            many = wa * wb
            which = np.repeat(np.arange(len(q)), many)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            x, y = a[q[which, 0] + nth // wb[which]], b[q[which, 2] + nth % wb[which]]
            ok = _popcount((x ^ y) & mask) <= budget
            if own:
                ok &= (q[which, 5] == 0) | (x < y)
            found.append((x[ok], y[ok]))
            p = p[~small]
        if not len(p):
            continue
        bit = np.uint64(1 << (BITS - 1 - d))
        high = np.uint64((0xFFFFFFFFFFFFFFFF << (BITS - d)) & 0xFFFFFFFFFFFFFFFF if d else 0)
        am = np.searchsorted(a, (a[p[:, 0]] & high) | bit)
        bm = np.searchsorted(b, (b[p[:, 2]] & high) | bit)
        a0, a1, b0, b1, e, s = p.T
        next_ = np.concatenate([np.column_stack([a0, am, b0, bm, e, s]), np.column_stack([am, a1, bm, b1, e, s]), np.column_stack([a0, am, bm, b1, e + 1, 0 * s]), np.column_stack([am, a1, b0, bm, e + 1, 0 * s])[s == 0]])
        next_ = next_[(next_[:, 0] < next_[:, 1]) & (next_[:, 2] < next_[:, 3]) & (next_[:, 4] <= budget)]
        todo += [(d + 1, next_[k : k + 500_000]) for k in range(0, len(next_), 500_000)]
        if sum(len(x) for x, _ in found) > 4_000_000:
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            found = [forest(x, y)]
    if not found:
        return a[:0], a[:0]
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return forest(x, y)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, node) that join what the links x - y join, one less than nodes in each part."""
    if not len(x):
        return x, y
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = at[: len(x)], at[len(x) :]
    top = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(top[u], top[v]), np.maximum(top[u], top[v])
        if (lo == hi).all():
            break
        np.minimum.at(top, hi, lo)
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up
    away = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[top[away]], nodes[away]


def _spread(step: int, left: str, budget: int):
    """What `step` bits further down can differ within the budget left: array of (mask, left)."""
    masks = [m for m in range(1 << step) if bin(m).count("1") <= budget]
    options = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), (F.col(left) - bin(m).count("1")).cast("int").alias("left")) for m in masks])
    return F.filter(options, lambda o: o["left"] >= 0)


def links(nodes: DataFrame, node_rows: int = NODE_ROWS, task_rows: int = TASK_ROWS, budget: int = BUDGET) -> DataFrame:
    """(a, b): a spanning forest of the pairs of fingerprints within the budget. nodes: distinct (fp).

    A row of the walk is a fingerprint in a pair of nodes: depth; prefix (its own node, the fingerprint's
    upper bits); diff (own node xor the other one); left (budget that remains). The pair is named by the
    lesser of both nodes and diff.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    depth = max(0, min(40, int(np.ceil(np.log2(max(1, count / node_rows))))))
    prefix = lambda d: F.shiftrightunsigned("fp", BITS - d) if d else F.lit(0).cast("long")
    pair = lambda p, diff: F.least(p, p.bitwiseXOR(diff))
    masks = [sum(1 << i for i in bits) for k in range(min(budget, depth) + 1) for bits in combinations(range(depth), k)]
    start = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("diff"), F.lit(budget - bin(m).count("1")).alias("left")) for m in masks]))
    rows = nodes.select("fp", start.alias("o")).select("fp", "o.diff", "o.left").withColumn("low", pair(prefix(depth), F.col("diff")))
    out = None
    while True:
        sizes = rows.groupBy("low", "diff").agg(F.count(F.lit(1)).alias("rows"))
        big = materialize(sizes.where((F.col("rows") > task_rows) & F.lit(depth < BITS)))
        over = big.count() > 0
        done = rows.join(big.select("low", "diff"), ["low", "diff"], "left_anti") if over else rows
        found = done.groupBy("low", "diff").applyInArrow(_walker(depth), "a long, b long")
        out = found if out is None else out.union(found)
        if not over:
            return out
        step = min(STEP, BITS - depth)
        deeper = rows.join(big.select("low", "diff"), ["low", "diff"], "left_semi").withColumn("o", F.explode(_spread(step, "left", budget)))
        depth += step
        rows = materialize(
            deeper.select("fp", F.shiftleft("diff", step).bitwiseOR(F.col("o.mask")).alias("diff"), F.col("o.left").alias("left")).withColumn("low", pair(prefix(depth), F.col("diff")))
        )


def _walker(depth: int):
    return lambda t: _walk_group(t, depth)


def _walk_group(t: pa.Table, depth: int) -> pa.Table:
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    fp = np.unique(t.column("fp").to_numpy().view(np.uint64))
    low, diff, left = (t.column(c)[0].as_py() for c in ("low", "diff", "left"))
    if diff == 0:
        x, y = walk(fp, None, depth, left) if len(fp) > 1 else (fp[:0], fp[:0])
    else:
        own = (fp >> np.uint64(BITS - depth)) == np.uint64(low & (2**64 - 1))
        if own.all() or not own.any():
            return empty
        x, y = walk(fp[own], fp[~own], depth, left)
    return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_same (documents with the same fingerprint)."""
    fps = materialize(fingerprints(docs))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")))
    hash_links = links(nodes.select("fp"), node_rows, task_rows)
    twice = fps.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id", "a")
    by_id = fps.join(twice, "doc_id").select("a", F.col("fp").alias("b"))
    comps = materialize(connected_components(hash_links.union(by_id)))
    linked = comps.join(nodes, comps.node == nodes.fp).select("component", "fp", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(least, "component").select(F.col("fp").alias("f"), "component_id")
    named = nodes.join(of_fp, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("f"), F.coalesce("component_id", "least").alias("component_id"), "n_same")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
