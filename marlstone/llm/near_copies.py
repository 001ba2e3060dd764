"""Near copies by SimHash and, beyond its budget of bits, by an exact join of the sets of word shingles.

A text is the set of its shingles (WIDTH words, ASCII lower case, by XXH64 with seed 42); texts are linked that have at
least OVER / UNDER of the shingles of both in common. Equal sets are one node from then on. Each has a fingerprint, and the
links of the trie's walk are compared first (by their sets, as all pairs here). Similar sets differ in 3 to 14 of 64
bits as a rule, which no walk can afford, so what it doesn't find follows from the sets: nodes are compared that share
a shingle in their prefixes: in one order of all shingles, two sets that are similar enough have one in common
among the first n - ceil(0.8 n) + 1 of each. Frequent shingles of a sample come last in that order, so a common line
makes no pairs; the sample changes how many pairs are looked at, never which are found.

In ROUNDS rounds each node is compared with one node that it shares a shingle with, so most of a large group of near copies
becomes one component with few comparisons each. Then all other pairs in different components follow that pass three bounds which
no similar pair fails at the first shingle in common: of sizes, of what is left of both sets from there, and of the
parities of 256 counters, whose bits differ at most as often as the sets do. All pairs then meet the parities of at least four counters
a shingle, which few pairs pass that aren't similar. What is left is compared by the sets themselves, computed anew from
those texts alone: in SETTLED rounds one pair a node, then all pairs that still are in different components.

Nulls: a null text is an empty one; rows without doc_id are left out; rows that repeat a doc_id link through the id. Texts
without words are equal to each other; shorter texts than WIDTH words are one shingle. Sets are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_null, connected_components, discard, materialize, possible, slices
from .simhash import fingerprint, links, shingle_hashes

WIDTH = 5
#: Similarity, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Documents looked at for frequent shingles, how many of them have such a one, and at most so many are known.
SAMPLE, FREQUENT, MOST = 4_000, 5, 200_000
#: Rounds of one comparison a node before all pairs that are left.
ROUNDS = 2
_BITS = ["b0", "b1", "b2", "b3"]
#: Rounds of one comparison a node among the pairs that passed all bounds, before all that are left of them.
SETTLED = 1
#: Counters of the last bound: at least so many a shingle, in a power of two up to MOST_COUNTERS, by which pairs are compared before their sets are read.
COUNTERS, MOST_COUNTERS = 4, 1 << 20


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles, ascending."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def parities(x: np.ndarray) -> np.ndarray:
    """Bits of the counters of a set. Both halves of them, xored, are the bits of half as many counters."""
    m = min(MOST_COUNTERS, max(64, 1 << (COUNTERS * len(x) - 1).bit_length()))
    odd = (np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _node(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes())


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text")).where("doc_id is not null")


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            x = [shingles(t.as_py(), width) for t in b.column(1)]
            names = np.array([_node(s) for s in x], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([s.view(np.int64) for s in x], pa.list_(pa.int64()))], ["node", "shingles"])

    return _ids(docs).mapInArrow(run, "node long, shingles array<long>")


def frequent(docs: DataFrame, width: int = WIDTH, sample: int = SAMPLE) -> np.ndarray:
    """Shingles that many distinct texts of a sample have, ascending; they only choose the order."""
    some = _ids(docs)
    share = sample / max(1, some.count())
    if share < 1:
        some = some.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1_000_000)) < int(share * 1_000_000))
    seen = sets(some, width).dropDuplicates(["node"]).select(F.explode("shingles").alias("h")).groupBy("h").count()
    top = seen.where(F.col("count") >= FREQUENT).orderBy(F.col("count").desc(), "h").limit(MOST).select("h").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def described(docs: DataFrame, last: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(doc_id, node, fp, n, b0 to b3, wide, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes, fps, n, bits, wide, prefixes = [], [], [], [], [], []
            for t in b.column(1):
                x = shingles(t.as_py(), width)
                nodes.append(_node(x))
                fps.append(fingerprint(x[k : k + 32_768] for k in range(0, len(x), 32_768)))
                n.append(len(x))
                odd = (np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
                bits.append(np.packbits(odd, bitorder="little").view("<i8"))
                wide.append(parities(x))
                known = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x if len(last) else np.zeros(len(x), bool)
                first = len(x) - -(-OVER * len(x) // UNDER) + 1 if len(x) else 0
                prefixes.append(np.concatenate([x[~known], x[known]])[:first].view(np.int64))
            bits = np.array(bits, np.int64).reshape(-1, 4)
            columns = [b.column(0), *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in (nodes, fps)], pa.array(n, pa.int32()), *[pa.array(bits[:, k]) for k in range(4)], pa.array(wide, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fp", "n", *_BITS, "wide", "prefix"])

    return _ids(docs).mapInArrow(run, "doc_id long, node long, fp long, n int, " + ", ".join(f"{c} long" for c in _BITS) + ", wide array<long>, prefix array<long>")


def _may_reach(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles can be similar whose first common one is at i and j."""
    return (F.least(n, m) * UNDER >= F.greatest(n, m) * OVER) & (F.least(n - i, m - j) * (OVER + UNDER) >= (n + m) * OVER)


def _halved(c: str) -> Column:
    half = (F.size(c) / 2).cast("int")
    return F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose parities differ in no more bits than similar sets do; sizes must have been compared."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in ("a", "b"))
    p = F.when(F.size("wide_a") > F.size("wide_b"), _halved("wide_a")).otherwise(F.col("wide_a"))
    q = F.when(F.size("wide_b") > F.size("wide_a"), _halved("wide_b")).otherwise(F.col("wide_b"))
    differ = F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, d: s + d)
    return pairs.join(y, "b").join(x, "a").where(differ * (OVER + UNDER) <= (F.col("n_a") + F.col("n_b")) * (UNDER - OVER)).select("a", "b")


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough; only their texts are read as sets."""
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least"), "node"))
    texts = possible(_ids(docs), wanted.select("least")).join(wanted.select(F.col("least").alias("id")).distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    known = materialize(sets(texts, width).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(known.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(known.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    out = materialize(both.where(common * (OVER + UNDER) >= (F.size("x") + F.size("y")) * OVER).select("a", "b"))
    discard(pairs, wanted, known)
    return out


def linked_by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes to compare: those of one fingerprint with the least of them, and the least ones of linked fingerprints."""
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    p, q = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b"))
    near = links(heads.select("fp")).join(p, "a").join(q, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    pairs = same.union(near).distinct()
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    fits = F.least("n_a", "n_b") * UNDER >= F.greatest("n_a", "n_b") * OVER
    out = materialize(pairs.join(x, "a").join(y, "b").where(fits).select("a", "b"))
    discard(heads)
    return out


def _joined(comps: DataFrame, linked: DataFrame) -> DataFrame:
    """Components of those of comps (node, component) and the links (a, b) between their nodes or others."""
    p, q = (comps.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")) for c in ("a", "b"))
    between = linked.join(p, "a", "left").join(q, "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    out = materialize(connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(between)))
    discard(comps, linked)
    return out


def near_copies(docs: DataFrame, width: int = WIDTH, sample: int = SAMPLE) -> DataFrame:
    """doc_id, component_id: the least doc_id that a document is linked with, through others too."""
    all_ = materialize(described(docs, frequent(docs, width, sample), width))
    rows = materialize(all_.select("doc_id", "node"))
    nodes = materialize(all_.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ["fp", "n", *_BITS, "wide", "prefix"]]))
    discard(all_)
    several = nodes.select(F.explode("prefix").alias("h")).groupBy("h").count().where("count > 1").select("h")
    shared = materialize(nodes.select("node", "n", F.posexplode("prefix").alias("pos", "h")).join(several, "h"))
    by_id = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    first = linked_by_fingerprint(nodes)
    linked = similar(_close(first, nodes), docs, nodes, width)
    comps = materialize(connected_components(rows.join(by_id.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).union(linked)))
    discard(first, linked)
    part = F.coalesce("component", "node")
    for k in range(ROUNDS + 1):
        placed = shared.join(comps, "node", "left").select("h", "node", "n", "pos", part.alias("part"))
        open_ = placed.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("o"), "node", "n", "pos", "part")).alias("hub")).where("p < q").select("h", "hub")
        left = materialize(placed.join(open_, "h"))
        if k < ROUNDS:
            one = left.where((F.col("hub.part") != F.col("part")) & _may_reach(F.col("hub.n"), F.col("hub.pos"), F.col("n"), F.col("pos"))).groupBy("node").agg(F.min_by("hub.node", "hub.o").alias("b"))
            linked = similar(_close(one.select(F.col("node").alias("a"), "b"), nodes), docs, nodes, width)
            comps = _joined(comps, linked)
            discard(left)
    discard(shared)
    whole = left
    left = left.drop("hub").join(nodes.select("node", *_BITS), "node")
    x, y = left.alias("x"), left.alias("y")
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _BITS), F.lit(0))
    fits = (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & _may_reach(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")) & (differ * (OVER + UNDER) <= (F.col("x.n") + F.col("y.n")) * (UNDER - OVER))
    rest = x.join(y, (F.col("x.h") == F.col("y.h")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    rest = materialize(_close(rest, nodes))
    discard(whole)
    for k in range(SETTLED + 1):
        p, q = (comps.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")) for c in ("a", "b"))
        apart = rest.join(p, "a", "left").join(q, "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
        if k < SETTLED:
            apart = apart.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(k))).alias("b"))
        linked = similar(apart.select("a", "b"), docs, nodes, width)
        comps = _joined(comps, linked)
    discard(rest)

    named = nodes.select("node", "least").join(comps, "node", "left").select("node", "least", part.alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(least, "part").select("node", "component_id"), "node").select("doc_id", "component_id")
