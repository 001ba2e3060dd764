"""Whitening of embeddings by block subspace iteration, without ever forming a covariance matrix.

Entries c become x = floor(1024 c) + 100000. Each Spark pass computes V Q = Xc' (Xc Q) / n for a block Q of orthonormal columns,
Xc being the rows less the mean S / n: a task sums its rows' products, Spark adds the tasks' sums. The block's image, less
what lies in the subspace kept so far, is orthogonalised (QR) into the next block; Rayleigh-Ritz over all that is kept
gives the components; passes end when the residual of each of the k is at most `tolerance` times the largest
eigenvalue, which bounds its distance from an eigenvalue. Keeping the former blocks, which plain subspace iteration forgets, matters
where eigenvalues hardly fall (embeddings of noise): there each pass would gain next to nothing. Beyond `most_kept`
columns the leading ones stay. The driver holds matrices of dimensions by kept columns, whatever the number of rows; a lost task
is a task of one pass.

A last pass measures how far the whitened rows' covariance is from the identity, and the rows are projected.

Nulls: rows whose vector is null, or holds a null or a non-finite entry, are dropped, and so are empty vectors and those of
another length than most have (of equally frequent lengths the longest counts). A null vec_id stays; rows that repeat a
vec_id, or a vector, count and give rows each. Components without variance (at most 1e-12 of the largest) can't be
whitened and are left out, so equal vectors or a single one give no rows, and so does an empty table. Tied eigenvalues: any
orthonormal basis of their space may come out. A component's sign is such that its entry of largest size is positive. Entries beyond 2^40 are refused.
Columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
LARGEST = 2.0**40
#: Components with a smaller share of the largest eigenvalue count as without variance.
NO_VARIANCE = 1e-12


def _vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have d finite entries, and the x of those as an integer array."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    rows = np.flatnonzero(length == d)
    flat = pc.cast(column.take(pa.array(rows)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), d)
    fine = np.isfinite(flat).all(axis=1)
    flat = flat[fine]
    if np.abs(flat).max(initial=0.0) > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST:g}")
    return rows[fine], (np.floor(flat * SCALE) + SHIFT).astype(np.int64)


@dataclass(frozen=True)
class Profile:
    """The fit list: n vectors of d dimensions, exact sums, largest distance of an x from its dimension's least."""

    n: int
    d: int
    sums: np.ndarray
    spread: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


def profile(vectors: DataFrame) -> Profile | None:
    """Rows are counted and summed by length in the tasks; a row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in slices(batches, 4096):
            column = b.column(0)
            for d in pc.unique(pc.list_value_length(column)).to_pylist():
                x = _vectors(column, d)[1] if d else np.zeros((0, 0))
                if len(x):
                    got = [len(x), x.sum(axis=0), x.min(axis=0), x.max(axis=0)]
                    was = held.get(d)
                    held[d] = [was[0] + got[0], was[1] + got[1], np.minimum(was[2], got[2]), np.maximum(was[3], got[3])] if was else got
        for d, (n, s, low, high) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(s), pa.array(low), pa.array(high)], ["d", "i", "n", "s", "low", "high"])

    parts = vectors.select("embedding").mapInArrow(run, "d long, i long, n long, s long, low long, high long")
    sums = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    best = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).select("n", "d").first()
    if best is None:
        return None
    rows = sums.where(F.col("d") == best.d).orderBy("i").collect()
    return Profile(best.n, best.d, np.array([r.s for r in rows], np.int64), max(r.high - r.low for r in rows))


def _summed(vectors: DataFrame, p: Profile, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of f(centred rows), a matrix of the given shape: one pass."""
    d, mean = p.d, p.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in slices(batches, 4096):
            x = _vectors(b.column(0), d)[1]
            if len(x):
                total += f(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    rows = vectors.select("embedding").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape)
    out.ravel()[[r.at for r in rows]] = [r.v for r in rows]
    return out


def _orthogonal(block: np.ndarray, kept: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what block's columns have outside kept; directions of size at most `least` are dropped."""
    for _ in range(2):
        block = block - kept @ (kept.T @ block)
    q, r = np.linalg.qr(block)
    u, s, _ = np.linalg.svd(r)
    q = q @ u[:, s > least]
    return np.linalg.qr(q - kept @ (kept.T @ q))[0] if q.shape[1] else q


@dataclass(frozen=True)
class Components:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int


def subspace(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int | None = None, most_kept: int | None = None, tolerance: float = 1e-13, max_passes: int = 500, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric matrix that is only known by product(Q), their vectors, residuals, and the passes taken."""
    k = min(k, d)
    block = min(d, block or 2 * k)
    stay = k + block
    most_kept = max(most_kept or 8 * block, stay + 2 * block)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, block)))[0]
    kept, image = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, max_passes + 1):
        kept, image = np.hstack([kept, q]), np.hstack([image, product(q)])
        inner = kept.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = kept @ turn
        away = image @ turn - vectors * values
        residuals = np.linalg.norm(away[:, :k], axis=0)
        scale = max(values[0], np.finfo(float).tiny)
        if len(values) == d or len(values) >= k and (residuals <= tolerance * scale).all():
            return values[:k], vectors[:, :k], residuals, passes
        if len(values) > most_kept - block:
            kept, image = vectors[:, :stay], (image @ turn)[:, :stay]
        open_ = np.flatnonzero(np.linalg.norm(away[:, :stay], axis=0) > tolerance * scale)[:block]
        q = _orthogonal(away[:, open_], kept, 1e-15 * scale)
        if q.shape[1] < min(block, d - kept.shape[1]):  # what is kept is closed under the matrix: look elsewhere
            more = rng.standard_normal((d, min(block, d - kept.shape[1]) - q.shape[1]))
            q = np.hstack([q, _orthogonal(more, np.hstack([kept, q]), 0.0)])
    raise RuntimeError(f"residuals of {residuals.max() / scale:.3g} after {max_passes} passes")


def components(vectors: DataFrame, p: Profile, k: int = COMPONENTS, **options) -> Components:
    traces: list[float] = []

    def product(q: np.ndarray) -> np.ndarray:
        # One column more holds the squares, for the trace.
        out = _summed(vectors, p, lambda x: np.column_stack([x.T @ (x @ q), (x * x).sum(axis=0)]), (p.d, q.shape[1] + 1)) / p.n
        traces.append(float(out[:, -1].sum()))
        return out[:, :-1]

    values, found, residuals, passes = subspace(product, p.d, k, **options)
    real = values > max(values[0], 0) * NO_VARIANCE
    found = found[:, real]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return Components(values[real], found * signs, residuals[real], traces[0], passes)


def whiten(vectors: DataFrame, k: int = COMPONENTS, **options) -> DataFrame:
    """vec_id, component (from 1), n, deviation decimal(38,0), whitened, explained, eigenvalue, residual, identity_error for each row and component."""
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, eigenvalue double, residual double, identity_error double"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    p = profile(vectors)
    if p is None:
        return spark.createDataFrame([], schema)
    c = components(vectors, p, k, **options)
    m = len(c.values)
    if not m:
        return spark.createDataFrame([], schema)
    d, n, sums, mean = p.d, p.n, p.sums, p.mean
    onto = c.vectors / np.sqrt(c.values)
    # Rows and their sum, so that the covariance is centred whatever rounding left.
    square = _summed(vectors, p, lambda x: np.vstack([(w := x @ onto).T @ w, w.sum(axis=0)]), (m + 1, m)) / n
    error = float(np.abs(square[:m] - np.outer(square[m], square[m]) - np.eye(m)).max())
    wide = d * (n * (p.spread + 1)) ** 2 >= 2**63

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            rows, x = _vectors(b.column(1), d)
            if not len(x):
                continue
            exact = (x.astype(object) if wide else x) * n - sums
            deviation = (exact * exact).sum(axis=1)
            deviation = pa.array([str(v) for v in deviation] if wide else deviation)
            at = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), deviation.take(at), pa.array(((x - mean) @ onto).ravel())], ["vec_id", "component", "deviation", "whitened"])

    out = vectors.mapInArrow(project, f"vec_id long, component int, deviation {'string' if wide else 'long'}, whitened double")
    pick = lambda x: F.element_at(F.array(*(F.lit(float(v)) for v in x)), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", pick(c.values / c.trace).alias("explained"), pick(c.values).alias("eigenvalue"), pick(c.residuals).alias("residual"), F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long, as far as it fits; beyond, the cast raises (the operator's decimal goes further)."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
