"""Work of the sparse engine that must not grow faster than its input."""

import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone import queries as Q
from marlstone import storage
from marlstone.model import Matrix, SolverParams
from marlstone.operators import blocks as B
from marlstone.operators import checks as C
from marlstone.operators import multilevel, pivots
from marlstone.plans import bordered, dense, sweep
from marlstone.plans.dense import dense_lu
from marlstone.plans.factorize import stop_reason
from marlstone.plans.triangular import joined
from marlstone.storage import materialize

D = "/root/testdata/sf0.001"


def matrix(spark, dense):
    e = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    return Matrix.of(spark.createDataFrame(e, "row int, col int, val double"), *dense.shape)


def dominant(n, seed, density=0.12):
    r = np.random.default_rng(seed)
    a = np.where(r.random((n, n)) < density, r.integers(-5, 6, (n, n)), 0).astype(float)
    np.fill_diagonal(a, np.abs(a).sum(1) + 1)
    return a


def test_small_rest_goes_dense():
    """A rest that one task takes, or a few panels, isn't worth steps that find little; nor are a border's rows counted."""
    p = SolverParams()
    assert stop_reason(3_000, 120_000, 120_000, 118_593, [9_000] * 4 + [402], p) == "small"
    assert stop_reason(50_000, 120_000, 120_000, 110_000, [9_000] * 4 + [511], p) == "small"
    assert stop_reason(50_000, 120_000, 120_000, 110_000, [9_000] * 4 + [5_000], p) is None and stop_reason(90_000, 120_000, 120_000, 80_000, [9_000] * 4 + [500], p) is None
    assert stop_reason(50_000, 120_000, 112_000, 111_000, [9_000] * 4 + [400], p, bordered=True) == "small"
    assert stop_reason(2_000, 20_000, 20_000, 18_500, [9_000] * 4 + [900], p) is None and stop_reason(3_000, 120_000, 120_000, 118_593, [402], p) is None


def test_rows_without_interior_stay_sparse(monkeypatch):
    """A block's lines without interior entries are passed on as they are, outside the dense arrays."""
    shapes = []
    monkeypatch.setattr(bordered, "dense_lu", lambda x: shapes.append(x.shape) or dense_lu(x))
    e = [(0, 0, 4.0, True), (1, 0, 2.0, True), (0, 7, 1.0, False), *[(r, r, 3.0, False) for r in range(5, 40)]]
    t = pd.DataFrame([(0, "e", *x) for x in e] + [(0, "b", r, -1, float(r), True) for r in (0, 1, 4, *range(5, 40))], columns=["block", "part", "row", "col", "val", "interior"])
    out = bordered._eliminated(t)
    assert shapes == [(2, 1)]
    lines = out[out.part == "line"]
    right = {r: v for r, c, v in zip(lines.row, lines.col, lines.val, strict=True) if c == -1}
    cells = {(r, c): v for r, c, v in zip(lines.row, lines.col, lines.val, strict=True) if c != -1}
    assert len(right) == 37 and right[0] == 1.0 and cells[0, 7] == -0.5 and right[1] == 4.0
    assert sorted(right[r] for r, c in cells if c >= 5 and r > 0) == [float(x) for x in range(5, 40)] and len(cells) == 36


def test_long_levels_are_shuffled(spark, monkeypatch):
    """The vector of a solve isn't broadcast, and a level's entries only if they are few."""
    e = spark.createDataFrame([(0, 1, 0, 0.5), (1, 2, 1, 0.5)], "level int, row int, col int, val double")
    v = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "i int, x double")
    levels = joined(e, 2, 0.0)
    assert levels.most == (1, 1) and joined(e, 2, 9.0).most == (3,)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" in plan(levels.apply(v))
    monkeypatch.setattr(storage, "NEAR_ROWS", 0)
    assert "BroadcastHashJoin" not in plan(levels.apply(v)) and sorted(levels.apply(v).collect()) == [(0, 1.0), (1, 1.5), (2, 1.75)]


@pytest.mark.parametrize("few", [1_000, 0])
def test_blocks_are_merged_in_few_rounds(spark, few):
    """As many blocks as candidates take no more tables than chains of cells that cross each other are long, and give what going through them in order gives."""
    a = np.eye(400) + np.diag(np.tile([1.0, 0.0], 200)[:399], 1)
    e = matrix(spark, a).entries
    sets, kept = spark.createDataFrame([(k, k, k, 0) for k in range(400)], "block long, row int, col int, cost long"), []
    found = pivots.merged_sets(e, sets, lambda df: kept.append(materialize(df)) or kept[-1], few)
    assert found.count() == 200 and C.independence(e, materialize(found)).first()[0] == 0 and len(kept) <= 6


def test_orders_of_one_span_are_joined_once(spark):
    plan = Q.QUERIES["ship_span_overlaps"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[lo#\d+, hi#\d+L?\]", plan)


def test_grown_reads_its_matrix_once(spark):
    e = matrix(spark, dominant(30, 4)).entries
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "double")
    n = e.count()
    assert B.grown(e.select("row", "col", "val").where(seen(F.col("row").cast("double")) >= 0), 30, 3, rounds=2).count() == 30
    assert read.value <= n


def test_partition_levels_shrink_fast(spark):
    """A level of the multilevel partition leaves fewer than half of the vertices of a chain, none too heavy, and few of those without a net."""
    vertices = spark.range(3000).select(F.col("id").cast("int").alias("v"), F.lit(1).cast("long").alias("weight"))
    pins = spark.range(1999).select(F.explode(F.array(F.col("id").cast("int"), (F.col("id") + 1).cast("int"))).alias("v"), F.col("id").cast("int").alias("net"))
    found = multilevel.clusters(pins, vertices, 75.0, 0).toPandas()
    assert sorted(found.v) == list(range(3000)) and found.groupby("c").weight.sum().max() <= 75
    assert found[found.v < 2000].c.nunique() < 1000 and found[found.v >= 2000].c.nunique() <= 30


def test_long_sides_are_merged(spark):
    """A side that is known to be long isn't broadcast because its file is small."""
    a, b = (materialize(spark.range(100).select(F.col("id").alias(c))) for c in ("x", "y"))
    plan = lambda rows: a.join(storage.near(b, rows), F.col("x") == F.col("y"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(100) and "SortMergeJoin" in plan(storage.NEAR_ROWS + 1)


def test_blocks_are_read_in_pieces(spark):
    """A row group holds few blocks, however well they are compressed, so that a read of a large dense part's tables stays small; an update is one shuffle, dealt by bytes."""
    import glob

    import pyarrow.parquet as pq

    e = spark.range(1_536).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(2.0).alias("val"))
    blocks = dense.table(dense.blocked(e, 1_536, 1_536, 512).coalesce(1), 512)
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(blocks._shared_path.removeprefix("file://") + "/*.parquet")]
    assert sum(g.num_rows for g in groups) == 9 and max(g.row_group(k).num_rows for g in groups for k in range(g.num_row_groups)) * 8 * 512**2 <= dense.GROUP
    f = dense.factorize_blocks(blocks, 1_536, 1_536, 512)
    assert [r.k for r in f.pivots.orderBy("k").collect()] == [0, 1, 2]
    x = dense.solve_blocks(f, e.select("i", (F.col("i") * 2.0).alias("x")))
    assert x.where(F.col("x") != F.col("i")).count() == 0 and x.count() == 1_536


def test_long_rows_go_to_python_in_pieces(spark):
    """While a table of long rows is written, a worker gets few of them at once; the setting comes back."""
    was = spark.conf.get(storage.BATCH)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    long = spark.range(0, 40, 1, 1).select(F.expr("cast(repeat('0', 1000000) as binary)").alias("x"))
    assert max(r.n for r in materialize(long.mapInArrow(sizes, "n long"), group=8).collect()) <= 20 and spark.conf.get(storage.BATCH) == was


@pytest.mark.parametrize(("few", "most"), [(0, 1), (1_000, 2)])
def test_large_sweeps_go_one_by_one(spark, monkeypatch, few, most):
    """Runs over a large matrix follow each other, so that what they hold doesn't add up."""
    now, seen = [0], []

    def run(*_):
        now[0] += 1
        seen.append(now[0])
        time.sleep(0.5)
        now[0] -= 1
        return dict.fromkeys(c.split()[0] for c in sweep.RUN.split(", "))

    monkeypatch.setattr(sweep, "_run", run)
    monkeypatch.setattr(sweep, "NEAR_ROWS", few)
    assert sweep.sweep(matrix(spark, np.eye(4)), "marko_tol", 2.0, 2.0, 2).count() == 2 and max(seen) == most
