"""The sparse engine's newer parts: partitions, nested borders, sources, intervals, measured runs, concurrent sweeps, statistics."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import queries as Q
from marlstone.model import Matrix, SolverParams
from marlstone.operators import algebra as A
from marlstone.operators import blocks as B
from marlstone.operators import checks as C
from marlstone.operators import layout as L
from marlstone.operators import multilevel, pivots
from marlstone.plans import bordered, options, report, sweep
from marlstone.plans.factorize import cross_check_permuted, factorize, solve, tail_blocks
from marlstone.sources import triplet_source as S
from marlstone.sources import triplets as T
from marlstone.storage import materialize, metrics_of

D = "/root/testdata/sf0.001"


def matrix(spark, dense):
    e = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    return Matrix.of(spark.createDataFrame(e, "row int, col int, val double"), *dense.shape)


def dominant(n, seed, density=0.12):
    r = np.random.default_rng(seed)
    a = np.where(r.random((n, n)) < density, r.integers(-5, 6, (n, n)), 0).astype(float)
    np.fill_diagonal(a, np.abs(a).sum(1) + 1)
    return a


def blocks_of(n, k, cross, seed):
    """A shuffled matrix of k dense-ish diagonal blocks and a few entries across; and each row's block."""
    r = np.random.default_rng(seed)
    of = np.repeat(np.arange(k), n // k)
    a = np.where((of[:, None] == of[None, :]) & (r.random((n, n)) < 0.15), 1.0, 0.0)
    a[r.integers(0, n, cross), r.integers(0, n, cross)] = 1.0
    np.fill_diagonal(a, a.sum(1) + 1)
    rows = r.permutation(n)
    return a[rows], of[rows]


def cut(a, of):
    return sum(len(set(of[np.flatnonzero(a[:, j])])) > 1 for j in range(a.shape[1]))


@pytest.mark.parametrize("name", ["ship_span_overlaps", "range_overlaps", "triplet_round_trip", "triplet_columns", "first_step_counts", "border_stats", "random_permutation_check"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "part", "supplier", "lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = Q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    plain = lambda r: [float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]
    got = sorted(str(plain(r)) for r in df.select(cols).collect())
    want = sorted(str(plain(r)) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({Q.ORACLES[name]})").fetchall())
    assert got == want and got


def test_multilevel_partition(spark):
    """Far fewer columns cut than by equal ranges of the shuffled rows, near what the blocks were made with; blocks keep to their room."""
    a, of = blocks_of(480, 4, 40, 1)
    m = matrix(spark, a)
    found = multilevel.partition(m.entries, 480, 4, coarse=60).collect()
    at = np.zeros(480, int)
    at[[r.row for r in found]] = [r.block for r in found]
    assert len(found) == 480 and np.bincount(at).max() <= 1.1 * 120
    assert cut(a, at) <= min(0.5 * cut(a, np.arange(480) // 120), 1.3 * cut(a, of))


def test_partition_against_every_other(spark):
    """On few rows the cut is that of the best of all balanced partitions, or one more."""
    a, _ = blocks_of(10, 2, 6, 4)
    m = matrix(spark, a)
    found = {r.row: r.block for r in multilevel.partition(m.entries, 10, 2, slack=1.2).collect()}
    best = min(cut(a, np.array([int(i in half) for i in range(10)])) for size in (4, 5) for half in itertools.combinations(range(10), size))
    assert cut(a, np.array([found[i] for i in range(10)])) <= best + 1
    with pytest.raises(ValueError):
        multilevel.partition(m.entries, 10, 0)
    assert multilevel.partition(m.entries, 10, 1).select("block").distinct().count() == 1


def test_coarse_graphs_are_cut_well():
    r = np.random.default_rng(2)
    for _ in range(5):
        w = np.triu(np.where(r.random((10, 10)) < 0.4, r.random((10, 10)), 0), 1)
        w += w.T
        at = multilevel.cut_graph(w, np.ones(10), 2, 5.0)
        best = min(multilevel._cut_of(w, np.array([int(i in half) for i in range(10)])) for half in itertools.combinations(range(10), 5))
        assert np.bincount(at).max() == 5 and multilevel._cut_of(w, at) <= 1.5 * best + 1e-9


def test_matching_is_a_matching(spark):
    a, _ = blocks_of(120, 4, 20, 3)
    pins = matrix(spark, a).entries.select(F.col("row").alias("v"), F.col("col").alias("net"))
    vertices = spark.range(120).select(F.col("id").cast("int").alias("v"), F.lit(1).cast("long").alias("weight"))
    edges = multilevel.pairs(pins, vertices, 0)
    assert edges.where("u >= v").count() == 0
    pairs = multilevel.matching(edges, vertices, 2.0).collect()
    ends = [x for p in pairs for x in p]
    assert len(ends) == len(set(ends)) and len(pairs) > 30
    assert multilevel.matching(edges, vertices, 1.0).count() == 0


def test_nested_borders(spark):
    """Borders over the limit are bordered themselves, or factorised, with one solution; each partitioner gives a form that holds."""
    a, _ = blocks_of(96, 8, 30, 6)
    m = matrix(spark, a)
    b = materialize(A.spmv(m.entries, T.default_vector(spark, 96), 96))
    small = SolverParams(max_dense_schur=6, dense_block=16, density_tolerance=0.8)
    for p in (bordered.BorderedParams(8, solver=small), bordered.BorderedParams(4, "ranges", nested=False, solver=small)):
        done = bordered.run(m, b, p)
        assert np.allclose([v for _, v in sorted(done["x"].collect())], np.arange(1, 97)) and done["backward_error"] < 1e-12
        assert done["border"]["n_border"] == B.col_blocks(m.entries, done["assigned"]).where("block is null").count()
    for bad in ({"num_blocks": 0}, {"partitioner": "odd"}):
        with pytest.raises(ValueError):
            bordered.BorderedParams(**bad)


def test_bordered_run_from_files(spark, tmp_path):
    m = matrix(spark, dominant(24, 4, 0.05))
    T.write_triplets(m, f"file://{tmp_path}/m.mtl")
    o = options.parse(["--matrix", f"file://{tmp_path}/m.mtl", "--output_file", f"{tmp_path}/log"])
    done = options.run_bordered(spark, o, 2)
    assert done["forward_error"] < 1e-10 and "border columns" in (tmp_path / "log").read_text()


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    """Every pair of ranges that meet, once, at any size and sign; no loop over all pairs in the plan."""
    r = np.random.default_rng(seed)
    span = [40, 10**6, 2**40][seed]
    make = lambda n: [(k, int(lo), int(lo + max(0, w))) for k, (lo, w) in enumerate(zip(r.integers(-span, span, n), r.integers(-2, span // 3, n), strict=True))]
    a, b = make(60), make(80)
    df = lambda x: spark.createDataFrame(x, "id int, lo long, hi long")
    out = L.ranges_overlap(df(a), df(b))
    got = sorted((x.a_id, x.b_id) for x in out.collect())
    assert got == sorted((i, j) for i, lo, hi in a for j, lo2, hi2 in b if lo < hi2 and lo2 < hi and lo < hi and lo2 < hi2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_triplet_source(spark, tmp_path):
    """Parts written by many tasks, read by ranges of any number of bytes, with few columns or a filter; what is wrong is refused."""
    m = matrix(spark, dominant(40, 8))
    want = sorted(map(tuple, m.entries.collect()))
    out = f"file://{tmp_path}/parts"
    S.write(Matrix(m.entries.repartition(5), 40, 40), out)
    for split in (7, 100, 1 << 20):
        back = S.read(spark, out, split_bytes=split)
        assert back.n == 40 and sorted(map(tuple, back.entries.collect())) == want
    names = sorted(x.name for x in (tmp_path / "parts").iterdir())
    assert names[:2] == ["_SUCCESS", "_header"] and not any(x.startswith("_temporary") for x in names)
    with pytest.raises(Exception, match="FileExists"):
        S.write(m, out)
    S.write(m, out, mode="overwrite")
    T.write_triplets(m, f"file://{tmp_path}/one")
    file = next(str(x) for x in (tmp_path / "one").iterdir() if x.name.startswith("part"))
    assert sorted(map(tuple, S.read(spark, file, split_bytes=64).entries.collect())) == want
    few = spark.read.format("triplets").schema("val double, col int").option("split_bytes", 50).load(file)
    assert few.rdd.getNumPartitions() > 5 and sorted(map(tuple, few.collect())) == sorted((v, c) for _, c, v in want)
    reader = S.TripletReader({"path": file, "split_bytes": "50"}, few.schema)
    everything = len(reader.partitions())
    list(reader.pushFilters([S.GreaterThanOrEqual(("col",), 10), S.LessThan(("col",), 12)]))
    some = [c for p in reader.partitions() for b in reader.read(p) for c in b.column("col").to_pylist()]
    assert len(reader.partitions()) < everything / 3 and sorted(c for c in some if 10 <= c < 12) == sorted(c for _, c, _ in want if 10 <= c < 12)
    for text in ("3 3\n1 1 x\n", "3 3\n1 1\n", "3 3\n1 1 1.0\n", "\n"):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(Exception, match="expected"):
            S.read(spark, str(tmp_path / "bad")).entries.collect()
    with pytest.raises(Exception, match="sorted"):
        m.entries.repartition(1).orderBy(F.desc("col")).write.format("triplets").mode("append").save(f"file://{tmp_path}/odd")


def test_measured_runs(spark, tmp_path):
    """Every part has a time, every state a span, and files have no gap but a step's dense part; what is measured doesn't change a result."""
    m = matrix(spark, dominant(30, 5))
    T.write_triplets(m, f"file://{tmp_path}/m.mtl")
    seen = set()
    for how in ("1", "0"):
        o = options.parse(["--matrix", f"file://{tmp_path}/m.mtl", "--trace", "--luby_algorithm", how, "--schur_density_tolerance", "0.5", "--output_dir", f"{tmp_path}/out{how}"])
        done = options.run(spark, o)
        assert done["facts"]["backward_error"] < 1e-12
        trace = next((tmp_path / f"out{how}" / "trace").iterdir()).read_text()
        seen |= {s for s in report.STATES if f'S "{s}"' in trace}
        raw = next((tmp_path / f"out{how}" / "data").glob("*_raw.dat")).read_text()
        assert "?" not in raw and "timing_solve_u" in raw and "timing_dense" in raw
        lines = next((tmp_path / f"out{how}" / "data").glob("*_time.dat")).read_text().splitlines()
        assert lines[-1].startswith("?\t?\t") and lines[-1].split("\t")[2] != "?"
    assert seen == set(report.STATES)
    swept = options.run(spark, options.parse(["--matrix", f"file://{tmp_path}/m.mtl", "--group_run", "marko_tol", "2", "2", "2"]))
    assert "?" not in swept["text"]
    plain, slow = factorize(m), factorize(m, measured=True)
    keys = ("pivots", "nnz_l", "nnz_u", "nnz_after", "row_singletons", "col_singletons", "luby")
    assert [[s[k] for k in keys] for s in plain.steps] == [[s[k] for k in keys] for s in slow.steps]
    assert all(s["ld_s"] is None for s in plain.steps) and all(s["candidates_s"] > 0 for s in slow.steps)


def test_concurrent_sweep(spark):
    """Runs side by side find what runs of their own find."""
    m = matrix(spark, dominant(25, 7))
    both = sweep.sweep(m, "marko_tol", 2.0, 2.0, 2).orderBy("run").collect()
    for r in both:
        f = factorize(m, SolverParams(marko_tol=r.param_value))
        assert (r.steps, r.sparse_pivots, r.nnz_l, r.reason) == (len(f.steps), f.done, f.l.count(), f.reason) and r.solved


def test_metrics_of_nothing(spark):
    t = materialize(spark.range(0).select(F.lit("RS").alias("kind"), "id"), metrics=pivots.KINDS)
    assert metrics_of(t) == dict.fromkeys(pivots.KINDS, 0)


def test_line_statistics_follow_each_step(spark):
    """Updated figures are those of the matrix, with a border too, though only touched lines are counted anew."""
    a = dominant(40, 3, 0.08)
    m = matrix(spark, a)
    border = spark.createDataFrame([(3,), (17,), (30,)], "col int")
    for edge in (None, border):
        f = factorize(m, SolverParams(density_tolerance=0.8), border=edge, checks=frozenset(["statistics"]))
        assert len(f.steps) > 1
        if edge is None:
            tail_blocks(f)
            b = A.spmv(m.entries, T.default_vector(spark, 40), 40)
            assert np.allclose([v for _, v in sorted(solve(f, b).collect())], np.arange(1, 41))


def test_dense_order_against_sparse(spark):
    """Solutions of the dense factorisation and of the sparse one of rows in its order agree."""
    a = dominant(18, 6)[::-1].copy()
    m = matrix(spark, a)
    b = A.spmv(m.entries, T.default_vector(spark, 18), 18)
    assert cross_check_permuted(m, b, SolverParams(dense_block=7, density_tolerance=0.6)) < 1e-9


def test_absent_cells_are_refused(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "row int, col int, val double")
    gone = spark.createDataFrame([(0, 0), (5, 5)], "row int, col int")
    assert L.without(e, gone).count() == 1 and L.without(e, gone.where("row = 0"), strict=True).count() == 1
    with pytest.raises(ValueError):
        L.without(e, gone, strict=True)


def test_merged_sets_of_many_blocks(spark):
    """Sets of one candidate each are merged into one set whose lines no other pivot crosses."""
    e = matrix(spark, dominant(60, 2, 0.04)).entries
    cands = materialize(pivots.block_candidates(e, 60, 0.1))
    found = materialize(pivots.merged_sets(e, pivots.block_sets(e, cands, 50.0, per_block=1), materialize))
    assert C.independence(e, found).first()[0] == 0 and C.touched_once(e, found).first()[0] == 0
    assert found.count() >= cands.count() / 4 and found.select("row").distinct().count() == found.count()
