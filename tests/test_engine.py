"""The sparse engine: queries against DuckDB, solves against numpy and known solutions, files, edge cases."""

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
from marlstone.operators import pivots as P
from marlstone.plans import bordered, options, report
from marlstone.plans import dense as BD
from marlstone.plans.dense import dense_lu
from marlstone.plans.factorize import CHECKS, cross_check, dense_solve, factorize, lower_levels, permutation, plain_lu, refine, solve, upper_levels
from marlstone.plans.sweep import values
from marlstone.sources import triplets as T
from marlstone.storage import materialize
from marlstone.streaming.products import running_spmv

D = "/root/testdata/sf0.001"
QUICK = ["matrix_entries", "csc_columns", "col_sizes", "vec_axpby", "vec_norm2", "vec_permute", "max_abs", "matrix_permute", "spmv", "spmv_rectangular", "matrix_norm_inf", "range_overlaps", "eligible_entries", "row_singletons", "col_singletons", "independent_pivots", "schur_step", "tp_candidates", "col_blocks", "block_sizes", "block_entries", "block_check", "check_same_pattern", "tp_independent_sets", "tp_best_cost", "touch_counts", "capped_candidates", "merged_by_cost", "check_logical_sum", "step_parts", "local_columns", "grown_partition"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("nation", "part", "supplier", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(map(str, ([None if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r] for r in df.select(cols).collect())))
    rel = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({Q.ORACLES[name]})")
    want = sorted(map(str, ([None if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r] for r in rel.fetchall())))
    assert got == want


def matrix(spark, dense):
    e = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)]
    return Matrix.of(spark.createDataFrame(e, "row int, col int, val double"), *dense.shape)


def dominant(n, seed):
    r = np.random.default_rng(seed)
    a = np.where(r.random((n, n)) < 0.12, r.integers(-5, 6, (n, n)), 0).astype(float)
    np.fill_diagonal(a, np.abs(a).sum(1) + 1)
    return a


@pytest.mark.parametrize("kind", ["dominant", "diagonal", "triangular"])
def test_solve(spark, kind):
    a = {"dominant": dominant(25, 3), "diagonal": np.diag(np.arange(1.0, 6)), "triangular": np.tril(np.ones((5, 5)))}[kind]
    m = matrix(spark, a)
    f = factorize(m, SolverParams(density_tolerance=0.6))
    b = A.spmv(m.entries, T.default_vector(spark, m.n), m.m)
    want = np.arange(1, m.n + 1)
    for growth in (4.0, 0.0) if kind == "dominant" else (4.0,):
        x = dict(solve(f, b, growth).collect())
        assert np.allclose([x[i] for i in range(m.n)], want)
    p = permutation(f)
    assert C.permutation(p, m.n, "row").first()[0] == 0 and C.permutation(p, m.n, "col").first()[0] == 0


def test_tie_keeps_the_smaller_column(spark):
    a = np.array([[2.0, 2, 0, 1], [2, 2, 1, 0], [0, 1, 3, 1], [1, 0, 1, 3]])
    e = matrix(spark, a).entries
    c = spark.createDataFrame([(0, 0, 4, 1.0), (1, 1, 4, 1.0)], "col int, row int, cost long, score double")
    assert [r.loser for r in P.conflicts(e, c).collect()] == [1]


@pytest.mark.parametrize("a", [[[1.0, 0, 0], [1, 0, 0], [0, 1, 1]], [[1.0, 0], [1, 0]], [[0.0, 0], [1, 0]]])
def test_singular_is_refused(spark, a):
    """Equal lines and columns without entries, in one task and over blocks."""
    m = matrix(spark, np.array(a))
    for most in (100, 1):
        f = factorize(m, SolverParams(max_dense_schur=most, dense_block=2))
        with pytest.raises(Exception, match="the matrix is singular"):
            solve(f, T.default_vector(spark, m.m)).collect()


def test_more_rows_than_columns(spark):
    """Extra rows that agree are fine, others are refused."""
    a = np.vstack([dominant(8, 2), np.ones((2, 8))])
    m = matrix(spark, a)
    right = a @ np.arange(1.0, 9)
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(right)], "i int, x double")
    for most in (100, 1):
        f = factorize(m, SolverParams(density_tolerance=0.6, max_dense_schur=most, dense_block=3))
        assert np.allclose([v for _, v in sorted(solve(f, b).collect())], np.arange(1.0, 9))
        with pytest.raises(Exception, match="contradict"):
            solve(f, b.select("i", F.when(F.col("i") == 9, 0.0).otherwise(F.col("x")).alias("x"))).collect()


@pytest.mark.parametrize(("m", "n", "size"), [(60, 60, 12), (41, 30, 11), (5, 5, 8)])
def test_dense_blocks(spark, m, n, size):
    """Blocked factors solve as one array's do, whatever rows the tournament takes; P A = L U; multipliers stay small."""
    a = np.random.default_rng(m).normal(size=(m, n))
    a[:n] = a[:n][::-1]
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(m) for j in range(n)], "i int, j int, val double")
    f = BD.factorize_blocks(BD.blocked(e, m, n, size), m, n, size)
    want = np.arange(1.0, n + 1)
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a @ want)], "i int, x double")
    assert np.allclose([x for _, x in sorted(BD.solve_blocks(f, b).collect())], want)
    low, up, order = np.zeros((m, n)), np.zeros((n, n)), []
    for p in f.pivots.orderBy("k").collect():
        lo, w = p.k * size, f.width(p.k)
        own = BD._array(p.data, w)
        order += p.ids
        low[p.ids, lo : lo + w], up[lo : lo + w, lo : lo + w] = np.tril(own, -1) + np.eye(w), np.triu(own)
        for r in f.lower[p.k].collect():
            low[BD._ids(r.ids), lo : lo + w] = BD._array(r.data, w)
        for r in f.upper[p.k].collect() if p.k < len(f.upper) else []:
            wide = f.width(r.bj)
            up[lo : lo + w, r.bj * size : r.bj * size + wide] = BD._array(r.data, wide)
    assert np.allclose(low @ up, a) and len(set(order)) == n and np.abs(low).max() < 20


def test_levels_are_joined(spark):
    """Joined levels are as few as their growth allows and give the same as one after the other."""
    a = dominant(24, 9)
    m = matrix(spark, a)
    f = factorize(m, SolverParams(density_tolerance=0.9))
    for of in (lower_levels, upper_levels):
        one, all_ = of(f, 0.0), of(f, 100.0)
        assert all_.k == 1 and all_.before == one.before and one.k > 1
        v = T.default_vector(spark, 24)
        assert np.allclose(*([x for _, x in sorted(q.apply(v).collect())] for q in (one, all_)))


def test_vectors_of_different_sizes_are_refused(spark):
    with pytest.raises(Exception, match="different sizes"):
        A.axpby(T.default_vector(spark, 3), 1.0, T.default_vector(spark, 4), 1.0).collect()


def test_blocks_and_checks(spark):
    """The older search solves too; each step's checks pass; bordered blocks and refinement agree."""
    a = dominant(14, 7)
    m = matrix(spark, a)
    m = Matrix(materialize(m.entries), 14, 14)
    b = materialize(A.spmv(m.entries, T.default_vector(spark, 14), 14))
    f = factorize(m, SolverParams(density_tolerance=0.7, pivot_strategy="blocks"), checks=frozenset(CHECKS))
    assert np.allclose([v for _, v in sorted(solve(f, b).collect())], np.arange(1, 15)) and cross_check(m, f) < 1e-9
    g = factorize(m, SolverParams(density_tolerance=0.7), checks=frozenset([*CHECKS, "statistics"]))
    assert g.done and cross_check(m, g) < 1e-9
    rough = solve(g, b).select("i", (F.col("x") + F.col("i") * 1e-4).alias("x"))
    assert np.allclose([v for _, v in sorted(refine(m, g, b, rough).collect())], np.arange(1, 15), atol=1e-10)
    rows = B.grown(m.entries, 14, 2, rounds=1)
    assert rows.count() == 14
    x = bordered.solve(m, b, rows, SolverParams(density_tolerance=0.9))
    assert np.allclose([v for _, v in sorted(x.collect())], np.arange(1, 15))


def test_options_and_files(spark, tmp_path):
    m = matrix(spark, dominant(12, 4))
    T.write_triplets(m, f"file://{tmp_path}/m.mtl")
    o = options.parse(["--matrix", f"file://{tmp_path}/m.mtl", "--value_tol", "0.2", "--check_pivots", "--check_counters", "--trace", "--output_dir", f"{tmp_path}/out", "--output_file", f"{tmp_path}/log", "--check_dense_with_perm"])
    done = options.run(spark, o)
    assert done["facts"]["backward_error"] < 1e-12 and done["facts"]["forward_error"] < 1e-10 and done["facts"]["cross_check"] < 1e-9
    data = sorted(p.name for p in (tmp_path / "out" / "data").iterdir())
    assert len(data) == 3 and (tmp_path / "log").read_text() == done["text"]
    raw = next((tmp_path / "out" / "data").glob("*_raw.dat")).read_text().splitlines()
    assert any(line.startswith("#nnz_final\t") for line in raw) and len(raw[-1].split("\t")) == 8
    trace = next((tmp_path / "out" / "trace").iterdir()).read_text()
    assert trace.startswith("%EventDef") and " idle" in trace
    swept = options.run(spark, options.parse(["--matrix", f"file://{tmp_path}/m.mtl", "--group_run", "marko_tol", "2", "2", "2", "--output_dir", f"{tmp_path}/out"]))
    lines = [line for line in swept["text"].splitlines() if not line.startswith("#")]
    assert len(lines) == 3 and all(len(line.split("\t")) == 25 for line in lines) and len(report.SWEEP_COLUMNS) == 24
    for bad in (["--odd"], ["--value_tol", "2"], ["--matrix"], ["word"], ["--group_run", "odd", "1", "1", "1"]):
        with pytest.raises(ValueError):
            options.parse(bad)
    with pytest.warns(UserWarning):
        options.parse(["--nb_threads", "4"])


def test_random_dense(spark):
    e = L.random_dense(spark, 6, 5, 1)
    rows = {(r.row, r.col): r.val for r in e.collect()}
    assert len(rows) == 30 and rows == {(r.row, r.col): r.val for r in L.random_dense(spark, 6, 5, 1).collect()} and 0 <= min(rows.values())


def test_dense_lu():
    a = dominant(12, 5)[:, ::-1]
    lu, order, singular = dense_lu(a)
    assert not singular and np.allclose(dense_solve(lu, order, a @ np.arange(12.0)), np.arange(12.0))
    big = np.random.default_rng(1).random((150, 130))
    lu, order, _ = dense_lu(big)
    assert np.allclose((np.tril(lu, -1)[:, :130] + np.eye(150, 130)) @ np.triu(lu[:130]), big[order])
    small = dominant(20, 1)
    flat = plain_lu(small)
    assert np.allclose((np.tril(flat, -1) + np.eye(20)) @ np.triu(flat), small)


def test_files(spark, tmp_path):
    m = matrix(spark, dominant(9, 1))
    out = f"file://{tmp_path}/m.mtl"
    T.write_triplets(m, out)
    back = T.read_matrix(spark, out)
    assert (back.n, C.same_pattern(m.entries, back.entries).first()[0]) == (9, 0)
    assert sorted(map(tuple, m.entries.collect())) == sorted(map(tuple, back.entries.collect()))
    for bad in ("3 3\n1 1 1.0\n3 3 1.0\n3 2 1.0\n", "2 3\n1 1 1.0\n2 2 1.0\n"):
        (tmp_path / "bad.mtl").write_text(bad)
        with pytest.raises(ValueError):
            T.read_triplets(spark, f"file://{tmp_path}/bad.mtl")
    (tmp_path / "v.mtl").write_text("1 0 5.5\n2 0 6.5\n")
    assert [r.x for r in T.read_vector(spark, 2, f"file://{tmp_path}/v.mtl").orderBy("i").collect()] == [5.5, 6.5]
    (tmp_path / "r.rb").write_text("title".ljust(72) + "key\n" + f"{3:14d}{1:14d}{1:14d}{1:14d}\n" + "rua".ljust(14) + f"{2:14d}{2:14d}{3:14d}{0:14d}\n" + "(3I4)".ljust(16) + "(3I4)".ljust(16) + "(3E10.2)".ljust(20) + "\n" + "   1   3   4\n   1   2   2\n" + f"{1.0:10.2f}{2.0:10.2f}{3.0:10.2f}\n")
    assert sorted(map(tuple, T.read_matrix(spark, f"file://{tmp_path}/r.rb").entries.collect())) == [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0)]


def test_parameters_and_reports(spark):
    with pytest.raises(ValueError):
        SolverParams(value_tol=2)
    with pytest.raises(ValueError):
        Matrix.of(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "row int, col int, val double"), 1, 1)
    assert values("value_tol", 0.1, 0.5, 2) == [0.1, 0.05] and values("marko_tol", 2, 2, 2) == [2, 4]
    assert report.prefix("a/watt.mtl", SolverParams(), 4, "marko_tol") == "watt_0.1ValTol_MULTIMarkoTol_4threads_10candidates_0.2densityTol_5minPivots"
    t = report.Trace()
    with t.span("a"), pytest.raises(RuntimeError), t.span("b"):
        pass
    assert t.frame(spark).count() == 1 and t.text().count("\n8 ") == 2
    x = T.default_vector(spark, 2)
    e = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0)], "row int, col int, val double")
    assert running_spmv(e, x).collect()[0].y == 8.0


def test_whole_matrix_is_made_dense(spark):
    """All cells of F4, by the query's own SQL and by count."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{D}/events.parquet')")
    want = sorted(con.execute(Q.ORACLES["sparse_to_dense"]).fetchall())
    got = sorted(tuple(r) for r in Q.QUERIES["sparse_to_dense"](spark, D).collect())
    users, types, rows = con.execute("SELECT max(user_id) + 1, count(DISTINCT event_type), count(*) FROM events").fetchone()
    assert got == want and len(got) == users * types and sum(v for *_, v in got) == rows
