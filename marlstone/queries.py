"""Queries over the fixture matrices, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixtures as X
from .model import Matrix, SolverParams
from .operators import algebra as A
from .operators import blocks as B
from .operators import checks as C
from .operators import layout as L
from .operators import multilevel
from .operators import pivots as P
from .operators import update as U
from .plans import bordered, report, sweep
from .plans.factorize import factorize, reconstruction, refine, solve
from .plans.factorize import permutation as full_permutation
from .sources import triplet_source
from .sources.triplets import default_vector, write_triplets
from .storage import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOL, MARKO = SolverParams.value_tol, SolverParams.marko_tol

_N = "(SELECT count(*) FROM part)"
_OFF = f"SELECT CAST((l_orderkey*7) % {_N} AS INT) AS row, CAST(l_partkey % {_N} AS INT) AS col, l_quantity AS val FROM lineitem WHERE l_quantity <= 2"
_BS = f"({_N} // 4)"
_OFF2 = f"SELECT CAST((l_orderkey*7) % {_N} AS INT) AS row, CAST(CASE WHEN l_quantity = 1 AND l_linenumber = 1 THEN l_partkey % {_N} ELSE ((l_orderkey*7 % {_N}) // {_BS}) * {_BS} + l_partkey % {_BS} END AS INT) AS col, l_quantity AS val FROM lineitem WHERE l_quantity <= 2"


def _dominant(off: str) -> str:
    return f"""od AS (SELECT row, col, sum(val) AS val FROM ({off}) WHERE row <> col GROUP BY 1, 2),
dg AS (SELECT row, row AS col, sum(val) + 1 AS val FROM (SELECT row, val FROM od UNION ALL SELECT CAST(i AS INT), 0 FROM range({_N}) t(i)) GROUP BY row),
e AS (SELECT * FROM od UNION ALL SELECT * FROM dg)"""


_E = _dominant(_OFF)
_VEC = f"v AS (SELECT CAST(i AS INT) AS i, CAST(i + 1 AS DOUBLE) AS x FROM range({_N}) t(i))"
_STATS = f"""cs AS (SELECT col, count(*) AS col_deg, max(abs(val)) AS col_max FROM e GROUP BY col),
rd AS (SELECT row, count(*) AS row_deg FROM e GROUP BY row),
rs AS (SELECT min(row) AS row, col FROM (SELECT row, min(col) AS col FROM e GROUP BY row HAVING count(*) = 1) GROUP BY col),
cg AS (SELECT row, min(col) AS col FROM (SELECT col, min(row) AS row FROM e GROUP BY col HAVING count(*) = 1) WHERE row NOT IN (SELECT row FROM rs) AND col NOT IN (SELECT col FROM rs) GROUP BY row),
taken AS (SELECT * FROM rs UNION ALL SELECT row, col FROM cg),
sh AS (SELECT * FROM cs WHERE col_deg <= (SELECT count(*) FROM e) // {_N}),
el AS (SELECT e.*, col_deg, col_max, row_deg FROM e JOIN sh USING (col) JOIN rd USING (row) WHERE abs(val) >= col_max * {TOL} AND row NOT IN (SELECT row FROM taken) AND col NOT IN (SELECT col FROM taken)),
br AS (SELECT *, (row_deg - 1) * (col_deg - 1) AS cost FROM el QUALIFY row_number() OVER (PARTITION BY col ORDER BY row_deg, row) = 1),
al AS (SELECT CASE WHEN min(cost) = 0 THEN 1 ELSE min(cost) END AS best, CAST(floor(CASE WHEN min(cost) = 0 THEN 1 ELSE min(cost) END * {MARKO}) AS BIGINT) AS allowed FROM br),
ca AS (SELECT col, row, cost, cost / allowed + val / col_max AS score FROM br, al WHERE cost <= allowed),
cf AS (SELECT DISTINCT CASE WHEN p.score < q.score THEN p.col WHEN p.score > q.score THEN q.col ELSE greatest(p.col, q.col) END AS loser FROM ca p JOIN e ON e.row = p.row AND e.col <> p.col JOIN ca q ON q.col = e.col),
ind AS (SELECT * FROM ca WHERE col NOT IN (SELECT loser FROM cf)),
pv AS (SELECT CAST(row_number() OVER (ORDER BY rank, col) - 1 AS INT) AS pos, row, col, 0 AS step, kind FROM (SELECT 0 AS rank, 'RS' AS kind, row, col FROM rs UNION ALL SELECT 1, 'CS', row, col FROM cg UNION ALL SELECT 2, 'LUBY', row, col FROM ind)),
d AS (SELECT pos AS "pivot", e.row, e.col, val FROM e JOIN pv ON e.row = pv.row AND e.col = pv.col),
ea AS (SELECT e.*, r.pos AS rp, c.pos AS cp FROM e LEFT JOIN pv r ON e.row = r.row LEFT JOIN pv c ON e.col = c.col),
l AS (SELECT cp AS "pivot", ea.row, ea.val / d.val AS val FROM ea JOIN d ON cp = d."pivot" WHERE rp IS NULL OR rp > cp),
u AS (SELECT row, col, val, rp AS "pivot" FROM ea WHERE rp IS NOT NULL AND (cp IS NULL OR rp < cp)),
s AS (SELECT row, col, sum(val) AS val FROM (SELECT row, col, val FROM ea WHERE rp IS NULL AND cp IS NULL
  UNION ALL SELECT l.row, u.col, -u.val * l.val FROM u JOIN l ON u."pivot" = l."pivot" WHERE l.row NOT IN (SELECT row FROM pv) AND u.col NOT IN (SELECT col FROM pv)) GROUP BY 1, 2)"""


def _query(name: str, select: str | None = None, *ctes: str):
    def put(f):
        QUERIES[name] = f
        if select:
            ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + select
        return f

    return put


def _round(c: str, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def _first_step(spark: SparkSession, d: str):
    a = X.parts_square(spark, d)
    e = materialize(a.entries)
    return a, e, materialize(P.search(e, a.n, 0, 0, TOL, MARKO, keep=materialize))


@_query("matrix_entries", "SELECT * FROM e", _E)
def _(s, d):
    return X.parts_square(s, d).entries


for _by, _o in (("col", "row"), ("row", "col")):
    _query("csc_columns" if _by == "col" else "csr_rows", f"SELECT {_by} AS id, count(*) AS nnz, min({_o}) AS first, max({_o}) AS last FROM e GROUP BY {_by}", _E)(lambda s, d, by=_by: L.line_extent(X.parts_square(s, d).entries, by))
    _query(f"{_by}_sizes", f"SELECT CAST(i AS INT) AS id, count({_by}) AS nnz FROM range({_N}) t(i) LEFT JOIN (SELECT * FROM e WHERE val > 1) f ON f.{_by} = i GROUP BY i", _E)(lambda s, d, by=_by: L.sizes((m := X.parts_square(s, d)).entries.where("val > 1"), by, m.n))


_PRICES = "v AS (SELECT p_partkey::INT AS i, p_retailprice AS x FROM part)"


@_query("vec_axpby", "SELECT i, x * 2.0::DOUBLE + x * x * (-0.5::DOUBLE) AS x FROM v", _PRICES)
def _(s, d):
    v = X.part_prices(s, d)
    return A.axpby(v, 2.0, v.select("i", (F.col("x") * F.col("x")).alias("x")), -0.5)


@_query("vec_norm2", "SELECT round(sqrt(sum(x * x)), 4) AS norm2 FROM v", _PRICES)
def _(s, d):
    return A.norm2(X.part_prices(s, d)).select(_round("norm2", 4))


@_query("vec_permute", f"SELECT CAST({_N} - 1 - i AS INT) AS i, x FROM v", _PRICES)
def _(s, d):
    n = X.table(s, d, "part").count()
    perm = s.range(n).select(F.col("id").cast("int").alias("pos"), (F.lit(n - 1) - F.col("id")).cast("int").alias("idx"))
    return A.permute_vector(X.part_prices(s, d), perm)


@_query("matrix_permute", f"SELECT CAST({_N} - 1 - row AS INT) AS row, CAST((col + 1) % {_N} AS INT) AS col, val FROM e", _E)
def _(s, d):
    m = X.parts_square(s, d)
    ids = s.range(m.n).select(F.col("id").cast("int").alias("idx"))
    return L.permute(m.entries, ids.select((F.lit(m.n - 1) - F.col("idx")).alias("pos"), "idx"), ids.select(((F.col("idx") + 1) % m.n).alias("pos"), "idx"))


@_query("random_permutation_check", "SELECT count(*) AS n, sum(p_partkey)::BIGINT AS ids, (count(*) * (count(*) - 1) // 2)::BIGINT AS places, 0::BIGINT AS violations, true AS mixed FROM part")
def _(s, d):
    """Of a random order of the parts: their number, the sums of keys and of places, what isn't a permutation, and whether hardly any part kept its place."""
    ids = X.table(s, d, "part").select(F.col("p_partkey").cast("int").alias("idx"))
    p = materialize(L.random_permutation(ids, 7))
    sums = p.agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("ids"), F.sum("pos").alias("places"), (F.count_if(F.col("pos") == F.col("idx")) < 10 + F.count(F.lit(1)) / 20).alias("mixed"))
    return sums.crossJoin(C.permutation(p, ids.count()))  # one row each


_EVENTS = "ev AS (SELECT * FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"
_TYPES = "ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS col FROM (SELECT DISTINCT event_type FROM ev))"
_USER_EVENT = "f AS (SELECT user_id AS row, col, CAST(count(*) AS DOUBLE) AS val FROM ev JOIN ty USING (event_type) GROUP BY 1, 2)"


@_query("sparse_to_dense", "SELECT CAST(r.i AS INT) AS row, CAST(c.j AS INT) AS col, coalesce(val, 0) AS val FROM range((SELECT max(user_id) + 1 FROM ev)) r(i) CROSS JOIN range((SELECT count(*) FROM ty)) c(j) LEFT JOIN f ON f.row = r.i AND f.col = c.j", _EVENTS, _TYPES, _USER_EVENT)
def _(s, d):
    m = X.user_event(s, d)
    return L.to_dense(m.entries, m.m, m.n)


@_query("spmv", f"SELECT CAST(t.i AS INT) AS i, coalesce(sum(val * x), 0) AS x FROM range({_N}) t(i) LEFT JOIN e ON e.row = t.i LEFT JOIN v ON e.col = v.i GROUP BY t.i", _E, _VEC)
def _(s, d):
    m = X.parts_square(s, d)
    return A.spmv(m.entries, default_vector(s, m.n), m.m)


@_query("spmv_rectangular", "SELECT l_partkey::INT AS i, sum(q * (l_suppkey + 1)) AS x FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1 UNION ALL SELECT p_partkey::INT, 0 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def _(s, d):
    m = X.part_supplier(s, d)
    return A.spmv(m.entries, default_vector(s, m.n), m.m)


@_query("matrix_norm_inf", "SELECT max(t) AS norm_inf FROM (SELECT sum(abs(val)) AS t FROM e GROUP BY row)", _E)
def _(s, d):
    return A.norm_inf(X.parts_square(s, d).entries)


@_query("density", f"SELECT count(*) AS nnz, round(count(*) / ({_N} * {_N}::DOUBLE), 9) AS density FROM e", _E)
def _(s, d):
    m = X.parts_square(s, d)
    return A.density(m.entries, m.m, m.n).select("nnz", _round("density", 9))


@_query("max_abs", "SELECT max(abs(x)) AS max_abs FROM v", _PRICES)
def _(s, d):
    return A.max_abs(X.part_prices(s, d))


@_query("matrix_add", "SELECT row, col, sum(val) AS val FROM (SELECT * FROM e UNION ALL SELECT col AS row, row AS col, val FROM e) GROUP BY 1, 2", _E)
def _(s, d):
    e = X.parts_square(s, d).entries
    return L.added(e, e.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"))


@_query("delete_entries", "SELECT * FROM e WHERE val > 1", _E)
def _(s, d):
    e = X.parts_square(s, d).entries
    return L.without(e, e.where("val <= 1"))


@_query("range_overlaps", "SELECT a.n_nationkey AS a_id, b.n_nationkey AS b_id, CASE WHEN a.lo <= b.lo AND a.hi >= b.hi THEN 'total' WHEN a.lo >= b.lo AND a.hi <= b.hi THEN 'inner' WHEN a.lo < b.lo THEN 'end' ELSE 'begin' END AS kind FROM (SELECT n_nationkey, n_nationkey AS lo, n_nationkey + 3 AS hi FROM nation) a JOIN (SELECT n_nationkey, n_nationkey * 2 AS lo, n_nationkey * 2 + 1 + n_nationkey % 5 AS hi FROM nation) b ON a.lo < b.hi AND b.lo < a.hi")
def _(s, d):
    n = X.table(s, d, "nation").select(F.col("n_nationkey").alias("id"))
    return L.ranges_overlap(n.select("id", F.col("id").alias("lo"), (F.col("id") + 3).alias("hi")), n.select("id", (F.col("id") * 2).alias("lo"), (F.col("id") * 2 + 1 + F.col("id") % 5).alias("hi")))


_SPANS = """sp AS (SELECT l_orderkey AS id, min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS lo, max(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) + 1 AS hi FROM lineitem GROUP BY 1),
mo AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS id, min(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) AS lo, max(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)) + 1 AS hi FROM orders GROUP BY 1)"""


@_query("ship_span_overlaps", "SELECT mo.id AS \"month\", CASE WHEN sp.lo <= mo.lo AND sp.hi >= mo.hi THEN 'total' WHEN sp.lo >= mo.lo AND sp.hi <= mo.hi THEN 'inner' WHEN sp.lo < mo.lo THEN 'end' ELSE 'begin' END AS kind, count(*) AS n, sum(sp.id)::BIGINT AS ids FROM sp JOIN mo ON sp.lo < mo.hi AND mo.lo < sp.hi GROUP BY 1, 2", _SPANS)
def _(s, d):
    """How the orders' spans of ship dates meet the months' spans of order dates, counted by month."""
    day = lambda c: F.unix_date(F.to_date(c))
    span = lambda df, key, at: df.groupBy(key.alias("id")).agg(F.min(day(at)).alias("lo"), (F.max(day(at)) + 1).alias("hi"))
    ships = span(X.table(s, d, "lineitem"), F.col("l_orderkey"), "l_shipdate")
    months = span(X.table(s, d, "orders"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long"), "o_orderdate")
    # Orders of one span meet the same months, and there are at most as many spans as pairs of days.
    spans = ships.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    met = L.ranges_overlap(spans.select(F.struct("lo", "n", "ids").alias("id"), "lo", "hi"), months)
    return met.groupBy(F.col("b_id").alias("month"), "kind").agg(F.sum("a_id.n").alias("n"), F.sum("a_id.ids").alias("ids"))


@_query("triplet_round_trip", "SELECT * FROM e", _E)
def _(s, d):
    """The matrix written as triplet parts by many tasks and read back by ranges of bytes."""
    m, path = X.parts_square(s, d), shared_dir(s)
    triplet_source.write(m, path)
    return triplet_source.read(s, path, split_bytes=100_000).entries


@_query("triplet_columns", f"SELECT e.col, count(*) AS n, sum(val) AS total FROM e WHERE col >= {_N} // 3 AND col < {_N} // 2 GROUP BY col", _E)
def _(s, d):
    """Columns in a range from a file of one task; only byte ranges that can hold them are read."""
    m, path = X.parts_square(s, d), shared_dir(s)
    write_triplets(m, path)
    triplet_source.register(s)
    file = next(x for x in s.read.format("binaryFile").load(path).select("path").collect())[0]
    e = s.read.format("triplets").option("split_bytes", 50_000).schema("col int, val double").load(file.removeprefix("file:"))
    return e.where((F.col("col") >= m.n // 3) & (F.col("col") < m.n // 2)).groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))


@_query("refined_solution", f"SELECT CAST(i AS INT) AS i, i + 1.0::DOUBLE AS x FROM range({_N}) t(i)")
def _(s, d):
    """A solution that is off by a thousandth, refined."""
    m, f = _factors(s, d)
    b = materialize(A.spmv(m.entries, default_vector(s, m.n), m.m))
    rough = default_vector(s, m.n).select("i", (F.col("x") * 1.001).alias("x"))
    return refine(m, f, b, rough).select("i", _round("x"))


@_query("first_step_counts", "SELECT (SELECT count(*) FROM e) AS nnz_before, (SELECT count(*) FROM pv WHERE kind = 'RS') AS row_singletons, (SELECT count(*) FROM pv WHERE kind = 'CS') AS col_singletons, (SELECT count(*) FROM pv WHERE kind = 'LUBY') AS luby, (SELECT count(*) FROM pv) AS pivots, (SELECT count(*) FROM l) AS nnz_l, (SELECT count(*) FROM u) AS nnz_u, (SELECT count(*) FROM s) AS nnz_after", _E, _STATS)
def _(s, d):
    """What is observed of a run's first step while its tables are written."""
    names = ("nnz_before", "row_singletons", "col_singletons", "luby", "pivots", "nnz_l", "nnz_u", "nnz_after")
    steps = factorize(X.parts_square(s, d), most_steps=1).steps
    return s.createDataFrame([tuple(steps[0][k] for k in names)], ", ".join(f"{k} long" for k in names))


@_query("col_max", "SELECT * FROM cs", _E, _STATS)
def _(s, d):
    return P.col_stats(X.parts_square(s, d).entries)


@_query("eligible_entries", f"SELECT row, col, val, col_max, col_deg FROM e JOIN cs USING (col) WHERE abs(val) >= col_max * {TOL}", _E, _STATS)
def _(s, d):
    return P.eligible(X.parts_square(s, d).entries, TOL)


@_query("row_singletons", "SELECT row, col FROM rs", _E, _STATS)
def _(s, d):
    return P.row_singletons(X.parts_square(s, d).entries)


@_query("col_singletons", "SELECT row, col FROM cg", _E, _STATS)
def _(s, d):
    e = X.parts_square(s, d).entries
    return P.col_singletons(e, P.row_singletons(e))


@_query("short_columns", "SELECT * FROM sh", _E, _STATS)
def _(s, d):
    m = X.parts_square(s, d)
    return P.short_columns(m.entries, m.n)


def _best(s, d):
    m = X.parts_square(s, d)
    e = materialize(m.entries)
    rs = P.row_singletons(e)
    return e, materialize(P.best_rows(e, materialize(rs.union(P.col_singletons(e, rs))), m.n, TOL))


@_query("best_row_per_col", "SELECT col, row, val, col_deg, col_max, row_deg, cost FROM br", _E, _STATS)
def _(s, d):
    return _best(s, d)[1]


@_query("best_markowitz", "SELECT best, allowed FROM al", _E, _STATS)
def _(s, d):
    return P.allowed_cost(_best(s, d)[1], MARKO)


@_query("pivot_candidates", "SELECT col, row, cost, round(score, 6) AS score FROM ca", _E, _STATS)
def _(s, d):
    return P.candidates(_best(s, d)[1], MARKO).select("col", "row", "cost", _round("score"))


@_query("pivot_conflicts", "SELECT loser FROM cf", _E, _STATS)
def _(s, d):
    e, b = _best(s, d)
    return P.conflicts(e, P.candidates(b, MARKO))


@_query("independent_pivots", "SELECT col, row, cost, round(score, 6) AS score FROM ind", _E, _STATS)
def _(s, d):
    e, b = _best(s, d)
    return P.independent(e, P.candidates(b, MARKO)).select("col", "row", "cost", _round("score"))


@_query("pivot_order", "SELECT * FROM pv", _E, _STATS)
def _(s, d):
    return _first_step(s, d)[2]


@_query("touched_cols", "SELECT DISTINCT col FROM e WHERE row IN (SELECT row FROM pv) AND col NOT IN (SELECT col FROM pv)", _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return P.touched(e, p, "row")


@_query("touched_rows", "SELECT DISTINCT row FROM e WHERE col IN (SELECT col FROM pv) AND row NOT IN (SELECT row FROM pv)", _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return P.touched(e, p, "col")


@_query("d_pivots", "SELECT * FROM d", _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return U.diagonal(e, p)


@_query("l_columns", 'SELECT "pivot", row, round(val, 6) + 0.0 AS val FROM l', _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return U.lower(e, p).select("pivot", "row", _round("val"))


@_query("u_rows", "SELECT * FROM u", _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return U.upper(e, p)


@_query("schur_step", "SELECT row, col, round(val, 6) + 0.0 AS val FROM s", _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return U.schur(e, p, U.lower(e, p), U.upper(e, p)).select("row", "col", _round("val"))


@_query("tp_candidates", f"SELECT col, row, cost FROM (SELECT e.col, e.row, (row_deg - 1) * (col_deg - 1) AS cost FROM e JOIN cs USING (col) JOIN rd USING (row) WHERE abs(val) >= col_max * {TOL} AND col_deg <= 2 * ((SELECT count(*) FROM e) // {_N})) QUALIFY row_number() OVER (PARTITION BY col ORDER BY cost, row) = 1", _E, _STATS)
def _(s, d):
    m = X.parts_square(s, d)
    return P.block_candidates(m.entries, m.n, TOL)


def _block_sets(s, d):
    m = X.parts_square(s, d)
    e = materialize(m.entries)
    cands = materialize(P.block_candidates(e, m.n, TOL))
    return e, cands, P.merged_sets(e, P.block_sets(e, cands, MARKO), keep=materialize)


@_query("tp_independent_sets", "SELECT CAST(0 AS BIGINT) AS violations, CAST(0 AS BIGINT) AS double_touches, CAST(0 AS BIGINT) AS strangers, true AS large")
def _(s, d):
    """Of the merged set: entries off the diagonal, lines touched twice, cells that are no candidates, and whether at least a third of the candidates are in."""
    e, cands, found = _block_sets(s, d)
    found = materialize(found)
    strangers = found.join(cands, ["row", "col"], "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    large = cands.agg(F.count(F.lit(1)).alias("all")).crossJoin(found.agg(F.count(F.lit(1)).alias("n"))).select((F.col("n") * 3 >= F.col("all")).alias("large"))  # one row each
    return C.independence(e, found).crossJoin(C.touched_once(e, found).withColumnRenamed("violations", "double_touches")).crossJoin(strangers).crossJoin(large)


@_query("tp_best_cost", f"SELECT CASE WHEN min(cost) = 0 THEN 1 ELSE min(cost) END AS best, CAST(floor(CASE WHEN min(cost) = 0 THEN 1 ELSE min(cost) END * {MARKO}) AS BIGINT) AS allowed FROM (SELECT (row_deg - 1) * (col_deg - 1) AS cost FROM e JOIN cs USING (col) JOIN rd USING (row) WHERE abs(val) >= col_max * {TOL} AND col_deg <= 2 * ((SELECT count(*) FROM e) // {_N}))", _E, _STATS)
def _(s, d):
    m = X.parts_square(s, d)
    return P.allowed_cost(P.block_candidates(m.entries, m.n, TOL), MARKO)


@_query("touch_counts", "SELECT e.col, count(*) AS touches FROM e JOIN pv ON e.row = pv.row WHERE e.col NOT IN (SELECT col FROM pv) GROUP BY e.col", _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return P.structures(e, p, "row")


@_query("capped_candidates", "SELECT col, row, cost FROM ca ORDER BY col LIMIT (SELECT count(*) // 2 FROM ca)", _E, _STATS)
def _(s, d):
    cands = materialize(P.candidates(_best(s, d)[1], MARKO))
    return P.capped(cands, cands.count() // 2).select("col", "row", "cost")


@_query("merged_by_cost", "SELECT row, col, cost, CAST(row_number() OVER (ORDER BY cost, col, row) - 1 AS INT) AS place FROM ca", _E, _STATS)
def _(s, d):
    """Both halves of the candidates as one, and each one's place in the order that the merge came out in."""
    cands = materialize(P.candidates(_best(s, d)[1], MARKO))
    merged = materialize(P.by_cost(cands.where("col % 2 = 0"), cands.where("col % 2 = 1")).withColumn("at", F.monotonically_increasing_id()))
    places = L.numbered(merged, "at")
    return merged.join(places, F.col("at") == F.col("idx")).select("row", "col", "cost", F.col("pos").alias("place"))


@_query("check_logical_sum", "SELECT CAST(0 AS BIGINT) AS violations")
def _(s, d):
    _, e, p = _first_step(s, d)
    return C.logical_sum(e, p, materialize(U.step(e, p)))


@_query("step_parts", 'SELECT \'L\' AS part, count(*) AS n, round(sum(val), 4) + 0.0 AS total FROM l UNION ALL SELECT \'D\', count(*), round(sum(val), 4) + 0.0 FROM d UNION ALL SELECT \'U\', count(*), round(sum(val), 4) + 0.0 FROM u UNION ALL SELECT \'S\', count(*), round(sum(val), 4) + 0.0 FROM s', _E, _STATS)
def _(s, d):
    _, e, p = _first_step(s, d)
    return U.step(e, p).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("total")).select("part", "n", _round("total", 4))


@_query("solve_blocks_strategy", f"SELECT CAST(i AS INT) AS i, i + 1.0::DOUBLE AS x FROM range({_N}) t(i)")
def _(s, d):
    m = X.parts_square(s, d)
    f = factorize(m, SolverParams(pivot_strategy="blocks"))
    return solve(f, A.spmv(m.entries, default_vector(s, m.n), m.m)).select("i", _round("x"))


def _factors(s, d):
    m = X.parts_square(s, d)
    m = Matrix(materialize(m.entries), m.m, m.n)  # read again by what follows
    return m, factorize(m)


@_query("factor_step_stats")
def _(s, d):
    return sweep.step_stats(s, _factors(s, d)[1])


@_query("lu_reconstruction_error", "SELECT true AS small")
def _(s, d):
    m, f = _factors(s, d)
    diff = reconstruction(f).union(m.entries.select("row", "col", (-F.col("val")).alias("val"))).groupBy("row", "col").agg(F.abs(F.sum("val")).alias("x"))
    return diff.agg((F.coalesce(F.max("x"), F.lit(0.0)) < 1e-8).alias("small"))


@_query("solve_solution", f"SELECT CAST(i AS INT) AS i, i + 1.0::DOUBLE AS x FROM range({_N}) t(i)")
def _(s, d):
    m, f = _factors(s, d)
    return solve(f, A.spmv(m.entries, default_vector(s, m.n), m.m)).select("i", _round("x"))


@_query("solve_by_levels", f"SELECT CAST(i AS INT) AS i, i + 1.0::DOUBLE AS x FROM range({_N}) t(i)")
def _(s, d):
    m, f = _factors(s, d)
    return solve(f, A.spmv(m.entries, default_vector(s, m.n), m.m), growth=0.5).select("i", _round("x"))


@_query("dense_tail_solution", f"SELECT CAST(i AS INT) AS i, i + 1.0::DOUBLE AS x FROM range({_N}) t(i)")
def _(s, d):
    """An early stop leaves a large dense part, which is factorised over blocks."""
    m = X.parts_square(s, d)
    f = factorize(m, SolverParams(density_tolerance=0.02, max_dense_schur=32, dense_block=64))
    return solve(f, A.spmv(m.entries, default_vector(s, m.n), m.m)).select("i", _round("x"))


@_query("backward_error_small", "SELECT true AS small")
def _(s, d):
    m, f = _factors(s, d)
    b = A.spmv(m.entries, default_vector(s, m.n), m.m)
    return A.backward_error(m.entries, materialize(solve(f, b)), b, m.m).select((F.col("backward_error") < 1e-12).alias("small"))


@_query("sweep_marko_tol", "SELECT 2.0::DOUBLE + 2 * i AS param_value, true AS solved FROM range(2) t(i)")
def _(s, d):
    return sweep.sweep(X.parts_square(s, d), "marko_tol", 2.0, 2.0, 2).select("param_value", "solved")


@_query("sweep_value_tol", "SELECT 0.1::DOUBLE * pow(0.5, i) AS param_value, true AS solved FROM range(2) t(i)")
def _(s, d):
    return sweep.sweep(X.parts_square(s, d), "value_tol", 0.1, 0.5, 2).select("param_value", "solved")


_E2 = _dominant(_OFF2)
_BL = f"""rb AS (SELECT CAST(i AS INT) AS row, CAST(i // {_BS} AS INT) AS block, CAST(i AS INT) AS pos FROM range({_N}) t(i)),
cb AS (SELECT col, CASE WHEN min(block) = max(block) THEN min(block) END AS block FROM e JOIN rb USING (row) GROUP BY col),
bd AS (SELECT DISTINCT rb.block, e.col FROM e JOIN cb ON e.col = cb.col AND cb.block IS NULL JOIN rb USING (row)),
bz AS (SELECT block, n_rows, coalesce(n_interior, 0) AS n_interior, coalesce(nnz, 0) AS nnz, coalesce(n_border, 0) AS n_border FROM (SELECT block, count(*) AS n_rows FROM rb GROUP BY 1) LEFT JOIN (SELECT block, count(*) AS n_interior FROM cb WHERE block IS NOT NULL GROUP BY 1) USING (block) LEFT JOIN (SELECT block, count(*) AS nnz FROM e JOIN rb USING (row) GROUP BY 1) USING (block) LEFT JOIN (SELECT block, count(*) AS n_border FROM bd GROUP BY 1) USING (block))"""


def _blocks(s, d):
    m = X.parts_blocks(s, d)
    rows = B.row_blocks(B.contiguous(s, m.m, 4))
    return m, rows, B.col_blocks(m.entries, rows)


@_query("row_blocks", "SELECT * FROM rb", _E2, _BL)
def _(s, d):
    return _blocks(s, d)[1]


@_query("col_blocks", "SELECT * FROM cb", _E2, _BL)
def _(s, d):
    return _blocks(s, d)[2]


@_query("border_columns", "SELECT * FROM bd", _E2, _BL)
def _(s, d):
    m, r, c = _blocks(s, d)
    return B.border(m.entries, r, c)


@_query("block_sizes", "SELECT * FROM bz", _E2, _BL)
def _(s, d):
    m, r, c = _blocks(s, d)
    return B.block_sizes(m.entries, r, c)


@_query("block_stats", " UNION ALL ".join(f"SELECT '{w}' AS what, round(avg({w}), 6) AS avg, round(stddev_pop({w}), 6) AS std, max({w}) AS max, min({w}) AS min FROM bz" for w in ("n_rows", "n_interior", "nnz")), _E2, _BL)
def _(s, d):
    m, r, c = _blocks(s, d)
    return B.block_stats(B.block_sizes(m.entries, r, c)).select("what", _round("avg"), _round("std"), "max", "min")


@_query("block_entries", f"SELECT rb.block, CAST(e.row - rb.block * {_BS} AS INT) AS row, e.col, e.val, cb.block IS NOT NULL AS interior FROM e JOIN rb USING (row) JOIN cb USING (col)", _E2, _BL)
def _(s, d):
    m, r, c = _blocks(s, d)
    return B.block_entries(m.entries, r, c)


@_query("block_check", "SELECT CAST(0 AS BIGINT) AS violations")
def _(s, d):
    m, r, c = _blocks(s, d)
    return B.violations(m.entries, r, c)


@_query("sbbd_solution", f"SELECT CAST(i AS INT) AS i, i + 1.0::DOUBLE AS x FROM range({_N}) t(i)")
def _(s, d):
    m, r, _c = _blocks(s, d)
    return bordered.solve(m, A.spmv(m.entries, default_vector(s, m.n), m.m), r.select("row", "block")).select("i", _round("x"))


@_query("sbbd_nested_solution", f"SELECT CAST(i AS INT) AS i, i + 1.0::DOUBLE AS x FROM range({_N}) t(i)")
def _(s, d):
    """A run with a multilevel partition into four blocks, whose border is too large for one task and is bordered itself."""
    m = X.parts_blocks(s, d)
    p = bordered.BorderedParams(num_blocks=4, solver=SolverParams(max_dense_schur=32, dense_block=64))
    return bordered.run(m, A.spmv(m.entries, default_vector(s, m.n), m.m), p)["x"].select("i", _round("x"))


@_query("border_stats", "SELECT count(DISTINCT col) AS n_border, count(*) AS nnz_border FROM e WHERE col IN (SELECT col FROM cb WHERE block IS NULL)", _E2, _BL)
def _(s, d):
    m, _r, c = _blocks(s, d)
    return B.border_stats(m.entries, c)


@_query("local_columns", "SELECT block, col, CAST(row_number() OVER (PARTITION BY block ORDER BY edge, col) - 1 AS INT) AS local FROM (SELECT block, col, 0 AS edge FROM cb WHERE block IS NOT NULL UNION ALL SELECT block, col, 1 FROM bd)", _E2, _BL)
def _(s, d):
    m, r, c = _blocks(s, d)
    return B.local_columns(m.entries, r, c)


@_query("grown_partition", f"SELECT {_N} AS n_rows, true AS balanced, true AS no_worse")
def _(s, d):
    """Rows of the grown partition, whether blocks stay within their room, and whether no more columns are cut than by equal ranges."""
    m = X.parts_square(s, d)
    e = materialize(m.entries)
    ranges, grown = B.contiguous(s, m.m, 4), B.grown(e, m.m, 4)
    cut = lambda r: B.col_blocks(e, r).where("block is null").agg(F.count(F.lit(1)).alias("cut"))
    sizes = grown.groupBy("block").count().agg(F.sum("count").alias("n_rows"), (F.max("count") <= int(1.25 * -(-m.m // 4))).alias("balanced"))
    return sizes.crossJoin(cut(ranges).withColumnRenamed("cut", "a")).crossJoin(cut(grown).withColumnRenamed("cut", "b")).select("n_rows", "balanced", (F.col("b") <= F.col("a")).alias("no_worse"))  # one row each


@_query("multilevel_partition", f"SELECT {_N} AS n_rows, (SELECT count(*) FROM (SELECT col FROM (SELECT col, (row * 7919) % {_N} // {_BS} AS b FROM e) GROUP BY col HAVING count(DISTINCT b) > 1)) AS ranges_cut, true AS balanced, true AS halved", _E2)
def _(s, d):
    """Rows of a block matrix, shuffled: what equal ranges of them cut, and whether the partition's blocks stay within their room and it cuts at most half of that."""
    m = X.parts_blocks(s, d)
    e = materialize(m.entries.select((F.col("row").cast("long") * 7919 % m.n).cast("int").alias("row"), "col", "val"))
    ranges, found = B.contiguous(s, m.m, 4), multilevel.partition(e, m.m, 4)
    cut = lambda r, name: B.col_blocks(e, r).agg(F.count_if(F.col("block").isNull()).alias(name))
    sizes = found.groupBy("block").count().agg(F.sum("count").alias("n_rows"), (F.max("count") <= 1.1 * m.m / 4).alias("balanced"))
    both = sizes.crossJoin(cut(ranges, "ranges_cut")).crossJoin(cut(found, "cut"))  # one row each
    return both.select("n_rows", "ranges_cut", "balanced", (F.col("cut") * 2 <= F.col("ranges_cut")).alias("halved"))


@_query("check_duplicates", "SELECT count(*) AS violations FROM (SELECT 1 FROM e GROUP BY row, col HAVING count(*) > 1)", _E)
def _(s, d):
    return C.duplicates(X.parts_square(s, d).entries)


@_query("check_same_pattern", "SELECT CAST(0 AS BIGINT) AS violations")
def _(s, d):
    e = X.parts_square(s, d).entries
    return C.same_pattern(L.compressed(e, "col").select("col", F.explode("cells").alias("c")).select("c.row", "col"), L.compressed(e, "row").select("row", F.explode("cells").alias("c")).select("row", "c.col"))


@_query("check_perms", "SELECT CAST(0 AS BIGINT) AS violations")
def _(s, d):
    m, f = _factors(s, d)
    p = materialize(full_permutation(f))
    return C.permutation(p, m.n, "row").union(C.permutation(p, m.n, "col")).agg(F.sum("violations").alias("violations"))


@_query("check_pivots", "SELECT CAST(0 AS BIGINT) AS violations")
def _(s, d):
    _, e, p = _first_step(s, d)
    return C.pivots_emptied(U.schur(e, p, U.lower(e, p), U.upper(e, p)), p)


@_query("check_independence", "SELECT CAST(0 AS BIGINT) AS violations")
def _(s, d):
    _, e, p = _first_step(s, d)
    return C.independence(e, p.where("kind = 'LUBY'"))


@_query("trace_events")
def _(s, d):
    t = report.Trace()
    with t.span("read"):
        m = X.parts_square(s, d)
    with t.span("norm"):
        A.norm_inf(m.entries).first()
    return t.frame(s)
