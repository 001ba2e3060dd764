"""Logs and files about runs: summaries, per-step tables, series, prefixes, traces."""

from __future__ import annotations

import os
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..model import Factors, SolverParams

#: States of a trace, by the number that stands for each. Fixed values.
STATES = (
    "get singletons", "get eligible", "auxiliary", "assign score", "first pass", "discarding pivots",
    "getting pivots", "update L", "update S cols", "update S rows", "convert matrix", "dense factorization",
)


def summary(f: Factors, facts: dict[str, float] | None = None) -> str:
    """Text of a run; facts: from factorize.accounting() and norms."""
    lines = [f"rows {f.m}, columns {f.n}", f"steps {len(f.steps)}, stopped: {f.reason}", f"sparse pivots {f.done}, dense pivots {f.n - f.done}"]
    lines += [f"{k} {sum(s[k] for s in f.steps):.3f} s" for k in ("search_s", "update_s")]
    lines += [f"{k} {v:.6g}" for k, v in (facts or {}).items()]
    return "\n".join(lines)


#: Totals over steps: name in files, key of a step. Fixed values.
TOTALS = {
    "timing_total_pivot_search": "search_s", "timing_total_extracting_candidates": "candidates_s", "timing_total_merging_pivots": "merging_s",
    "timing_total_update": "update_s", "timing_total_update_LD": "ld_s", "timing_total_update_U": "u_s", "timing_total_update_S": "s_s",
}


def _us(seconds: float | None) -> str:
    return "?" if seconds is None else f"{seconds * 1e6:.0f}"


def _sum(f: Factors, key: str) -> float | None:
    """Over the steps; nothing where a step's parts weren't measured."""
    found = [s[key] for s in f.steps]
    return None if None in found else sum(found)


def totals(f: Factors) -> dict[str, str | float]:
    """Microseconds of each part over all steps, and mean and population deviation of pivots per step."""
    found = [s["pivots"] for s in f.steps]
    mean = sum(found) / len(found) if found else 0.0
    out = {name: _us(_sum(f, key)) for name, key in TOTALS.items()}
    return out | {"pivots_mean": mean, "pivots_std": (sum((x - mean) ** 2 for x in found) / len(found)) ** 0.5 if found else 0.0}


def raw_text(f: Factors, facts: dict[str, float]) -> str:
    """'#key value' lines, then a line per step: pivots and microseconds; ? where a run's parts weren't measured."""
    head = [f"#{k}\t{v}" for k, v in ({"sparse_pivots": f.done, "dense_pivots": f.n - f.done, "nb_steps": len(f.steps), "reason": f.reason} | totals(f) | facts).items()]
    return "\n".join(head + ["#pivots\tsearch\tcandidates\tmerging\tupdate\tupdate LD\tupdate U\tupdate S"] + ["\t".join([str(s["pivots"]), *(_us(s[k]) for k in TOTALS.values())]) for s in f.steps]) + "\n"


# Column labels of a sweep's file.
SWEEP_COLUMNS = (
    "timing total", "timing sparse", "timing dense", "timing convert", "timing pivot search", "timing creating init sets", "timing merging pivots",
    "timing update", "timing update LD", "timing update U", "timing update S", "timing solve", "timing solve L", "timing solve dense", "timing solve U",
    "forward error", "backward error", "schur density", "sparse pivots S", "dense pivots", "nnz", "nnz L", "nnz U", "#steps",
)


def sweep_text(stats: DataFrame, swept: str, p: SolverParams) -> str:
    """The parameters as '#' lines, labels, and a line per run: the swept value and 24 more, ? where a run doesn't measure it."""
    head = [f"#{k}\t{getattr(p, k)}" for k in ("value_tol", "marko_tol", "nb_candidates_per_block", "nb_previous_pivots", "min_pivot_per_steps", "density_tolerance", "max_dense_schur") if k != swept]
    lines = []
    for r in stats.orderBy("run").collect():  # a row per run
        known = {
            "timing total": _us(r.search_s + r.update_s + (r.convert_s or 0) + (r.dense_s or 0)), "timing sparse": _us(r.search_s + r.update_s), "timing dense": _us(r.dense_s), "timing convert": _us(r.convert_s), "timing pivot search": _us(r.search_s),
            "timing creating init sets": _us(r.candidates_s), "timing merging pivots": _us(r.merging_s), "timing update": _us(r.update_s), "timing update LD": _us(r.ld_s), "timing update U": _us(r.u_s), "timing update S": _us(r.s_s), "timing solve": _us(r.solve_s),
            "timing solve L": _us(r.solve_l_s), "timing solve dense": _us(r.solve_dense_s), "timing solve U": _us(r.solve_u_s), "forward error": f"{r.forward_error:e}", "backward error": f"{r.backward_error:e}", "schur density": f"{r.schur_density:f}",
            "sparse pivots S": str(r.sparse_pivots), "dense pivots": str(r.dense_pivots), "nnz": str(r.nnz_final), "nnz L": str(r.nnz_l), "nnz U": str(r.nnz_u), "#steps": str(r.steps),
        }
        lines.append("\t".join([f"{r.param_value:g}", *(known.get(c, "?") for c in SWEEP_COLUMNS)]))
    return "\n".join([*head, "\t".join(f'"{c}"' for c in (swept, *SWEEP_COLUMNS)), *lines]) + "\n"


def write_text(path: str, text: str) -> None:
    with open(path, "w") as f:
        f.write(text)


def make_dirs(root: str) -> None:
    for d in ("data", "plot", "fig", "trace"):
        os.makedirs(os.path.join(root, d), exist_ok=True)


def prefix(matrix: str, p: SolverParams, threads: int, swept: str | None = None) -> str:
    """Output files' prefix; the swept parameter reads MULTI."""
    name = os.path.splitext(os.path.basename(matrix))[0]
    show = lambda key, v: "MULTI" if key == swept else f"{v:g}" if isinstance(v, float) else str(v)
    fields = [("value_tol", p.value_tol, "ValTol"), ("marko_tol", p.marko_tol, "MarkoTol"), ("nb_threads", threads, "threads"), ("nb_candidates_per_block", p.nb_candidates_per_block, "candidates"), ("density_tolerance", p.density_tolerance, "densityTol"), ("min_pivot_per_steps", p.min_pivot_per_steps, "minPivots")]
    return "_".join([name, *(show(k, v) + label for k, v, label in fields)])


def series(f: Factors, columns: tuple[str, ...] = ("search_s", "update_s")) -> str:
    """A line per step, ? where a value is missing; times end with a column and a line for the dense part."""
    show = lambda v: "?" if v is None else f"{v}"
    lines = [[show(s.get(c)) for c in columns] for s in f.steps]
    if "search_s" in columns:
        lines = [[*x, "?"] for x in lines] + [["?"] * len(columns) + [show(f.kept.get("seconds", {}).get("dense"))]]
    return "\n".join(map("\t".join, lines))


class Trace:
    """Spans of named states by thread; nested spans of one thread are refused."""

    def __init__(self):
        self.events, self.open, self.lock, self.zero = [], {}, threading.Lock(), time.perf_counter()

    @contextmanager
    def span(self, event: str):
        who = threading.get_ident()
        with self.lock:
            if who in self.open:
                raise RuntimeError("a span is open in this thread")
            self.open[who] = event
        began = time.perf_counter()
        try:
            yield
        finally:
            with self.lock:
                del self.open[who]
                self.events.append((who % 2**31, event, int((began - self.zero) * 1e6), int((time.perf_counter() - self.zero) * 1e6)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, "thread long, event string, start_us long, end_us long")

    def text(self) -> str:
        """A Paje trace: its definitions, a container for each thread, and its states in order of time, idle between them."""
        names = sorted({e for _, e, _, _ in self.events})
        who = {t: k for k, t in enumerate(sorted({t for t, *_ in self.events}))}
        lines = [
            "%EventDef PajeDefineContainerType 1", "% Alias string", "% Type string", "% Name string", "%EndEventDef",
            "%EventDef PajeDefineStateType 3", "% Alias string", "% Type string", "% Name string", "%EndEventDef",
            "%EventDef PajeDefineEntityValue 4", "% Alias string", "% Type string", "% Name string", "%EndEventDef",
            "%EventDef PajeCreateContainer 5", "% Time date", "% Alias string", "% Type string", "% Container string", "% Name string", "%EndEventDef",
            "%EventDef PajeDestroyContainer 6", "% Time date", "% Type string", "% Name string", "%EndEventDef",
            "%EventDef PajeSetState 8", "% Time date", "% Type string", "% Container string", "% Value string", "%EndEventDef",
            '1 T 0 "thread"', '3 S T "state"', '4 idle S "idle"', *(f'4 e{k} S "{n}"' for k, n in enumerate(names)), *(f'5 0 t{k} T 0 "thread {k}"' for k in who.values()),
        ]
        moves = [(s, who[t], f"e{names.index(e)}") for t, e, s, _ in self.events] + [(d, who[t], "idle") for t, _, _, d in self.events]
        end = max((d for *_, d in self.events), default=0)
        lines += [f"8 {at / 1e6:.6f} S t{t} {state}" for at, t, state in sorted(moves, key=lambda m: (m[0], m[2] != "idle"))]
        return "\n".join([*lines, *(f"6 {end / 1e6:.6f} T t{k}" for k in who.values())]) + "\n"
