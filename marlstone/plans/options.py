"""Command-line options of a run, and the run that they describe."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..model import SolverParams
from ..operators import algebra as A
from ..sources.triplets import read_matrix, read_vector
from . import bordered, report
from .factorize import accounting, cross_check, cross_check_permuted, factorize, solve, tail_blocks
from .sweep import sweep

# Option names, and the parameters that they set.
NUMBERS = {
    "value_tol": ("value_tol", float),
    "marko_tol": ("marko_tol", float),
    "nb_candidates_per_block": ("nb_candidates_per_block", int),
    "nb_previous_pivots": ("nb_previous_pivots", int),
    "schur_density_tolerance": ("density_tolerance", float),
    "min_pivot_per_steps": ("min_pivot_per_steps", int),
    "max_dense_schur": ("max_dense_schur", int),
}
TEXTS = ("matrix", "RHS_file", "prog_name", "output_dir", "output_file")
#: Of memory and threads, which Spark manages: read, not used.
UNUSED = {"nb_threads": 1, "extra_space": 1, "extra_space_inbetween": 1, "counters_size": 1, "singeltons_relaxation": 1, "debug_mode": 0, "check_schur_memory": 0}
CHECKED = {"check_pivots": "pivots", "check_schur_symetry": "logical_sum", "check_counters": "counters", "check_schur_doubles": "doubles"}
FLAGS = ("print_each_step", "verbose_gossip_girl", "trace", "help")
#: Parameters that --group_run sweeps: name, first value, increment, steps.
GROUP = {"value_tol", "marko_tol", "schur_density", "nb_candidates", "min_pivots"}
_SWEPT = {"schur_density": "density_tolerance", "nb_candidates": "nb_candidates_per_block", "min_pivots": "min_pivot_per_steps"}


@dataclass
class Options:
    params: SolverParams = field(default_factory=SolverParams)
    texts: dict[str, str] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)
    checks: set[str] = field(default_factory=set)
    verbosity: int = 1
    group_run: tuple[str, float, float, int] | None = None
    cross_check: bool = False


def parse(args: list[str]) -> Options:
    """Options from '--name value' words. Unknown names and values out of range are refused; unused ones warn."""
    out, values, words = Options(), {}, iter(args)

    def value(name: str) -> str:
        word = next(words, None)
        if word is None:
            raise ValueError(f"--{name} needs a value")
        return word

    for word in words:
        name = word.removeprefix("--")
        if name == word:
            raise ValueError(f"{word!r} is no option")
        if name in NUMBERS:
            key, kind = NUMBERS[name]
            values[key] = kind(value(name))
        elif name in TEXTS:
            out.texts[name] = value(name)
        elif name == "verbosity":
            out.verbosity = int(value(name))
        elif name == "luby_algorithm":
            values["pivot_strategy"] = "independent" if int(value(name)) else "blocks"
        elif name in CHECKED:
            out.checks.add(CHECKED[name])
        elif name in ("check_dense_with_perm", "check_with_dense_perm"):
            out.cross_check = True
        elif name in FLAGS:
            out.flags.add(name)
        elif name == "group_run":
            what = value(name)
            if what not in GROUP:
                raise ValueError(f"{what} can't be swept")
            out.group_run = (_SWEPT.get(what, what), float(value(name)), float(value(name)), int(value(name)))
        elif name in UNUSED:
            for _ in range(UNUSED[name]):
                value(name)
            warnings.warn(f"--{name} has no effect here", stacklevel=2)
        else:
            raise ValueError(f"unknown option --{name}")
    out.params = SolverParams(**values)
    return out


def run(spark: SparkSession, options: Options) -> dict:
    """Reads the matrix, factorises, solves for b = A x with the given or default x, and reports; or sweeps."""
    a = read_matrix(spark, options.texts["matrix"])
    x0 = read_vector(spark, a.n, options.texts.get("RHS_file"))
    out_dir = options.texts.get("output_dir")
    if out_dir:
        report.make_dirs(out_dir)
    name = report.prefix(options.texts["matrix"], options.params, 1, options.group_run[0] if options.group_run else None)
    if options.group_run:
        stats = sweep(a, *options.group_run, params=options.params, measured=True)
        text = report.sweep_text(stats, options.group_run[0], options.params)
        if out_dir:
            report.write_text(f"{out_dir}/data/MULTI_{name}_raw.dat", text)
        return {"stats": stats, "text": text}
    trace = report.Trace() if "trace" in options.flags else None
    f = factorize(a, options.params, trace=trace, checks=frozenset(options.checks), measured=out_dir is not None)
    if out_dir and f.n > f.done:
        tail_blocks(f, trace)
    b = A.spmv(a.entries, x0, a.m)
    solved: dict[str, float] = {}
    x = solve(f, b, seconds=solved)
    errors = {"backward_error": A.backward_error(a.entries, x, b, a.m).first()[0], "forward_error": A.norm2(A.axpby(x, 1.0, x0, -1.0)).first()[0] / max(1e-300, A.norm2(x0).first()[0])}
    facts = accounting(f, a.entries.count()) | errors | {f"timing_solve_{k}": v * 1e6 for k, v in solved.items()} | {f"timing_{k}": v * 1e6 for k, v in f.kept.get("seconds", {}).items()}
    if options.cross_check:
        facts |= {"cross_check": cross_check(a, f), "cross_check_permuted": cross_check_permuted(a, b, options.params)}
    text = report.summary(f, facts)
    if out_dir:
        report.write_text(f"{out_dir}/data/{name}_raw.dat", report.raw_text(f, facts))
        report.write_text(f"{out_dir}/data/{name}_time.dat", report.series(f))
        report.write_text(f"{out_dir}/data/{name}_pivots.dat", report.series(f, ("pivots",)))
        if trace:
            report.write_text(f"{out_dir}/trace/{name}.trace", trace.text())
    if "output_file" in options.texts:
        report.write_text(options.texts["output_file"], text)
    return {"factors": f, "x": x, "facts": facts, "text": text}


def run_bordered(spark: SparkSession, options: Options, num_blocks: int, partitioner: str = "multilevel") -> dict:
    """Reads the matrix, partitions it, factorises and solves in bordered form for b = A x, and reports."""
    a = read_matrix(spark, options.texts["matrix"])
    x0 = read_vector(spark, a.n, options.texts.get("RHS_file"))
    done = bordered.run(a, A.spmv(a.entries, x0, a.m), bordered.BorderedParams(num_blocks, partitioner, solver=options.params))
    error = A.norm2(A.axpby(done["x"], 1.0, x0, -1.0)).first()[0] / max(1e-300, A.norm2(x0).first()[0])
    lines = [f"blocks {num_blocks}, border columns {done['border']['n_border']}, their entries {done['border']['nnz_border']}"]
    lines += [f"{r.what}: mean {r.avg:.6g}, deviation {r.std:.6g}, most {r.max}, least {r.min}" for r in done["stats"].collect()]  # three rows
    text = "\n".join([*lines, f"backward_error {done['backward_error']:.6g}", f"forward_error {error:.6g}"])
    if "output_file" in options.texts:
        report.write_text(options.texts["output_file"], text)
    return done | {"forward_error": error, "text": text}
