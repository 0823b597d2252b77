"""Command line: ``python -m gridloom.plans.cli run|time|analyze|show FILE.json...``."""

from __future__ import annotations

import argparse
import itertools
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.jsons import json_read, json_show
from ..operators import from_json
from ..operators.base import Operator, describe
from ..operators.containers import Pipeline
from .. import sources  # noqa: F401  registers the sources
from .run import RunParams, latencies, run

MAX_RUNS = 1000


def parse_run_list(value: Any, base: str) -> list[tuple[str, str]]:
    """(suffix, path) pairs of a run list; every element is checked."""
    if not isinstance(value, list) or not value:
        raise ValueError("a run list is a list that is not empty")
    out = []
    for x in value:
        if not isinstance(x, list) or len(x) != 2 or not all(isinstance(s, str) for s in x):
            raise ValueError(f"{x!r} is no pair of suffix and file name")
        out.append((x[0], os.path.join(base, x[1])))
    if len({s for s, _ in out}) < len(out):
        raise ValueError("a run list's suffixes must differ")
    return out


def expand(paths: list[str]) -> list[tuple[str, list[str]]]:
    """(suffix, pipeline files) of every run: run lists multiply out, single pipelines are in each."""
    choices = []
    for p in paths:
        value = json_read(p)
        is_list = isinstance(value, list) and value and all(isinstance(x, list) for x in value)
        choices.append(parse_run_list(value, os.path.dirname(p)) if is_list else [("", p)])
    n = 1
    for c in choices:
        n *= len(c)
    if n > MAX_RUNS:
        raise ValueError(f"{n} runs are more than {MAX_RUNS}")
    return [("_".join(s for s, _ in combo if s), [p for _, p in combo]) for combo in itertools.product(*choices)]


def load(paths: list[str]) -> Pipeline:
    return Pipeline([from_json(json_read(p)) for p in paths])


def time_operators(spark: SparkSession, op: Pipeline) -> list[tuple[str, float]]:
    """Seconds to compute the stream up to and including each top-level operator."""
    source, rest = op.first()
    out = []
    for k in range(len(rest) + 1):
        began = time.time()
        grid = Pipeline(rest[:k]).apply(source.load(spark))
        grid.cells.agg(F.sum("intensity"), F.sum("weight")).collect()
        name: Operator = rest[k - 1] if k else source
        out.append((name.class_name or type(name).__name__, time.time() - began))
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("command", choices=["run", "time", "analyze", "show"])
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--outdir")
    p.add_argument("-n", "--no-output", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=1)
    p.add_argument("-d", "--depth", type=int)
    a = p.parse_args(argv)
    if a.command == "show":
        for f in a.files:
            print(json_show(json_read(f), a.depth))
        return 0
    if a.command == "analyze":
        op = load(a.files)
        print(describe(op))
        for r in latencies(op):
            print(f"{'  ' * r['depth']}{r['name']}: nt_chunk {r['nt_chunk']}, lag {r['lag']}")
        return 0
    if a.command == "run" and not a.no_output and not a.outdir:
        p.error("give --outdir or --no-output")
    spark = SparkSession.builder.config("spark.scheduler.mode", "FAIR").getOrCreate()
    if a.command == "time":
        last = 0.0
        for name, s in time_operators(spark, load(a.files)):
            print(f"{name}: {s:.3f} s in all, {s - last:+.3f} s")
            last = s
        return 0
    runs = expand(a.files)

    def one(x: tuple[str, list[str]]) -> bool:
        suffix, paths = x
        out = None if a.no_output else os.path.join(a.outdir, suffix) if suffix else a.outdir
        try:
            run(spark, load(paths), RunParams(outdir=out))
        except Exception as e:  # a run's failure is told, and the others go on
            print(f"{suffix or paths}: {e}", file=sys.stderr)
            return False
        return True

    with ThreadPoolExecutor(max(1, min(a.threads, 40))) as pool:
        return 0 if all(list(pool.map(one, runs))) else 1


if __name__ == "__main__":
    sys.exit(main())
