"""Running a pipeline: parameters, report, atomic output."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.jsons import json_write
from ..functions.numbers import gcd
from ..grid import Grid, GridMeta
from ..operators.base import Operator, Source, visit
from ..operators.containers import Pipeline


@dataclass
class RunParams:
    """Where and how a run puts its report; outdir None: nowhere."""

    outdir: str | None = None
    clobber: bool = True
    img_nzoom: int = 4
    img_nds: int = 16
    img_nx: int = 256
    verbosity: int = 2
    debug: bool = False
    extra_attrs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.img_nzoom <= 0 or self.img_nds <= 0 or self.img_nx <= 0 or self.img_nx % 2:
            raise ValueError("img_nzoom, img_nds and img_nx must be positive, and img_nx even")


def report_nodes(op: Operator) -> dict[str, Any]:
    node: dict[str, Any] = {"name": op.class_name or type(op).__name__}
    try:
        node["params"] = {k: v for k, v in op.jsonize().items() if k not in ("class_name", "elements", "sub_pipeline")}
    except TypeError:
        node["params"] = {}
    if kids := op.children():
        node["elements"] = [report_nodes(c) for c in kids]
    return node


def run(spark: SparkSession, op: Operator, params: RunParams | None = None, collect: bool = True) -> tuple[Grid | None, dict[str, Any]]:
    """Run a pipeline whose first element is a source: (grid, report).

    The report is written even if the run fails, and then the error is raised: to a
    temporary name first, which is renamed once it is whole. With collect, one
    aggregation counts samples and unmasked cells.
    """
    params = params or RunParams()
    p = op if isinstance(op, Pipeline) else Pipeline([op])
    report: dict[str, Any] = {"success": False, "error_message": "", "run_params": {k: v for k, v in vars(params).items() if k != "extra_attrs"}, "attrs": dict(params.extra_attrs), "pipeline": report_nodes(p)}
    grid = None
    began = time.time()
    try:
        grid = p.run(spark)
        m = grid.meta
        report["attrs"] |= {k: getattr(m, k) for k in ("nfreq", "freq_lo_MHz", "freq_hi_MHz", "dt_sample", "t_initial") if getattr(m, k) is not None} | dict(m.attrs)
        if collect:
            r = grid.cells.agg(F.max("t"), F.count(F.lit(1)), F.count_if(F.col("weight") > 0)).first()
            report |= {"nsamples_in": (r[0] + m.nds) if r[0] is not None else 0, "ncells": r[1], "nunmasked": r[2]}
        report["outputs"] = sorted(grid.outputs)
        report["success"] = True
    except Exception as e:
        report["error_message"] = str(e).splitlines()[0] if str(e) else type(e).__name__
        raise
    finally:
        report["seconds"] = round(time.time() - began, 3)
        if params.outdir is not None:
            write_report(report, params)
    return grid, report


def write_report(report: dict, params: RunParams, name: str = "pipeline_0.json") -> str:
    os.makedirs(params.outdir, exist_ok=True)
    at = os.path.join(params.outdir, name)
    if os.path.exists(at) and not params.clobber:
        raise FileExistsError(at)
    json_write(f"{at}.tmp", report, clobber=True)
    os.replace(f"{at}.tmp", at)
    return at


def latencies(op: Operator, nt_in: int = 1024) -> list[dict[str, Any]]:
    """Per operator in order: depth, chunk sizes, and the samples by which its output lags (bound for a watermark)."""
    out, lag, size = [], 0, nt_in
    for o, depth in visit(op):
        nt = getattr(o, "nt_chunk", 0) or size
        if isinstance(o, (Pipeline, Source)):
            size = nt if isinstance(o, Source) else size
            out.append({"name": o.class_name, "depth": depth, "nt_chunk": size, "lag": lag})
            continue
        lag += nt - gcd(size, nt)
        size = size if size % nt == 0 else nt
        out.append({"name": o.class_name or type(o).__name__, "depth": depth, "nt_chunk": nt, "lag": lag})
    return out


def footprint_mb(meta: GridMeta, nt: int) -> float:
    """MB of the cells of nt samples, as double intensity and weight."""
    return 16e-6 * meta.nfreq * (nt // meta.nds)
