"""Pipelines, sub-pipelines at lower resolution, forks, saved buffers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from ..functions.numbers import xdiv
from ..functions.resample import downsample, upsample_weights
from ..grid import CELL, Grid, GridMeta
from ..storage import cut
from .base import Operator, Source, from_json

#: Branching plans are computed again for every branch; from this many on, the cells are written once.
BRANCHES = 2
#: One or two operators are cheaper as expressions of rows, more of them as arrays.
FUSE = 3


@dataclass
class Pipeline(Operator):
    """Operators in order; the first may be a source."""

    elements: list[Operator] = field(default_factory=list)
    name: str = ""
    class_name = "pipeline"
    in_sub_pipeline = True

    def add(self, op: Operator) -> Pipeline:
        self.elements.append(op)
        return self

    def __len__(self) -> int:
        return len(self.elements)

    def children(self) -> list[Operator]:
        return self.elements

    def _bind(self, meta: GridMeta) -> GridMeta:
        for op in self.elements:
            if not isinstance(op, Source):
                meta = op.bind(meta)
        return meta

    def apply(self, grid: Grid) -> Grid:
        """The operators in order. Runs of FUSE or more that have kernels go through chunks together, in one shuffle and one pass."""
        from .fused import runs

        for op in runs(self.elements, grid, FUSE):
            grid = op(grid)
            if grid.branches >= BRANCHES and op is not self.elements[-1]:
                grid = replace(grid, df=cut(grid.df), branches=0)
        return grid

    def run_packed(self, spark: Any, nt_chunk: int = 0) -> Any:
        """Load the first element as packed chunks and run all the rest on them, without a row per cell anywhere. All must have kernels."""
        from .fused import FusedChain, common_chunk

        first, rest = self.first()
        packed = first.load_packed(spark, nt_chunk or (0 if first.has_chunks else common_chunk(rest) or 1024))
        return packed.run(FusedChain(rest, packed.nt_chunk))

    def run(self, spark: Any) -> Grid:
        """Load the first element, which must be a source, bind all the rest, then declare their plan."""
        first, rest = self.first()
        grid = first.load(spark)
        tail = Pipeline(rest)
        tail.bind(grid.meta)
        return tail.apply(grid)

    def first(self) -> tuple[Source, list[Operator]]:
        """The source, and what follows it; nested pipelines are opened."""
        if not self.elements:
            raise ValueError("the pipeline is empty")
        head, rest = self.elements[0], self.elements[1:]
        if isinstance(head, Pipeline):
            source, more = head.first()
            return source, more + rest
        if not isinstance(head, Source):
            raise ValueError("the pipeline's first element must be a source")
        return head, rest

    def jsonize(self) -> dict[str, Any]:
        out: dict[str, Any] = {"class_name": "pipeline", "elements": [e.jsonize() for e in self.elements]}
        return out | ({"name": self.name} if self.name else {})

    @classmethod
    def from_json(cls, j: dict[str, Any]) -> Pipeline:
        return cls([from_json(e) for e in j["elements"]], j.get("name", ""))


@dataclass
class SubPipeline(Operator):
    """Run operators on a downsampled copy, and keep only the mask they leave.

    The factors come from Df or nfreq_out, and from Dt or nds_out; where both of a pair
    are given they must agree. A cell is kept if its block's weight is above w_cutoff.
    Buffers that were saved outside are not visible inside.
    """

    sub_pipeline: Operator
    w_cutoff: float = 0.0
    nt_chunk: int = 0
    nfreq_out: int = 0
    nds_out: int = 0
    Df: int = 0  # noqa: N815
    Dt: int = 0  # noqa: N815
    class_name = "wi_sub_pipeline"
    in_sub_pipeline = True

    def children(self) -> list[Operator]:
        return [self.sub_pipeline]

    def factors(self, meta: GridMeta) -> tuple[int, int]:
        if self.w_cutoff < 0:
            raise ValueError("w_cutoff must not be negative")
        out = []
        for given, size, whole, what in ((self.Df, self.nfreq_out, meta.nfreq, "Df or nfreq_out"), (self.Dt, self.nds_out, meta.nds, "Dt or nds_out")):
            if not given and not size:
                raise ValueError(f"{what} must be given")
            d = given or (xdiv(whole, size) if what[1] == "f" else xdiv(size, whole))
            if size and size * (d if what[1] == "f" else 1) != (whole if what[1] == "f" else whole * d):
                raise ValueError(f"{what} do not agree")
            out.append(d)
        xdiv(meta.nfreq, out[0])
        return out[0], out[1]

    def inner(self, meta: GridMeta) -> GridMeta:
        Df, Dt = self.factors(meta)  # noqa: N806
        return replace(meta, nfreq=meta.nfreq // Df, nds=meta.nds * Dt)

    def _bind(self, meta: GridMeta) -> GridMeta:
        self.sub_pipeline.bind(self.inner(meta))
        return meta

    def apply(self, grid: Grid) -> Grid:
        Df, Dt = self.factors(grid.meta)  # noqa: N806
        plain = replace(grid, df=grid.cells)
        low = self.sub_pipeline(downsample(replace(plain, df=plain.df.select(*CELL)), Df, Dt))
        out = plain.with_df(upsample_weights(plain, low, self.w_cutoff), branches=grid.branches + 1)
        return replace(out, outputs=low.outputs)

    def jsonize(self) -> dict[str, Any]:
        return super().jsonize() | {"sub_pipeline": self.sub_pipeline.jsonize()}

    @classmethod
    def from_json(cls, j: dict[str, Any]) -> SubPipeline:
        return cls(**{k: from_json(v) if k == "sub_pipeline" else v for k, v in j.items() if k != "class_name"})


BUILT_IN = {"INTENSITY": "intensity", "WEIGHTS": "weight"}


def buffer(name: str) -> str:
    """The column of a named buffer."""
    return BUILT_IN.get(name, name)


@dataclass
class PipelineFork(Operator):
    """Copy buffers under new names: (from, to) pairs. INTENSITY and WEIGHTS name the cells' own columns."""

    bufnames: list
    class_name = "pipeline_fork"
    in_sub_pipeline = True

    def _bind(self, meta: GridMeta) -> GridMeta:
        new = [b for _, b in self.bufnames]
        if not new or len(set(new)) < len(new) or any(b in BUILT_IN or b in CELL or b.startswith("__") for b in new):
            raise ValueError("new buffer names must be new and differ from each other")
        return meta

    def apply(self, grid: Grid) -> Grid:
        have = set(grid.df.columns)
        for a, b in self.bufnames:
            if buffer(a) not in have:
                raise ValueError(f"there is no buffer {a!r}")
            if b in have:
                raise ValueError(f"there is a buffer {b!r} already")
        return grid.with_df(grid.df.withColumns({b: F.col(buffer(a)) for a, b in self.bufnames}))


@dataclass
class Saver(Operator):
    """Keep intensity and weight as they are here, for a Reverter of the same name."""

    name: str = "saved"
    class_name = "saver"
    in_sub_pipeline = True

    def apply(self, grid: Grid) -> Grid:
        return grid.with_df(grid.df.withColumns({f"{self.name}_intensity": F.col("intensity"), f"{self.name}_weight": F.col("weight")}))


@dataclass
class Reverter(Operator):
    """Bring back what the Saver of the same name kept."""

    name: str = "saved"
    class_name = "reverter"
    in_sub_pipeline = True

    def apply(self, grid: Grid) -> Grid:
        i, w = f"{self.name}_intensity", f"{self.name}_weight"
        if i not in grid.df.columns:
            raise ValueError(f"nothing was saved as {self.name!r}")
        return grid.with_df(grid.df.withColumns({"intensity": F.col(i), "weight": F.col(w)}).drop(i, w))
