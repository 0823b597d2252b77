"""Chains in one pass: whole chunks go through all operators of a chain as arrays.

Operators with a ``kernel`` look no further than their chunk. A chain of them needs
each chunk once: one shuffle by chunk and one Arrow trip, however many operators there
are. A chunk's arrays (16 bytes a cell) must fit a worker; that is nfreq * nt_chunk
cells, whatever the data's length.

A packed grid stores a row per (chunk, channel) with its samples as bytes, 4 (float) or
8 (double) each: a row instead of 1024, and no conversion per sample on the way to
Python and back. Chains on packed grids are the fastest way through long streams.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import CELL, SCHEMA, Grid, GridMeta
from .base import Operator, Source
from .containers import Pipeline, SubPipeline

PACKED = "chunk BIGINT, freq INT, intensity BINARY, weight BINARY"
#: Cells of a chunk's arrays at most: 1 GB of intensities and weights.
CHUNK_CELLS = 1 << 26
#: Cells of the chunks that pipelines fuse on their own: 64 MB of intensities and weights.
FUSED_CELLS = 1 << 22


def leaves(op: Operator) -> list[Operator]:
    """The operators that must have a kernel."""
    return [x for c in op.children() for x in leaves(c)] if isinstance(op, (Pipeline, SubPipeline, FusedChain)) else [op]


def fusible(op: Operator) -> bool:
    return all(hasattr(x, "kernel") for x in leaves(op))


def common_chunk(ops: Iterable[Operator]) -> int:
    """The least number of samples that is a multiple of every operator's chunk; 0 if none has one."""
    sizes = [n for op in ops for x in leaves(op) if (n := getattr(x, "nt_chunk", 0))]
    return math.lcm(*sizes) if sizes else 0


def runs(ops: list[Operator], grid: Grid, least: int) -> list[Operator]:
    """ops with each run of at least ``least`` operators (those inside pipelines count) that have kernels as one FusedChain.

    Grids with saved buffers, and chunks of over FUSED_CELLS cells, stay as they are.
    """
    out: list[Operator] = []
    run: list[Operator] = []

    def close() -> None:
        nt, m = common_chunk(run), grid.meta
        whole = nt and nt % m.nds == 0 and m.nfreq * nt // m.nds <= FUSED_CELLS
        out.extend([FusedChain(list(run), nt)] if whole and sum(len(leaves(x)) for x in run) >= least else run)
        run.clear()

    for op in ops:
        if set(grid.cells.columns) == set(CELL) and not isinstance(op, FusedChain) and leaves(op) and fusible(op):
            run.append(op)
        else:
            close()
            out.append(op)
    close()
    return out


def run_kernel(op: Operator, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
    """op on arrays (nfreq, samples) that begin at native sample t0."""
    if isinstance(op, (Pipeline, FusedChain)):
        for x in op.children():
            i, w = run_kernel(x, i, w, meta, t0)
        return i, w
    if isinstance(op, SubPipeline):
        from ..functions.blocks import block_means, spread

        df, dt = op.factors(meta)
        low = run_kernel(op.sub_pipeline, *block_means(i, w, df, dt), op.inner(meta), t0)[1]
        return i, np.where(spread(low > op.w_cutoff, df, dt), w, 0.0)
    return op.kernel(i, w, meta, t0)


def apply_to_arrays(op: Operator, intensity: np.ndarray, weight: np.ndarray, **meta: float) -> tuple[np.ndarray, np.ndarray]:
    """op on one chunk given as (nfreq, nt) arrays; meta: further fields of GridMeta. The arrays given are left as they are."""
    m = GridMeta(intensity.shape[0], **meta)
    if not fusible(op):
        raise ValueError(f"{op.class_name or type(op).__name__} has no array form")
    op.bind(m)
    return run_kernel(op, np.array(intensity, dtype=float), np.array(weight, dtype=float), m, 0)


@dataclass
class FusedChain(Operator):
    """Operators with kernels, run together on whole chunks of nt_chunk samples.

    nt_chunk must be a multiple of every operator's own chunk. Missing cells count as
    weight 0 and stay missing.
    """

    elements: list[Operator] = field(default_factory=list)
    nt_chunk: int = 1024
    class_name = "fused_chain"
    in_sub_pipeline = True

    def children(self) -> list[Operator]:
        return self.elements

    def jsonize(self) -> dict:
        return {"class_name": self.class_name, "nt_chunk": self.nt_chunk, "elements": [e.jsonize() for e in self.elements]}

    @classmethod
    def from_json(cls, j: dict) -> FusedChain:
        from .base import from_json

        return cls([from_json(e) for e in j["elements"]], j["nt_chunk"])

    def _bind(self, meta: GridMeta) -> GridMeta:
        for x in leaves(self):
            if not hasattr(x, "kernel"):
                raise ValueError(f"{x.class_name or type(x).__name__} has no array form")
            own = getattr(x, "nt_chunk", 0)
            if own and self.nt_chunk % own:
                raise ValueError(f"nt_chunk={self.nt_chunk} is no multiple of {x.class_name}'s {own}")
        if self.nt_chunk % meta.nds or meta.nfreq * self.nt_chunk // meta.nds > CHUNK_CELLS:
            raise ValueError("a chunk must hold whole samples, and at most CHUNK_CELLS cells")
        for x in self.elements:
            meta = x.bind(meta)
        return meta

    def apply(self, grid: Grid) -> Grid:
        m, nt, chain = grid.meta, self.nt_chunk, self
        cells = grid.cells.select(*CELL).withColumn("__c", F.expr(f"t div {nt}"))

        def each(t: pa.Table) -> pa.Table:
            t0 = t["__c"][0].as_py() * nt
            f, k = t["freq"].to_numpy(), (t["t"].to_numpy() - t0) // m.nds
            i, w = np.zeros((m.nfreq, nt // m.nds)), np.zeros((m.nfreq, nt // m.nds))
            i[f, k], w[f, k] = t["intensity"].to_numpy(), t["weight"].to_numpy()
            i, w = run_kernel(chain, i, w, m, t0)
            return pa.table([t["t"], t["freq"], pa.array(i[f, k]), pa.array(w[f, k])], names=list(CELL))

        return grid.with_df(cells.groupBy("__c").applyInArrow(each, SCHEMA))

    def apply_packed(self, packed: DataFrame, meta: GridMeta, dtype: str = "<f4", together: bool = False) -> DataFrame:
        """The chain on a packed grid of chunks of nt_chunk samples; arithmetic is in double precision.

        together: the rows of a chunk follow one another in one partition, so nothing is shuffled.
        """
        self.bind(meta)
        n, nt, chain = meta.nfreq, self.nt_chunk, self

        def each(t: pa.Table) -> pa.Table:
            c = t["chunk"][0].as_py()
            f = t["freq"].to_numpy()
            size = nt // meta.nds
            i, w = np.zeros((n, size)), np.zeros((n, size))
            i[f], w[f] = (samples(t[x].combine_chunks(), dtype).reshape(-1, size) for x in ("intensity", "weight"))
            i, w = run_kernel(chain, i, w, meta, c * nt)
            return pa.table([t["chunk"], t["freq"], *(binary(x[f], dtype) for x in (i, w))], names=["chunk", "freq", "intensity", "weight"])

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[pa.RecordBatch] = []
            for b in batches:
                c = b.column(0).to_numpy()
                edges = np.flatnonzero(c[1:] != c[:-1]) + 1
                for a, z in zip([0, *edges], [*edges, len(c)], strict=True):
                    if a == z:
                        continue
                    if kept and kept[0].column(0)[0].as_py() != c[a]:
                        yield from each(pa.Table.from_batches(kept).combine_chunks()).to_batches()
                        kept = []
                    kept.append(b.slice(a, z - a))
            if kept:
                yield from each(pa.Table.from_batches(kept).combine_chunks()).to_batches()

        packed = packed.select("chunk", "freq", "intensity", "weight")
        return packed.mapInArrow(follow, PACKED) if together else packed.groupBy("chunk").applyInArrow(each, PACKED)


def samples(column: pa.Array, dtype: str) -> np.ndarray:
    """All rows' samples, one after the other: the column's own bytes, not copied."""
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype)


def binary(x: np.ndarray, dtype: str) -> pa.Array:
    """Each row's samples as bytes."""
    x = np.ascontiguousarray(x, dtype=dtype)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def pack_cells(grid: Grid, nt_chunk: int, dtype: str = "<f4") -> DataFrame:
    """The packed form; missing cells become 0 with weight 0. A row per channel that has any cell in the chunk."""
    m, size = grid.meta, nt_chunk // grid.meta.nds
    cells = grid.cells.select(*CELL).withColumn("chunk", F.expr(f"t div {nt_chunk}"))

    def each(t: pa.Table) -> pa.Table:
        c = t["chunk"][0].as_py()
        chans, r = np.unique(t["freq"].to_numpy(), return_inverse=True)
        k = (t["t"].to_numpy() - c * nt_chunk) // m.nds
        out = []
        for x in ("intensity", "weight"):
            a = np.zeros((len(chans), size))
            a[r, k] = t[x].to_numpy()
            out.append(binary(a, dtype))
        return pa.table([pa.array(np.full(len(chans), c)), pa.array(chans, pa.int32()), *out], names=["chunk", "freq", "intensity", "weight"])

    return cells.groupBy("chunk").applyInArrow(each, PACKED)


def unpack_cells(packed: DataFrame, meta: GridMeta, nt_chunk: int, dtype: str = "<f4") -> Grid:
    """Cells of a packed grid: no shuffle."""
    size = nt_chunk // meta.nds

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                p = b.slice(at, 1024)
                t = (p.column(0).to_numpy()[:, None] * nt_chunk + np.arange(size) * meta.nds).ravel()
                values = [pa.array(samples(p.column(k), dtype).astype(float)) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.repeat(p.column(1).to_numpy(), size)), *values], names=list(CELL))

    return Grid(packed.select("chunk", "freq", "intensity", "weight").mapInArrow(each, SCHEMA), meta)


@dataclass(frozen=True)
class Packed:
    """A grid as packed chunks of nt_chunk samples. ``nt_end``: the sample behind the stream's last; a chunk's samples from there on are not of the stream."""

    df: DataFrame
    meta: GridMeta
    nt_chunk: int
    nt_end: int
    dtype: str = "<f4"
    #: Whether the rows of a chunk follow one another in one partition.
    together: bool = False

    @staticmethod
    def of(grid: Grid, nt_chunk: int, dtype: str = "<f4") -> Packed:
        """The packed form of cells: one shuffle."""
        end = grid.df.agg(F.max("t")).first()[0]
        return Packed(pack_cells(grid, nt_chunk, dtype), grid.meta, nt_chunk, 0 if end is None else end + grid.meta.nds, dtype)

    def run(self, chain: FusedChain) -> Packed:
        """The chain on every chunk: without a shuffle where a chunk's rows are together, with one of bytes where not."""
        return replace(self, df=chain.apply_packed(self.df, self.meta, self.dtype, self.together), together=True)

    def cells(self) -> Grid:
        """Rows of cells."""
        grid = unpack_cells(self.df, self.meta, self.nt_chunk, self.dtype)
        return grid.with_df(grid.df.where(F.col("t") < self.nt_end))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Parquet of chunks and, beside every row, what ``PackedFileStream`` needs to read them."""
        m = self.meta
        about = {"nfreq": m.nfreq, "nds": m.nds, "freq_lo_MHz": m.freq_lo_MHz, "freq_hi_MHz": m.freq_hi_MHz, "dt_sample": m.dt_sample, "t_initial": m.t_initial, "nt_chunk": self.nt_chunk, "nt_end": self.nt_end, "dtype": self.dtype}
        self.df.withColumns({k: F.lit(v) for k, v in about.items()}).write.mode(mode).parquet(path)


@dataclass
class PackedFileStream(Source):
    """Packed chunks that ``Packed.write`` wrote."""

    filename: str
    class_name = "packed_file_stream"
    has_chunks = True

    def load(self, spark: SparkSession) -> Grid:
        return self.load_packed(spark, 0).cells()

    def load_packed(self, spark: SparkSession, nt_chunk: int) -> Packed:
        """nt_chunk must be that of the files, or 0."""
        rows = spark.read.parquet(self.filename)
        a = rows.drop("chunk", "freq", "intensity", "weight").first()
        if a is None:
            raise ValueError(f"{self.filename} holds no chunks")
        if nt_chunk and nt_chunk != a.nt_chunk:
            raise ValueError(f"{self.filename} has chunks of {a.nt_chunk} samples, not {nt_chunk}")
        meta = GridMeta(a.nfreq, a.nds, a.freq_lo_MHz, a.freq_hi_MHz, a.dt_sample, a.t_initial)
        return Packed(rows.select("chunk", "freq", "intensity", "weight"), meta, a.nt_chunk, a.nt_end, a.dtype)
