"""Packets: intensities and a boolean mask, per group of coarse channels and run of samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, GridMeta
from ..operators.base import Operator
from ..sources.synthetic import SECONDS_PER_COUNT

COARSE = 1024


def packets(grid: Grid, nfreq_coarse_per_packet: int, nt_per_packet: int, wt_cutoff: float, coarse: int = COARSE) -> DataFrame:
    """(t0, f0, n, unmasked, data): a packet's cells as an array of (freq, t, intensity, keep), channel by channel."""
    m = grid.meta
    width = m.nfreq // coarse * nfreq_coarse_per_packet
    cells = grid.cells.select(F.expr(f"t div {nt_per_packet * m.nds} * {nt_per_packet * m.nds}").alias("t0"), F.expr(f"cast(freq div {width} * {width} as int)").alias("f0"), F.struct("freq", "t", F.col("intensity").cast("float").alias("intensity"), (F.col("weight") >= wt_cutoff).alias("keep")).alias("x"))
    got = cells.groupBy("t0", "f0").agg(F.sort_array(F.collect_list("x")).alias("data"))
    return got.select("t0", "f0", F.size("data").alias("n"), F.size(F.filter("data", lambda x: x["keep"])).alias("unmasked"), "data")


@dataclass
class Packetizer(Operator):
    """Cut the grid into packets: output ``packets``. ``send`` gets each partition's rows on the executors, if given."""

    dstname: str
    nfreq_coarse_per_packet: int
    nt_per_chunk: int
    nt_per_packet: int
    wt_cutoff: float
    target_gbps: float = 0.0
    beam_id: int = 0
    coarse: int = COARSE
    send: Callable | None = None

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("dt_sample")
        counts = meta.dt_sample / SECONDS_PER_COUNT
        if meta.nfreq % self.coarse or self.coarse % self.nfreq_coarse_per_packet:
            raise ValueError(f"nfreq must be a multiple of {self.coarse}, and that of nfreq_coarse_per_packet")
        if abs(counts - round(counts)) > 1e-3:
            raise ValueError("dt_sample must be a whole number of raw counts")
        if self.nt_per_chunk % self.nt_per_packet:
            raise ValueError("nt_per_packet must divide nt_per_chunk")
        return meta

    def apply(self, grid: Grid) -> Grid:
        out = packets(grid, self.nfreq_coarse_per_packet, self.nt_per_packet, self.wt_cutoff, self.coarse)
        if self.send is not None:
            out.foreachPartition(self.send)
        return grid.with_output("packets", out)

    def jsonize(self) -> dict:
        raise TypeError("a packetizer has no JSON form")
