"""Analyzers: spectra, stripes, variances, waterfall tiles. Grids pass unchanged; results are outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colours import colour_tiles
from ..functions.keys import check_chunk
from ..functions.resample import downsample, zoom_pyramid
from ..grid import Grid, GridMeta
from .base import Operator
from .masks import UPFREQ


def median_if(value: str, valid: str, more_than: int) -> Column:
    """The exact median of valid values if there are more than so many, else 0."""
    ok = F.col(valid) > 0
    return F.when(F.count_if(ok) > more_than, F.median(F.when(ok, F.col(value)))).otherwise(0.0)


@dataclass
class SpectrumAnalyzer(Operator):
    """Output ``spectrum``: (chunk, freq, value), the median over Dt2 samples of the Dt1-downsampled intensity."""

    Dt1: int = 16  # noqa: N815
    Dt2: int = 16  # noqa: N815
    class_name = "spectrum_analyzer"

    def apply(self, grid: Grid) -> Grid:
        chunk = self.Dt1 * self.Dt2
        low = downsample(grid, 1, self.Dt1).df
        out = low.groupBy(F.expr(f"t div {chunk}").alias("chunk"), "freq").agg(median_if("intensity", "weight", self.Dt2 // 4).alias("value"))
        return grid.with_output("spectrum", out)


@dataclass
class StripeAnalyzer(Operator):
    """Output ``stripes``: (chunk, block, u, value), the ripple's shape.

    Fine channels over their coarse channel's mean, with u = channel mod 16; value is
    the median over Df2 coarse channels by Dt2 samples of Dt1-downsampled intensity.
    """

    Dt1: int = 16  # noqa: N815
    Df2: int = 16  # noqa: N815
    Dt2: int = 16  # noqa: N815
    class_name = "chime_16k_stripe_analyzer"

    def _bind(self, meta: GridMeta) -> GridMeta:
        if meta.nfreq % (UPFREQ * self.Df2):
            raise ValueError(f"nfreq must be a multiple of {UPFREQ} * Df2")
        return meta

    def apply(self, grid: Grid) -> Grid:
        chunk = self.Dt1 * self.Dt2
        fine = downsample(grid, 1, self.Dt1).df.withColumn("fc", F.expr(f"freq div {UPFREQ}"))
        # all fine channels of a coarse cell are in one group: its mean needs no second scan of the cells
        group = fine.groupBy("t", "fc").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("intensity")).alias("wi"), F.collect_list(F.struct("freq", "intensity", "weight")).alias("fine"))
        coarse = F.when(F.col("w") > 0, F.col("wi") / F.col("w")).otherwise(0.0)
        rows = group.withColumn("coarse", coarse).withColumn("x", F.explode("fine")).select("t", "fc", "coarse", "x.*")
        ok = (F.col("coarse") > 0) & (F.col("weight") > 0)
        rows = rows.select(F.expr(f"t div {chunk}").alias("chunk"), F.expr(f"fc div {self.Df2}").alias("block"), (F.col("freq") % UPFREQ).alias("u"), F.when(ok, F.col("intensity") / F.col("coarse")).alias("ratio"), F.when(ok, 1.0).otherwise(0.0).alias("valid"))
        out = rows.groupBy("chunk", "block", "u").agg(median_if("ratio", "valid", self.Df2 * self.Dt2 // 4).alias("value"))
        return grid.with_output("stripes", out)


def variance_v1(grid: Grid, v1_chunk: int) -> DataFrame:
    """(v1_idx, freq, v1): the weighted mean square per block of v1_chunk samples; 0 if under a quarter have weight."""
    m = grid.meta
    total = F.sum("weight")
    mean = F.sum(F.col("weight") * F.col("intensity") * F.col("intensity")) / F.when(total > 0, total).otherwise(1.0)
    v1 = F.when(F.count_if(F.col("weight") != 0) >= 0.25 * v1_chunk, mean).otherwise(0.0)
    return grid.cells.groupBy(F.expr(f"t div {v1_chunk * m.nds}").alias("v1_idx"), "freq").agg(v1.alias("v1"))


def variance_v2(v1: DataFrame, v2_chunk: int, last_v1: int) -> DataFrame:
    """(v2_idx, freq, variance): the median of nonzero v1 per v2_chunk blocks; 0 if under a quarter are nonzero.

    Groups that would end after block last_v1 are incomplete and dropped.
    """
    some = F.col("v1") != 0
    value = F.when(F.count_if(some) >= 0.25 * v2_chunk, F.median(F.when(some, F.col("v1")))).otherwise(0.0)
    whole = v1.where(F.expr(f"(v1_idx div {v2_chunk} + 1) * {v2_chunk}") <= last_v1)
    return whole.groupBy(F.expr(f"v1_idx div {v2_chunk}").alias("v2_idx"), "freq").agg(F.coalesce(value, F.lit(0.0)).alias("variance"))


@dataclass
class VarianceEstimator(Operator):
    """Output ``variance``: (freq, v2_idx, time, variance); a path also gets it as Parquet.

    time is that of the middle of the group of v2_chunk blocks of v1_chunk samples.
    nt_total is the stream's length in samples; None asks the data for its last sample.
    """

    var_filename: str = ""
    v1_chunk: int = 128
    v2_chunk: int = 80
    nt_chunk: int = 1024
    nt_total: int | None = None
    class_name = "variance_estimator"

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("dt_sample", "t_initial")
        check_chunk(meta, self.nt_chunk)
        if self.nt_chunk % self.v1_chunk:
            raise ValueError("nt_chunk must be a multiple of v1_chunk")
        return meta

    def apply(self, grid: Grid) -> Grid:
        m = grid.meta
        # a stream ends with a whole chunk: its tail is padded with weight 0
        last = grid.df.agg(F.max("t")).first()[0] if self.nt_total is None else self.nt_total - 1
        end = 0 if last is None else last + 1
        last_v1 = -(-end // self.nt_chunk) * self.nt_chunk // self.v1_chunk
        out = variance_v2(variance_v1(grid, self.v1_chunk), self.v2_chunk, last_v1)
        per = self.v1_chunk * self.v2_chunk
        out = out.select("freq", "v2_idx", ((F.col("v2_idx") + 0.5) * (per * m.dt_sample) + m.t_initial).alias("time"), "variance")
        if self.var_filename:
            out.write.mode("errorifexists").parquet(self.var_filename)
        return grid.with_output("variance", out)


@dataclass
class PlotterTransform(Operator):
    """Output ``tiles``: (zoom, tile, x, y, intensity, weight, red, green, blue), a waterfall in tiles of img_nt columns.

    Pixels are weighted means of nfreq / img_nfreq channels by downsample_nt * 2^zoom
    samples; colours follow each tile's clipped statistics.
    """

    img_prefix: str
    img_nfreq: int
    img_nt: int
    downsample_nt: int = 1
    n_zoom: int = 1
    nt_chunk: int = 0
    clip_niter: int = 3
    sigma_clip: float = 3.0
    class_name = "plotter_transform"

    def _bind(self, meta: GridMeta) -> GridMeta:
        if meta.nfreq % self.img_nfreq:
            raise ValueError("img_nfreq must divide nfreq")
        return meta

    def apply(self, grid: Grid) -> Grid:
        low = downsample(grid, grid.meta.nfreq // self.img_nfreq, self.downsample_nt)
        px = zoom_pyramid(low, self.n_zoom)
        column = F.expr(f"t div ({low.meta.nds} * shiftleft(1L, zoom))")
        px = px.withColumn("column", column).select("zoom", F.expr(f"column div {self.img_nt}").alias("tile"), F.expr(f"cast(column % {self.img_nt} as int)").alias("x"), F.col("freq").alias("y"), "intensity", "weight")
        return grid.with_output(f"tiles_{self.img_prefix}", colour_tiles(px, ["zoom", "tile"], self.clip_niter, self.sigma_clip))
