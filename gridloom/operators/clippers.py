"""Outlier maskers: intensity, standard deviation, kurtosis."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.keys import axis_keys, check_chunk, chunk_key, freq_key, parse_axis, time_key
from ..functions.resample import check_factors
from ..functions.stats import block_intensity, stats, window_stats
from ..grid import Grid, GridMeta
from .base import Operator


@dataclass
class IntensityClipper(Operator):
    """Mask blocks that lie sigma * rms or more from their group's mean.

    Blocks are Df x Dt weighted means; groups are a sample (axis freq), a channel in a
    chunk (time) or a chunk (none). Mean and rms come from niter passes that clip at
    iter_sigma (0: sigma). A group with rms 0 is masked whole. two_pass is accepted;
    sums are in double precision and taken about the mean in any case.
    """

    nt_chunk: int
    axis: object
    sigma: float
    niter: int = 1
    iter_sigma: float = 0.0
    Df: int = 1  # noqa: N815
    Dt: int = 1  # noqa: N815
    two_pass: bool = False
    class_name = "intensity_clipper"
    in_sub_pipeline = True

    def __post_init__(self) -> None:
        self.axis = parse_axis(self.axis)
        if self.sigma < 1 or self.niter < 1 or (self.iter_sigma and self.iter_sigma < 1):
            raise ValueError("sigma, iter_sigma and niter must be at least 1")

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_factors(meta, self.Df, self.Dt)
        if self.axis != "freq" or self.nt_chunk:
            check_chunk(meta, self.nt_chunk, self.Dt)
        return meta

    def kernel(self, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
        return i, blocks.clip(i, w, self.axis, self.nt_chunk // meta.nds, self.sigma, self.niter, self.iter_sigma or self.sigma, self.Df, self.Dt)

    def group_cells(self, meta: GridMeta) -> int:
        per_chunk = self.nt_chunk // meta.nds
        return {"freq": meta.nfreq * self.Dt, "time": per_chunk * self.Df, "none": per_chunk * meta.nfreq}[self.axis]

    def apply(self, grid: Grid) -> Grid:
        m = grid.meta
        df, keys = axis_keys(grid.df, m, self.axis, self.nt_chunk, self.Df, self.Dt)
        df = block_intensity(df, m, keys, self.Df, self.Dt)
        df = stats(df, keys, self.group_cells(m), self.niter, self.iter_sigma or self.sigma, i="__i")
        keep = F.abs(F.col("__i") - F.col("__mean")) < self.sigma * F.col("__rms")
        return grid.with_df(df.withColumn("weight", F.when(keep, F.col("weight")).otherwise(0.0)).drop("__i", "__mean", "__rms"))


@dataclass
class StdDevClipper(Operator):
    """Mask rows whose variance is an outlier among the chunk's rows.

    A row is a channel in a chunk (axis time) or a sample (freq), of Df x Dt blocks.
    Rows without a variance are masked too. The second level runs over one number per
    row; only that small table is joined back.
    """

    nt_chunk: int
    axis: object
    sigma: float
    Df: int = 1  # noqa: N815
    Dt: int = 1  # noqa: N815
    two_pass: bool = False
    class_name = "std_dev_clipper"
    in_sub_pipeline = True

    def __post_init__(self) -> None:
        self.axis = parse_axis(self.axis)
        if self.axis == "none":
            raise ValueError("axis must be freq or time")
        if self.sigma < 1:
            raise ValueError("sigma must be at least 1")

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_factors(meta, self.Df, self.Dt)
        check_chunk(meta, self.nt_chunk, self.Dt)
        return meta

    def kernel(self, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
        return i, blocks.std_dev_clip(i, w, self.axis, self.nt_chunk // meta.nds, self.sigma, self.Df, self.Dt)

    def apply(self, grid: Grid) -> Grid:
        m = grid.meta
        df, c = chunk_key(grid.df, self.nt_chunk)
        df, row = freq_key(df, self.Df) if self.axis == "time" else time_key(df, m, self.Dt)
        keys = [c, row]
        df = block_intensity(df, m, keys, self.Df, self.Dt)
        df = window_stats(df, keys, i="__i")
        # the window's partitioning serves this aggregation and the join
        rows = df.groupBy(*keys).agg(F.first("__rms").alias("rms"))
        rows = rows.select(*keys, (F.col("rms") * F.col("rms")).alias("sd"), F.when(F.col("rms") > 0, 1.0).otherwise(0.0).alias("sdw"))
        rows = window_stats(rows, [c], i="sd", w="sdw", prefix="__r")
        keep = (F.col("sdw") > 0) & (F.abs(F.col("sd") - F.col("__rmean")) < self.sigma * F.col("__rrms"))
        rows = rows.where(keep).select(*keys, F.lit(True).alias("__keep"))
        df = df.drop("__i", "__mean", "__rms").join(rows, keys, "left")
        return grid.with_df(df.withColumn("weight", F.when(F.col("__keep"), F.col("weight")).otherwise(0.0)).drop("__keep"), branches=grid.branches + 1)


@dataclass
class KurtosisFilter(Operator):
    """Mask a channel in a chunk if the excess kurtosis of its unmasked samples is outside [low, high].

    A kurtosis that is not finite counts as -4.
    """

    thr: tuple = (-1.0, 1.0)
    nt_chunk: int = 1024
    class_name = "kurtosis_filter"

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_chunk(meta, self.nt_chunk)
        return meta

    def apply(self, grid: Grid) -> Grid:
        df, keys = axis_keys(grid.df, grid.meta, "time", self.nt_chunk)
        k = F.kurtosis(F.when(F.col("weight") > 0, F.col("intensity"))).over(Window.partitionBy(*keys))
        k = F.when(k.isNull() | F.isnan(k) | (F.abs(k) == float("inf")), -4.0).otherwise(k)
        low, high = self.thr
        df = df.withColumn("__k", k)
        return grid.with_df(df.withColumn("weight", F.when(F.col("__k").between(low, high), F.col("weight")).otherwise(0.0)).drop("__k"))

