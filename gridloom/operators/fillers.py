"""Fillers: masked samples replaced by noise of a known or a running variance."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import check_chunk, chunk_key
from ..functions.noise import gaussian, uniform
from ..grid import Grid, GridMeta
from .analyzers import variance_v1
from .base import Operator


def interpolate_zeros(variance: DataFrame) -> DataFrame:
    """variance (freq, v2_idx, time, variance) with zeros interpolated by index per channel.

    A channel with under a quarter of nonzero values becomes 0 throughout; beyond the
    outermost nonzero values the nearest one holds.
    """
    by = Window.partitionBy("freq").orderBy("v2_idx")
    every = Window.partitionBy("freq")
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("variance") != 0, F.struct("v2_idx", "variance"))
    df = variance.withColumns({
        "__lo": F.last(point, ignorenulls=True).over(before),
        "__hi": F.first(point, ignorenulls=True).over(after),
        "__enough": F.count_if(F.col("variance") != 0).over(every) >= 0.25 * F.count(F.lit(1)).over(every),
    })
    lo, hi = F.coalesce("__lo", "__hi"), F.coalesce("__hi", "__lo")
    share = F.when(hi["v2_idx"] > lo["v2_idx"], (F.col("v2_idx") - lo["v2_idx"]) / (hi["v2_idx"] - lo["v2_idx"])).otherwise(0.0)
    value = F.when(F.col("__enough") & lo.isNotNull(), lo["variance"] + share * (hi["variance"] - lo["variance"])).otherwise(0.0)
    return df.select("freq", "v2_idx", "time", value.alias("variance"))


def evaluate(variance: DataFrame, when: DataFrame) -> DataFrame:
    """when (freq, ts, ...) with ``v``: the channel's variance, linear in time and clamped at the ends.

    An as-of join as a union: knots and questions of a channel are sorted together once,
    and each question takes the knots before and after it.
    """
    extra = [c for c in when.columns if c not in ("freq", "ts")]
    knots = variance.select("freq", F.col("time").alias("ts"), F.struct(F.col("time").alias("x"), F.col("variance").alias("y")).alias("__k"), *[F.lit(None).cast(when.schema[c].dataType).alias(c) for c in extra])
    asks = when.select("freq", "ts", F.lit(None).cast("struct<x:double,y:double>").alias("__k"), *extra)
    by = Window.partitionBy("freq").orderBy("ts")
    both = knots.unionByName(asks).withColumns({
        # RANGE frames: a knot at the very time of a question is seen from both sides
        "__lo": F.last("__k", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0)),
        "__hi": F.first("__k", ignorenulls=True).over(by.rangeBetween(0, Window.unboundedFollowing)),
    })
    lo, hi = F.coalesce("__lo", "__hi"), F.coalesce("__hi", "__lo")
    share = F.when(hi["x"] > lo["x"], (F.col("ts") - lo["x"]) / (hi["x"] - lo["x"])).otherwise(0.0)
    return both.where("__k IS NULL").select("freq", "ts", *extra, (lo["y"] + share * (hi["y"] - lo["y"])).alias("v"))


def variance_at(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The variance table at a path, with zeros interpolated."""
    return interpolate_zeros(spark.read.parquet(path))


def compare_variances(a: DataFrame, b: DataFrame, factor: int, floor: float = 1e-5) -> DataFrame:
    """(freq, v2_idx, ratio): a over b, where one value of b stands for factor values of a; both are at least floor."""
    wide = a.select("freq", "v2_idx", F.expr(f"v2_idx div {factor}").alias("__b"), F.col("variance").alias("x"))
    right = b.select("freq", F.col("v2_idx").alias("__b"), F.col("variance").alias("y"))
    return wide.join(right, ["freq", "__b"]).select("freq", "v2_idx", (F.greatest("x", F.lit(floor)) / F.greatest("y", F.lit(floor))).alias("ratio"))


@dataclass
class MaskFiller(Operator):
    """Replace samples of weight at most w_cutoff by noise of the channel's variance at the chunk's middle.

    Every sample's weight becomes 2 if that variance is positive, else 0. The grid must
    be dense where filling is wanted (see ``densify``). A variance of (chunk, channel) is
    looked up once and joined.
    """

    var_file: str
    w_cutoff: float
    nt_chunk: int = 1024
    seed: int = 0
    variance: DataFrame | None = None
    class_name = "mask_filler"

    def jsonize(self) -> dict:
        return {"class_name": self.class_name, "var_file": self.var_file, "w_cutoff": self.w_cutoff, "nt_chunk": self.nt_chunk, "seed": self.seed}

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("t_initial", "dt_sample")
        check_chunk(meta, self.nt_chunk)
        return meta

    def apply(self, grid: Grid) -> Grid:
        m = grid.meta
        table = interpolate_zeros(self.variance) if self.variance is not None else variance_at(grid.df.sparkSession, self.var_file)
        df, c = chunk_key(grid.df, self.nt_chunk)
        middle = m.t_initial + m.dt_sample * (F.col(c) + 0.5) * self.nt_chunk
        asks = df.select(c, "freq").distinct().withColumn("ts", middle)
        df = df.join(evaluate(table, asks).select("freq", c, F.col("v").alias("__v")), ["freq", c], "left").withColumn("__v", F.coalesce("__v", F.lit(0.0)))
        noise = gaussian(self.seed, F.col("t"), F.col("freq")) * F.when(F.col("__v") > 0, F.sqrt("__v")).otherwise(1.0)
        df = df.withColumns({"intensity": F.when(F.col("weight") > self.w_cutoff, F.col("intensity")).otherwise(noise), "weight": F.when(F.col("__v") > 0, 2.0).otherwise(0.0)})
        return grid.with_df(df.drop("__v"), branches=grid.branches + 1)


@dataclass
class NoiseFiller(Operator):
    """Replace intensities by noise whose scale starts at random per channel and grows by increment per chunk.

    Output ``noise_variance``: (chunk, freq, variance), the variances used.
    """

    nt_chunk: int = 512
    increment: float = 0.1
    seed: int = 0
    class_name = "noise_filler"

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_chunk(meta, self.nt_chunk)
        return meta

    def apply(self, grid: Grid) -> Grid:
        df, c = chunk_key(grid.df, self.nt_chunk)
        scale = (uniform(self.seed, F.col("freq")) + 0.01) * 2 + F.col(c) * self.increment
        used = df.select(F.col(c).alias("chunk"), "freq", scale.alias("s")).distinct().select("chunk", "freq", (F.col("s") * F.col("s")).alias("variance"))
        noise = gaussian(self.seed + 1, F.col("t"), F.col("freq")) * scale
        return grid.with_df(df.withColumn("intensity", noise)).with_output("noise_variance", used)


def clamp_step(var: float, weight: float, v1: float, p: OnlineMaskFiller) -> tuple[float, float]:
    """Running variance and weight after a block whose estimate is v1 (0: there is none)."""
    if v1 == 0:
        return var, max(0.0, weight - p.w_clamp)
    step = p.var_clamp_add + var * p.var_clamp_mult
    return max(min((1 - p.var_weight) * var + p.var_weight * v1, var + step), var - step), min(2.0, weight + p.w_clamp)


@dataclass
class OnlineMaskFiller(Operator):
    """Fill masked samples with noise of a running, clamped variance per channel; weights follow how often it could be estimated.

    The estimates are aggregated first: one number per v1_chunk samples. Only these are
    chained per channel; cells are filled by a join with the chained table.
    """

    v1_chunk: int = 32
    var_weight: float = 2e-3
    var_clamp_add: float = 3.3e-3
    var_clamp_mult: float = 3.3e-3
    w_clamp: float = 3.3e-3
    w_cutoff: float = 0.5
    nt_chunk: int = 1024
    seed: int = 0
    class_name = "online_mask_filler"

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_chunk(meta, self.nt_chunk)
        if self.nt_chunk % self.v1_chunk:
            raise ValueError("nt_chunk must be a multiple of v1_chunk")
        return meta

    def states(self, v1: DataFrame) -> DataFrame:
        """(v1_idx, freq, var, w) from (v1_idx, freq, v1); blocks that are missing between a channel's rows count as without estimate."""
        p = self

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("v1_idx", kind="stable")
            var = w = 0.0
            last = -1
            out = []
            for k, v in zip(pdf["v1_idx"].tolist(), pdf["v1"].tolist(), strict=True):
                w = max(0.0, w - (k - last - 1) * p.w_clamp)
                var, w = clamp_step(var, w, v, p)
                last = k
                out.append((var, w))
            res = pdf[["v1_idx", "freq"]].copy()
            res["var"], res["w"] = [a for a, _ in out], [b for _, b in out]
            return res

        return v1.groupBy("freq").applyInPandas(chain, "v1_idx long, freq int, var double, w double")

    def fill(self, df: DataFrame, states: DataFrame) -> DataFrame:
        df = df.withColumn("__v1", F.expr(f"t div {self.v1_chunk}"))
        df = df.join(states.select(F.col("v1_idx").alias("__v1"), "freq", F.col("var").alias("__var"), F.col("w").alias("__w")), ["__v1", "freq"])
        noise = gaussian(self.seed, F.col("t"), F.col("freq")) * F.when(F.col("__var") > 0, F.sqrt("__var")).otherwise(1.0)
        return df.withColumns({"intensity": F.when(F.col("weight") > self.w_cutoff, F.col("intensity")).otherwise(noise), "weight": F.col("__w")}).drop("__v1", "__var", "__w")

    def apply(self, grid: Grid) -> Grid:
        return grid.with_df(self.fill(grid.df, self.states(variance_v1(grid, self.v1_chunk))), branches=grid.branches + 1)
