"""Downsampling and upsampling of grids, maximum pooling, zoom pyramids, packed masks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid, GridMeta


def check_factors(meta: GridMeta, Df: int, Dt: int) -> None:  # noqa: N803
    if Df < 1 or Dt < 1 or meta.nfreq % Df:
        raise ValueError(f"Df={Df} must divide nfreq={meta.nfreq}, and Dt={Dt} be positive")


def downsample(grid: Grid, Df: int = 1, Dt: int = 1, weights: str = "sum") -> Grid:  # noqa: N803
    """Weighted block means over Df channels by Dt samples; weights summed, or averaged over the block's full size.

    One aggregation with map-side combine; a bin keeps its first native sample.
    """
    m = grid.meta
    check_factors(m, Df, Dt)
    if weights not in ("sum", "mean"):
        raise ValueError("weights must be 'sum' or 'mean'")
    k = Dt * m.nds
    total = F.sum("weight")
    mean = F.when(total > 0, F.sum(F.col("weight") * F.col("intensity")) / total).otherwise(0.0)
    out = grid.cells.groupBy(F.expr(f"t div {k} * {k}").alias("t"), F.expr(f"cast(freq div {Df} as int)").alias("freq")).agg(
        mean.alias("intensity"), (total if weights == "sum" else total / (Df * Dt)).alias("weight")
    )
    return grid.with_df(out, meta=replace(m, nfreq=m.nfreq // Df, nds=k), branches=grid.branches + 1)


def upsample_weights(fine: Grid, coarse: Grid, w_cutoff: float = 0.0) -> DataFrame:
    """Fine cells, with weight 0 where the coarse weight is at or below w_cutoff or missing: one equi-join."""
    Df, Dt = fine.meta.nfreq // coarse.meta.nfreq, coarse.meta.nds // fine.meta.nds  # noqa: N806
    if fine.meta.nfreq != Df * coarse.meta.nfreq or coarse.meta.nds != Dt * fine.meta.nds:
        raise ValueError("the coarse grid's resolution must divide the fine one's")
    k = coarse.meta.nds
    low = coarse.cells.where(F.col("weight") > w_cutoff).select(F.col("t").alias("__lt"), F.col("freq").alias("__lf"), F.lit(True).alias("__keep"))
    high = fine.cells.withColumns({"__lt": F.expr(f"t div {k} * {k}"), "__lf": F.expr(f"cast(freq div {Df} as int)")})
    out = high.join(low, ["__lt", "__lf"], "left")
    return out.withColumn("weight", F.when(F.col("__keep"), F.col("weight")).otherwise(0.0)).drop("__lt", "__lf", "__keep")


def upsample(coarse: Grid, Df: int, Dt: int) -> Grid:  # noqa: N803
    """Every coarse cell repeated over Df channels by Dt samples: no shuffle."""
    m = coarse.meta
    if m.nds % Dt:
        raise ValueError("Dt must divide nds")
    nds = m.nds // Dt
    out = coarse.cells.withColumn("__dt", F.explode(F.sequence(F.lit(0), F.lit(Dt - 1)))).withColumn("__df", F.explode(F.sequence(F.lit(0), F.lit(Df - 1))))
    out = out.withColumns({"t": (F.col("t") + F.col("__dt") * nds).cast("long"), "freq": (F.col("freq") * Df + F.col("__df")).cast("int")}).drop("__dt", "__df")
    return coarse.with_df(out, meta=replace(m, nfreq=m.nfreq * Df, nds=nds))


def max_pool(df: DataFrame, value: str, bins: dict[str, int]) -> DataFrame:
    """The maximum of value over bins of integer columns; ties and order do not matter."""
    return df.groupBy(*[F.expr(f"{c} div {n}").alias(c) for c, n in bins.items()]).agg(F.max(value).alias(value))


def expand(df: DataFrame, keys: list[str], value: str, how: str = "sum") -> DataFrame:
    """df with ``expanded``: an aggregate of value along the axis that keys leave out, repeated on every cell."""
    return df.withColumn("expanded", getattr(F, how)(value).over(Window.partitionBy(*keys)))


def zoom_pyramid(grid: Grid, nzoom: int) -> DataFrame:
    """(zoom, t, freq, intensity, weight): level z is coarser by 2^z in time.

    Each level aggregates the one before, which is half as long; sums make that exact.
    """
    m = grid.meta
    level = grid.cells.select(F.lit(0).alias("zoom"), F.expr(f"t div {m.nds}").alias("tb"), "freq", F.col("weight").alias("w"), (F.col("weight") * F.col("intensity")).alias("wi"))
    out = None
    for z in range(nzoom):
        if z:
            level = level.groupBy(F.expr("tb div 2").alias("tb"), "freq").agg(F.sum("w").alias("w"), F.sum("wi").alias("wi")).withColumn("zoom", F.lit(z))
        here = level.select("zoom", (F.col("tb") * (m.nds << z)).alias("t"), "freq", F.when(F.col("w") > 0, F.col("wi") / F.col("w")).otherwise(0.0).alias("intensity"), F.col("w").alias("weight"))
        out = here if out is None else out.unionByName(here)
    return out


def pack_mask(grid: Grid) -> DataFrame:
    """(t8, freq, bits): the mask, 8 samples to a number; bit j is 1 if sample j has weight."""
    on = grid.cells.where("weight > 0").withColumn("s", F.expr(f"t div {grid.meta.nds}"))
    return on.groupBy(F.expr("s div 8").alias("t8"), "freq").agg(F.bit_or(F.expr("shiftleft(1, cast(s % 8 as int))")).alias("bits"))


def unpack_mask(packed: DataFrame, nds: int = 1) -> DataFrame:
    """(t, freq) of the samples whose bit is 1."""
    out = packed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7)))).where("(shiftright(bits, j) & 1) = 1")
    return out.select(((F.col("t8") * 8 + F.col("j")) * nds).cast("long").alias("t"), "freq")
