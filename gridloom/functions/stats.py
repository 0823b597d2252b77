"""Weighted mean and rms with iterated clipping, by windows or by two-phase aggregation.

Pass p clips what lies sigma * rms or more from the mean of pass p - 1. A variance not
above 1e-10 * mean^2 counts as 0, and so does the rms of a group without weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import GridMeta
from ..storage import cut
from .keys import freq_key, time_key

#: Groups of up to this many cells are windows (one shuffle, one sort, one task each); larger ones are aggregated in two phases.
GROUP_CELLS = 1 << 22
RELATIVE_VARIANCE = 1e-10


def safe_rms(var: Column, mean: Column, total: Column) -> Column:
    return F.when((total > 0) & (var > RELATIVE_VARIANCE * mean * mean), F.sqrt(var)).otherwise(F.lit(0.0))


def check_sigma(sigma: float, niter: int) -> None:
    if sigma < 1 or niter < 1:
        raise ValueError("sigma must be at least 1 and niter at least 1")


def window_stats(df: DataFrame, keys: list[str], niter: int = 1, sigma: float = 3.0, i: str = "intensity", w: str = "weight", prefix: str = "__") -> DataFrame:
    """df with columns {prefix}mean and {prefix}rms of each cell's group.

    All passes share one partitioning and one sort: every window has the same key.
    """
    check_sigma(sigma, niter)
    over = Window.partitionBy(*keys)
    mean, rms, wp, total, sq = (f"{prefix}{x}" for x in ("mean", "rms", "w", "sum", "sq"))
    df = df.withColumn(wp, F.col(w))
    for p in range(niter):
        if p:
            df = df.withColumn(wp, F.when(F.abs(F.col(i) - F.col(mean)) < sigma * F.col(rms), F.col(wp)).otherwise(F.lit(0.0)))
        df = df.withColumns({total: F.sum(wp).over(over), mean: F.sum(F.col(wp) * F.col(i)).over(over)})
        one = F.when(F.col(total) > 0, F.col(total)).otherwise(F.lit(1.0))
        df = df.withColumn(mean, F.col(mean) / one)
        df = df.withColumn(sq, F.sum(F.col(wp) * (F.col(i) - F.col(mean)) * (F.col(i) - F.col(mean))).over(over))
        df = df.withColumn(rms, safe_rms(F.col(sq) / one, F.col(mean), F.col(total)))
    return df.drop(wp, total, sq)


def group_stats(df: DataFrame, keys: list[str], niter: int = 1, sigma: float = 3.0, i: str = "intensity", w: str = "weight", cut_passes: bool = False) -> DataFrame:
    """(keys, mean, rms, total): one row per group, whatever the groups' sizes.

    Each pass is one aggregation with map-side combine. Squares are taken about the
    mean of the pass before, and corrected, so that one aggregation gives both moments
    without cancellation. With cut_passes each pass's small result is written, and df is
    read niter + 1 times; without, every pass repeats the ones before it.
    """
    check_sigma(sigma, niter)
    base = df.select(*keys, F.col(i).alias("i"), F.col(w).alias("w"))
    got = base.groupBy(*keys).agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("i")).alias("s"))
    got = got.select(*keys, "total", (F.col("s") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)).alias("mean"), F.lit(None).cast("double").alias("rms"))
    for p in range(niter):
        base = base.join(got.select(*keys, "mean", "rms"), keys)
        if p:  # clipped weights stay clipped: the passes' conditions add up in base
            base = base.withColumn("w", F.when(F.abs(F.col("i") - F.col("mean")) < sigma * F.col("rms"), F.col("w")).otherwise(0.0))
        d = F.col("i") - F.col("mean")
        one = F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
        got = base.groupBy(*keys).agg(F.sum("w").alias("total"), F.sum(F.col("w") * d).alias("s"), F.sum(F.col("w") * d * d).alias("sq"), F.first("mean").alias("c"))
        base = base.drop("mean", "rms")
        # total == 0: the mean of a group without weight is 0
        got = got.withColumn("shift", F.col("s") / one).withColumn("mean", F.when(F.col("total") > 0, F.col("c") + F.col("shift")).otherwise(0.0))
        got = got.select(*keys, "total", "mean", safe_rms(F.col("sq") / one - F.col("shift") * F.col("shift"), F.col("mean"), F.col("total")).alias("rms"))
        got = cut(got) if cut_passes and p < niter - 1 else got
    return got


def stats(df: DataFrame, keys: list[str], group_cells: int, niter: int = 1, sigma: float = 3.0, i: str = "intensity", w: str = "weight") -> DataFrame:
    """df with __mean and __rms: by windows if groups are of at most GROUP_CELLS cells, else by aggregation and a join."""
    if group_cells <= GROUP_CELLS:
        return window_stats(df, keys, niter, sigma, i, w)
    df = cut(df)
    got = group_stats(df, keys, niter, sigma, i, w, cut_passes=True).select(*keys, F.col("mean").alias("__mean"), F.col("rms").alias("__rms"))
    return df.join(got, keys)


def block_intensity(df: DataFrame, meta: GridMeta, keys: list[str], Df: int, Dt: int) -> DataFrame:  # noqa: N803
    """df with ``__i``: the weighted mean of each cell's Df x Dt block, 0 without weight.

    Statistics over blocks with summed weights equal those over cells with the cells'
    weights and ``__i``, so nothing has to be joined back. df is dealt out by the
    statistics' keys first, which a block's cells share: the windows need no shuffle.
    """
    if Df == Dt == 1:
        return df.withColumn("__i", F.col("intensity"))
    df, fb = freq_key(df, Df)
    df, tb = time_key(df, meta, Dt)
    by = [*keys, *[k for k in (fb, tb) if k not in keys]]
    over = Window.partitionBy(*by)
    df = df.repartition(*keys).withColumns({"__bw": F.sum("weight").over(over), "__i": F.sum(F.col("weight") * F.col("intensity")).over(over)})
    return df.withColumn("__i", F.when(F.col("__bw") > 0, F.col("__i") / F.col("__bw")).otherwise(0.0)).drop("__bw")


def weighted_mean_and_rms(df: DataFrame, keys: list[str], niter: int = 1, sigma: float = 3.0) -> DataFrame:
    """(keys, mean, rms, total) of a table of cells, as a function; no keys: one row for all."""
    if keys:
        return group_stats(df, keys, niter, sigma)
    return group_stats(df.withColumn("__all", F.lit(0)), ["__all"], niter, sigma).drop("__all")
