"""Masks by rule: bad channels, spikes, rectangles, growth of masks, counters, weights by noise."""

from __future__ import annotations

import csv
import math
import random
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import axis_keys, check_chunk, chunk_key, parse_axis
from ..functions.noise import uniform
from ..functions.numbers import round_up
from ..grid import Grid, GridMeta
from .base import Operator

#: The shape of the band's ripple over the 16 fine channels of a coarse one.
RIPPLE = (1.28255845837, 1.25644862084, 1.19869285334, 1.10585973916, 0.982096806832, 0.844561662108, 0.722474301172, 0.648123020509, 0.643478657879, 0.709964838879, 0.827771489632, 0.965153033863, 1.09186607691, 1.18902487817, 1.25106135586, 1.28086420647)
UPFREQ = 16
#: Ranges of channels up to this many are sent to every task; there can't be more than channels.
BROADCAST_ROWS = 50_000


def read_ranges(path: str) -> list[tuple[float, float]]:
    """(low, high) MHz of every row of a text file; # begins a comment."""
    with open(path, encoding="utf-8") as f:
        rows = [r for r in csv.reader(line.partition("#")[0].strip() for line in f) if r]
    out = [(float(a), float(b)) for a, b in rows]
    return out


def channel_ranges(ranges: list[tuple[float, float]], meta: GridMeta) -> list[tuple[int, int]]:
    """Half-open channel ranges that frequency ranges touch; channel 0 is the band's top."""
    meta.need("freq_lo_MHz", "freq_hi_MHz")
    bottom, top = meta.freq_lo_MHz, meta.freq_hi_MHz
    per_mhz = meta.nfreq / (top - bottom)
    out = []
    for low, high in ranges:
        if low >= high:
            raise ValueError(f"range ({low}, {high}) is empty")
        if high <= bottom or low >= top:
            raise ValueError(f"range ({low}, {high}) is outside the band")
        if low < bottom and high > top:
            raise ValueError(f"range ({low}, {high}) contains the whole band")
        first = math.floor((top - min(high, top)) * per_mhz + 1e-3)
        end = math.ceil((top - max(low, bottom)) * per_mhz - 1e-3)
        out.append((min(max(first, 0), meta.nfreq - 1), min(max(end, 0), meta.nfreq)))
    return out


@dataclass
class BadChannelMask(Operator):
    """Mask the channels that ranges in MHz touch, from a file and from a list.

    The ranges become a set of channels of at most nfreq rows, and an anti-join keeps
    the others' weights: a broadcast if they are few, else Spark's choice.
    """

    mask_path: str = ""
    mask_ranges: list = field(default_factory=list)
    class_name = "badchannel_mask"

    def ranges(self) -> list[tuple[float, float]]:
        return (read_ranges(self.mask_path) if self.mask_path else []) + [tuple(r) for r in self.mask_ranges]

    def _bind(self, meta: GridMeta) -> GridMeta:
        channel_ranges(self.ranges(), meta)
        return meta

    def kernel(self, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
        w = w.copy()
        for a, b in channel_ranges(self.ranges(), meta):
            w[a:b] = 0
        return i, w

    def apply(self, grid: Grid) -> Grid:
        spark = grid.df.sparkSession
        ranges = channel_ranges(self.ranges(), grid.meta)
        bad = spark.createDataFrame([(a, b) for a, b in ranges if a < b], "__lo int, __hi int").select(F.explode(F.sequence("__lo", F.col("__hi") - 1)).alias("freq")).distinct().withColumn("__bad", F.lit(True))
        bad = F.broadcast(bad) if sum(b - a for a, b in ranges) <= BROADCAST_ROWS else bad
        df = grid.df.join(bad, "freq", "left")
        return grid.with_df(df.withColumn("weight", F.when(F.col("__bad"), 0.0).otherwise(F.col("weight"))).drop("__bad"))


@dataclass
class SpikeMask(Operator):
    """Mask the last fine channel of every coarse one."""

    nt_chunk: int = 0
    class_name = "chime_16k_spike_mask"
    nfreq: ClassVar[int] = 16384

    def _bind(self, meta: GridMeta) -> GridMeta:
        if meta.nfreq % UPFREQ:
            raise ValueError(f"nfreq must be a multiple of {UPFREQ}; the instrument has {self.nfreq}")
        return meta

    def kernel(self, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
        return i, np.where(np.arange(len(w))[:, None] % UPFREQ == UPFREQ - 1, 0.0, w)

    def apply(self, grid: Grid) -> Grid:
        return grid.with_df(grid.df.withColumn("weight", F.when(F.col("freq") % UPFREQ == UPFREQ - 1, 0.0).otherwise(F.col("weight"))))


@dataclass
class Derippler(Operator):
    """Divide intensities by the band's ripple, or by a part of it."""

    fudge_factor: float = 1.0
    nt_chunk: int = 0
    class_name = "chime_16k_derippler"

    def __post_init__(self) -> None:
        if not -1 <= self.fudge_factor <= 2:
            raise ValueError("fudge_factor must be between -1 and 2")

    def _bind(self, meta: GridMeta) -> GridMeta:
        if meta.nfreq % UPFREQ:
            raise ValueError(f"nfreq must be a multiple of {UPFREQ}")
        return meta

    def factors(self) -> list[float]:
        return [1 / (1 + self.fudge_factor * (c - 1)) for c in RIPPLE]

    def kernel(self, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
        return i * np.resize(self.factors(), len(i))[:, None], w

    def apply(self, grid: Grid) -> Grid:
        by = F.array(*map(F.lit, self.factors()))
        return grid.with_df(grid.df.withColumn("intensity", F.col("intensity") * F.element_at(by, F.col("freq") % UPFREQ + 1)))


@dataclass
class MaskCounter(Operator):
    """Count unmasked cells per chunk, with counts per channel; the grid passes unchanged.

    Output ``mask_counter_<where>``: (pos, nf, nt, nsamples, unmasked, freqs). Counts per
    (chunk, channel) are pre-aggregated; a chunk then gathers at most nfreq numbers.
    """

    nt_chunk: int
    where: str
    class_name = "mask_counter"
    in_sub_pipeline = True

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_chunk(meta, self.nt_chunk)
        names = [*meta.attrs.get("mask_counter_name_list", ()), self.where]
        if len(set(names)) < len(names):
            raise ValueError(f"there is a mask counter {self.where!r} already")
        return meta.with_attrs(mask_counter_name_list=names)

    def apply(self, grid: Grid) -> Grid:
        return grid.with_output(f"mask_counter_{self.where}", mask_measurements(grid, self.nt_chunk))


def mask_measurements(grid: Grid, nt_chunk: int) -> DataFrame:
    m = grid.meta
    nt = nt_chunk // m.nds
    per = grid.cells.groupBy(F.expr(f"t div {nt_chunk} * {nt_chunk}").alias("pos"), "freq").agg(F.count_if(F.col("weight") > 0).alias("n"))
    out = per.groupBy("pos").agg(F.sum("n").alias("unmasked"), F.map_from_entries(F.collect_list(F.struct("freq", "n"))).alias("by"))
    freqs = F.transform(F.sequence(F.lit(0), F.lit(m.nfreq - 1)), lambda f: F.coalesce(F.try_element_at("by", f), F.lit(0)).cast("int"))
    return out.select("pos", F.lit(m.nfreq).alias("nf"), F.lit(nt).alias("nt"), F.lit(m.nfreq * nt).cast("long").alias("nsamples"), "unmasked", freqs.alias("freqs"))


def last_measurements(measurements: DataFrame, n: int = 300) -> DataFrame:
    """The n latest chunks: a top-k, which sorts no more than n rows per task."""
    if n <= 0:
        raise ValueError("n must be positive")
    return measurements.orderBy(F.desc("pos")).limit(n)


def measurement_stats(measurements: DataFrame, n: int = 300) -> DataFrame:
    """One row for the n latest chunks: totals and the masked share."""
    got = last_measurements(measurements, n).agg(F.coalesce(F.sum("nsamples"), F.lit(0)).alias("nsamples"), F.coalesce(F.sum("unmasked"), F.lit(0)).alias("unmasked"))
    return got.withColumn("rfi_mask_pct_masked", F.when(F.col("nsamples") > 0, 100.0 * (F.col("nsamples") - F.col("unmasked")) / F.col("nsamples")).otherwise(0.0))


@dataclass
class MaskExpander(Operator):
    """Grow the mask over channels: mask where decaying sums of the mask from above and from below both stay low.

    New masks (against the buffer prev_wname) count fully; cells that were masked before
    count by alpha. With x per channel and a < 1, the sum from above is
    F_i = x_i + a F_(i-1). Unrolled, F_i a^-i is a running sum, so one window per
    direction does; channels are taken in blocks small enough for a^-n to stay finite,
    and a missing cell counts as masked in both.
    """

    prev_wname: str
    width: float
    threshold: float
    alpha: float = 0.0
    nt_chunk: int = 0
    axis: object = "freq"
    class_name = "mask_expander"

    def __post_init__(self) -> None:
        self.axis = parse_axis(self.axis)
        if self.axis != "freq":
            raise ValueError("axis must be freq")
        if not 1e-5 <= self.width <= 100 or not 0 < self.threshold < 1 or not -1 <= self.alpha <= 1:
            raise ValueError("width must be in [1e-5, 100], threshold in (0, 1), alpha in [-1, 1]")

    def constants(self, nfreq: int) -> tuple[float, float, float, float]:
        """a, b, vp, vb: decay, limit, value of cells masked before, and the sum beyond the band's edge."""
        a = math.exp(-1 / (self.width * nfreq))
        th = self.threshold
        vp = 1 - th + self.alpha * th if self.alpha >= 0 else (1 + self.alpha) * (1 - th)
        return a, (1 - th) / (1 - a), vp, vp / (1 - a)

    def apply(self, grid: Grid) -> Grid:
        n = grid.meta.nfreq
        a, b, vp, vb = self.constants(n)
        prev = F.col({"WEIGHTS": "weight"}.get(self.prev_wname, self.prev_wname))
        x = F.when(F.col("weight") > 0, 1.0).when(prev > 0, 0.0).otherwise(vp)
        # a missing cell is masked in both buffers and adds vp: sums run over x - vp, and vp's own sum is known
        df = grid.df.withColumn("__x", x - vp)
        if -n * math.log(a) < 600:
            up, down = (Window.partitionBy("t").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("freq"), F.desc("freq")))
            weighed = lambda s: F.col("__x") * F.pow(F.lit(a), F.col("freq") * s)
            df = df.withColumns({"__f": F.sum(weighed(-1)).over(up) * F.pow(F.lit(a), F.col("freq")), "__b": F.sum(weighed(1)).over(down) * F.pow(F.lit(a), -F.col("freq"))})
        else:  # a decays too fast for one running sum: neighbours beyond 40 / -log(a) channels add nothing
            reach = math.ceil(40 / -math.log(a))
            for name, low, high in (("__f", -reach, 0), ("__b", 0, reach)):
                near = F.collect_list(F.struct("freq", "__x")).over(Window.partitionBy("t").orderBy("freq").rangeBetween(low, high))
                df = df.withColumn("__near", near)
                df = df.withColumn(name, F.expr(f"aggregate(__near, 0D, (s, e) -> s + e.__x * pow({a!r}D, abs(e.freq - freq)))")).drop("__near")
        # vp over all channels and beyond the edge: vp / (1 - a) = vb at every channel
        low = (F.col("__f") + vb < b) & (F.col("__b") + vb < b)
        return grid.with_df(df.withColumn("weight", F.when(low, 0.0).otherwise(F.col("weight"))).drop("__x", "__f", "__b"))


@dataclass
class MeanWeightMask(Operator):
    """Mask along an axis where the plain mean of weights over the full size is at or below thr."""

    thr: float = 0.2
    axis: object = "freq"
    nt_chunk: int = 1024
    class_name = "mean_weight_mask"

    def __post_init__(self) -> None:
        self.axis = parse_axis(self.axis)

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_chunk(meta, self.nt_chunk)
        return meta

    def apply(self, grid: Grid) -> Grid:
        m = grid.meta
        df, keys = axis_keys(grid.df, m, self.axis, self.nt_chunk)
        nt = self.nt_chunk // m.nds
        size = {"freq": m.nfreq, "time": nt, "none": nt * m.nfreq}[self.axis]
        df = df.withColumn("__mean", F.sum("weight").over(Window.partitionBy(*keys)) / float(size))
        return grid.with_df(df.withColumn("weight", F.when(F.col("__mean") <= self.thr, 0.0).otherwise(F.col("weight"))).drop("__mean"))


@dataclass
class ThermalNoiseWeight(Operator):
    """Divide a channel's weights by its mean over sqrt(2 dt df); mask channels with hardly any weight, or of sum 0.

    Two levels: sums per (chunk, channel), then the mean weight per chunk over all
    nfreq channels. The small table is joined back.
    """

    nt_chunk: int = 512
    class_name = "thermal_noise_weight"

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("freq_lo_MHz", "freq_hi_MHz", "dt_sample")
        check_chunk(meta, self.nt_chunk)
        return meta

    def apply(self, grid: Grid) -> Grid:
        m = grid.meta
        noise = math.sqrt(2 * m.dt_sample * m.nds * (m.freq_hi_MHz - m.freq_lo_MHz) * 1e6 / m.nfreq)
        df, c = chunk_key(grid.df, self.nt_chunk)
        rows = df.groupBy(c, "freq").agg(F.sum(F.col("weight") * F.col("intensity")).alias("num"), F.sum("weight").alias("den"))
        rows = rows.withColumn("all", F.sum("den").over(Window.partitionBy(c)) / float(m.nfreq))
        good = (F.col("den") >= 0.001 * F.col("all")) & (F.col("num") != 0)
        rows = rows.where(good).select(c, "freq", (F.col("num") / F.col("den") / noise).alias("__std"))
        df = df.join(rows, [c, "freq"], "left")
        return grid.with_df(df.withColumn("weight", F.when(F.col("__std").isNotNull(), F.col("weight") / F.col("__std")).otherwise(0.0)).drop("__std"), branches=grid.branches + 1)


@dataclass
class AdversarialMasker(Operator):
    """Mask rectangles that are hard on detrenders: gaps, stripes, random channels, a minefield.

    The rectangles are cut at multiples of SLICE samples and joined by slice, so that a
    cell meets the few that touch its slice; they follow from seed. Half of the samples
    in ``coins`` intervals are masked, by a hash of the cell.
    """

    nt_chunk: int = 1024
    nt_reset: int = 65536
    nt_minefield: int = 4194304
    seed: int = 0
    class_name = "adversarial_masker"
    SLICE: ClassVar[int] = 4096

    def layout(self, nfreq: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
        """(f0, f1, t0, t1) rectangles, and (t0, t1) intervals of random samples; all half-open."""
        rng, rects, coins, now = random.Random(self.seed), [], [], self.nt_reset
        sizes = [self.nt_reset >> i for i in range(8)]

        def series(rows):  # noqa: ANN001, ANN202  one family: eight sizes, each followed by a rest
            nonlocal now
            for n in sizes:
                rects.extend(rows(now, n))
                now += n + self.nt_reset

        def random_channels(t: int, n: int) -> list:
            return [(f, f + 1, t, t + n) for f in {rng.randrange(nfreq) for _ in range(rng.randint(nfreq // 4, nfreq - 1))}]

        def random_band(t: int, n: int) -> list:
            size, start = rng.randint(nfreq // 4, nfreq - 1), rng.randrange(nfreq)
            wrapped = start + size - nfreq
            return [(start, min(nfreq, start + size), t, t + n)] + ([(0, wrapped, t, t + n)] if wrapped > 0 else [])

        series(lambda t, n: [(0, nfreq, t, t + n)])
        for f0, f1 in ((nfreq // 4, nfreq), (0, 3 * nfreq // 4)):
            now = round_up(now, 2048)
            rects.append((f0, f1, now, now + self.nt_reset))
            now += 2 * self.nt_reset
        series(random_channels)
        series(random_band)
        series(lambda t, n: [(0, nfreq, t + 2 * k * (n // 8), t + (2 * k + 1) * (n // 8)) for k in range(4)])
        stripe = nfreq // 80
        series(lambda t, n: [(2 * k * stripe, (2 * k + 1) * stripe, t, t + n) for k in range(40)])
        for n in sizes:
            coins.append((now, now + n))
            now += n + self.nt_reset
        for _ in range(self.nt_minefield // 3000):
            a, b = rng.randint(-(nfreq // 5), nfreq - 1), rng.randint(0, nfreq + nfreq // 5)
            u = rng.uniform(-1, 1)
            t0 = now + int((math.copysign(abs(u) ** (1 / 3), u) + 1) / 2 * self.nt_minefield)
            rects.append((max(0, min(a, b)), min(nfreq, max(a, b) + 1), t0, t0 + int(math.exp(rng.uniform(math.log(100), math.log(10000))))))
        return [r for r in rects if r[0] < r[1] and r[2] < r[3]], coins

    def apply(self, grid: Grid) -> Grid:
        rects, coins = self.layout(grid.meta.nfreq)
        out = mask_rectangles(grid, rects, self.SLICE)
        inside = F.lit(False)
        for a, b in coins:
            inside = inside | ((F.col("t") >= a) & (F.col("t") < b))
        heads = uniform(self.seed, F.col("t"), F.col("freq")) < 0.5
        return out.with_df(out.df.withColumn("weight", F.when(inside & heads, 0.0).otherwise(F.col("weight"))))


def mask_rectangles(grid: Grid, rects: list[tuple[int, int, int, int]], slice_: int = 4096) -> Grid:
    """Weight 0 in half-open (f0, f1, t0, t1) rectangles.

    Rectangles of a slice become one array per slice: an equi-join on the slice, then a
    test against its few rectangles, with no duplicate cells.
    """
    spark: SparkSession = grid.df.sparkSession
    rows = spark.createDataFrame(rects, "f0 int, f1 int, t0 long, t1 long") if rects else spark.createDataFrame([], "f0 int, f1 int, t0 long, t1 long")
    cut_ = rows.withColumn("__slice", F.explode(F.expr(f"sequence(t0 div {slice_}, (t1 - 1) div {slice_})")))
    per = cut_.groupBy("__slice").agg(F.collect_list(F.struct("f0", "f1", "t0", "t1")).alias("__rects"))
    df = grid.df.withColumn("__slice", F.expr(f"t div {slice_}")).join(per, "__slice", "left")
    hit = F.coalesce(F.exists("__rects", lambda r: (F.col("freq") >= r["f0"]) & (F.col("freq") < r["f1"]) & (F.col("t") >= r["t0"]) & (F.col("t") < r["t1"])), F.lit(False))
    return grid.with_df(df.withColumn("weight", F.when(hit, 0.0).otherwise(F.col("weight"))).drop("__slice", "__rects"))
