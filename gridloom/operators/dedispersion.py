"""Pulses and the search for them: injection, and dedispersion by shifting and adding channels."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import reldist
from ..grid import Grid, GridMeta
from .base import Operator

#: Settings of configurations that say nothing about results here.
IGNORED = ("allocate", "file_type", "use_analytic_normalization", "estimate_cumulative_variance", "use_unnormalized_triggers", "force_unnormalized_triggers", "deallocate_between_substreams", "L1b_config")
#: Cold-plasma delay in seconds of DM 1 at 1 GHz.
DELAY_S = 4.148808e-3


def channel_band(meta: GridMeta, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper edges in GHz of channels counted from the top."""
    width = (meta.freq_hi_MHz - meta.freq_lo_MHz) / meta.nfreq
    high = meta.freq_hi_MHz - freq * width
    return (high - width) / 1e3, high / 1e3


def delay(dm: float, ghz: np.ndarray | float) -> np.ndarray | float:
    """Dispersion delay in seconds."""
    return DELAY_S * dm * np.power(ghz, -2.0)


@dataclass(frozen=True)
class Pulse:
    """A dispersed, scattered pulse: Gaussian of intrinsic width, smeared within each channel.

    Per channel the profile is a Gaussian whose variance adds the intrinsic width's, the
    in-channel smearing's and the scattering time's; the mean adds the scattering time.
    Scattering (sm, in ms at 1 GHz) goes as frequency^-4.4, strength as ^spectral_index
    relative to the band's middle. ``arrival`` is in seconds at infinite frequency.
    """

    arrival: float
    dm: float
    fluence: float = 1.0
    width: float = 0.0
    sm: float = 0.0
    spectral_index: float = 0.0

    def channels(self, meta: GridMeta) -> list[tuple[int, float, float, float]]:
        """(channel, centre s, sigma s, fluence in intensity * s) of every channel."""
        f = np.arange(meta.nfreq)
        low, high = channel_band(meta, f)
        mid = (low + high) / 2
        t_low, t_high = delay(self.dm, low), delay(self.dm, high)
        tau = self.sm * 1e-3 * mid**-4.4
        # a sample integrates over its length, so no profile is narrower than one
        sigma = np.sqrt(self.width**2 + ((t_low - t_high) ** 2) / 12 + tau**2 + (meta.dt_sample**2) / 12)
        centre = self.arrival + (t_low + t_high) / 2 + tau
        strength = self.fluence * (mid / ((meta.freq_lo_MHz + meta.freq_hi_MHz) / 2e3)) ** self.spectral_index
        return [(int(k), float(c), float(s), float(a)) for k, c, s, a in zip(f, centre, sigma, strength, strict=True)]

    def snr(self, meta: GridMeta, rms: float | Sequence[float]) -> float:
        """Signal to noise of a matched filter, for noise of the given rms per channel and sample."""
        noise = np.broadcast_to(np.asarray(rms, dtype=float), (meta.nfreq,))
        power = np.array([a * a / (2 * s * math.sqrt(math.pi)) for _, _, s, a in self.channels(meta)]) * 1.0
        good = noise > 0
        return float(np.sqrt((power[good] / (noise[good] ** 2 * meta.dt_sample)).sum()))


def add_pulses(grid: Grid, pulses: Sequence[Pulse]) -> DataFrame:
    """The cells with the pulses' profiles added to intensity; weights stay.

    A table of at most pulses x nfreq rows is grouped into one array per channel, and
    joined by channel: cells keep their number.
    """
    m = grid.meta
    spark: SparkSession = grid.df.sparkSession
    rows = [(f, c - (m.t_initial or 0.0), s, a) for p in pulses for f, c, s, a in p.channels(m)]
    table = spark.createDataFrame(rows, "freq int, c double, s double, a double").groupBy("freq").agg(F.collect_list(F.struct("c", "s", "a")).alias("__p"))
    df = grid.df.join(table, "freq", "left")
    mid = (F.col("t") + 0.5 * m.nds) * m.dt_sample

    def value(p):  # noqa: ANN001, ANN202
        z = (mid - p["c"]) / p["s"]
        # intensity: fluence per time, at the sample's middle
        return F.when(F.abs(z) < 8, p["a"] / (p["s"] * math.sqrt(2 * math.pi)) * F.exp(-0.5 * z * z)).otherwise(0.0)

    extra = F.aggregate(F.coalesce("__p", F.array().cast("array<struct<c:double,s:double,a:double>>")), F.lit(0.0), lambda s, p: s + value(p))
    return df.withColumn("intensity", F.col("intensity") + extra).drop("__p")


@dataclass
class FrbInjector(Operator):
    """Add one pulse of the wanted signal to noise. variance: a number, one per channel, or a variance table's path."""

    snr: float
    undispersed_arrival_time: float
    dm: float
    variance: Any = 1.0
    intrinsic_width: float = 0.0
    sm: float = 0.0
    spectral_index: float = 0.0
    nt_chunk: int = 1024
    class_name = "frb_injector_transform"

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("freq_lo_MHz", "freq_hi_MHz", "dt_sample")
        return meta

    def rms(self, spark: SparkSession, meta: GridMeta) -> np.ndarray:
        if isinstance(self.variance, str):
            from .fillers import variance_at

            got = {r.freq: r.v for r in variance_at(spark, self.variance).groupBy("freq").agg(F.avg("variance").alias("v")).collect()}  # nfreq rows
            return np.sqrt(np.array([got.get(f, 0.0) for f in range(meta.nfreq)]))
        return np.sqrt(np.broadcast_to(np.asarray(self.variance, dtype=float), (meta.nfreq,)))

    def pulse(self, meta: GridMeta, rms: np.ndarray) -> Pulse:
        unit = Pulse(self.undispersed_arrival_time, self.dm, 1.0, self.intrinsic_width, self.sm, self.spectral_index)
        return Pulse(unit.arrival, unit.dm, self.snr / unit.snr(meta, rms), unit.width, unit.sm, unit.spectral_index)

    def apply(self, grid: Grid) -> Grid:
        return grid.with_df(add_pulses(grid, [self.pulse(grid.meta, self.rms(grid.df.sparkSession, grid.meta))]))


@dataclass
class PulseAdder(Operator):
    """Add several pulses, times a weight."""

    pulses: list
    weight: float = 1.0
    nt: int = 1024
    class_name = "pulse_adder"

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("freq_lo_MHz", "freq_hi_MHz", "dt_sample")
        return meta

    def apply(self, grid: Grid) -> Grid:
        pulses = [p if isinstance(p, Pulse) else Pulse(**p) for p in self.pulses]
        return grid.with_df(add_pulses(grid, [Pulse(p.arrival, p.dm, p.fluence * self.weight, p.width, p.sm, p.spectral_index) for p in pulses]))


def shifts(meta: GridMeta, dms: Sequence[float]) -> list[tuple[int, float, int, int]]:
    """(dm index, dm, channel, delay in samples relative to the band's top edge)."""
    f = np.arange(meta.nfreq)
    low, high = channel_band(meta, f)
    mid, top = (low + high) / 2, meta.freq_hi_MHz / 1e3
    return [(k, float(dm), int(c), int(s)) for k, dm in enumerate(dms) for c, s in zip(f, np.floor((delay(dm, mid) - delay(dm, top)) / (meta.dt_sample * meta.nds) + 0.5).astype(int), strict=True)]


def dedisperse(grid: Grid, dms: Sequence[float]) -> DataFrame:
    """(dm_idx, dm, t, value, norm): per trial and arrival sample the sum of w * i over norm = sqrt(sum of w^2).

    The trial table has trials x nfreq rows; grouped into one array per channel it is
    joined by channel. Each cell becomes one row per trial, which the partial
    aggregation right after it folds within the task.
    """
    m = grid.meta
    spark: SparkSession = grid.df.sparkSession
    table = spark.createDataFrame(shifts(m, dms), "dm_idx int, dm double, freq int, shift int")
    per = table.groupBy("freq").agg(F.collect_list(F.struct("dm_idx", "dm", "shift")).alias("trials"))
    cells = grid.cells.where("weight > 0").select("t", "freq", (F.col("weight") * F.col("intensity")).alias("wi"), (F.col("weight") * F.col("weight")).alias("ww"))
    wide = cells.join(per, "freq").select("t", "wi", "ww", F.explode("trials").alias("x"))
    out = wide.groupBy(F.col("x.dm_idx").alias("dm_idx"), F.col("x.dm").alias("dm"), (F.col("t") - F.col("x.shift") * m.nds).alias("t")).agg(F.sum("wi").alias("s"), F.sum("ww").alias("ww"))
    return out.where("t >= 0").select("dm_idx", "dm", "t", (F.col("s") / F.sqrt("ww")).alias("value"), F.sqrt("ww").alias("norm"))


def coarse_triggers(found: DataFrame, ndm: int, nt: int) -> DataFrame:
    """(dm_bin, t_bin, trigger): the maximum of value over ndm trials by nt samples."""
    return found.groupBy(F.expr(f"dm_idx div {ndm}").alias("dm_bin"), F.expr(f"t div {nt}").alias("t_bin")).agg(F.max("value").alias("trigger"))


def global_max(found: DataFrame, dm_min: float | None = None, dm_max: float | None = None) -> DataFrame:
    """One row: the largest value and its dm and sample, ties to the smaller dm and sample; dm_max 0 or None is no bound."""
    df = found if dm_min is None else found.where(F.col("dm") >= dm_min)
    df = df.where(F.col("dm") <= dm_max) if dm_max else df
    best = F.max(F.struct("value", (-F.col("dm")).alias("d"), (-F.col("t")).alias("s"))).alias("b")
    return df.agg(best).select(F.col("b.value").alias("value"), (-F.col("b.d")).alias("dm"), (-F.col("b.s")).alias("t"))


def read_config(path: str) -> dict[str, Any]:
    """key = value lines; # begins a comment; values with several words are lists of numbers."""
    out: dict[str, Any] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            k, eq, v = line.partition("#")[0].partition("=")
            if not eq:
                continue
            words: list[Any] = []
            for w in v.replace("[", " ").replace("]", " ").replace(",", " ").split():
                try:
                    words.append(int(w))
                except ValueError:
                    try:
                        words.append(float(w))
                    except ValueError:
                        words.append(w)
            out[k.strip()] = words[0] if len(words) == 1 else words
    return out


@dataclass
class Dedisperser(Operator):
    """Search trial DMs and put out coarse triggers; the grid passes unchanged.

    Outputs ``triggers`` (dm_bin, t_bin, trigger) and, with track_global_max,
    ``global_max``. The search is shift-and-add over ntrial DMs up to max_dm; a config file
    gives the band, dt_sample, max_dm, ndm_per_trigger and nt_per_trigger, and must
    agree with the stream. With hdf5_output_filename set, triggers are also written
    as Parquet, partitioned by file.
    """

    config_filename: str = ""
    config: dict = field(default_factory=dict)
    track_global_max: bool = False
    dm_min: float | None = None
    dm_max: float | None = None
    ntrial: int = 64
    hdf5_output_filename: str | None = None
    nt_per_hdf5_file: int = 0
    fill_rfi_mask: bool = False
    verbosity: int = 1
    class_name = "bonsai_dedisperser_cpp"
    json_renames = {"dm_min": "global_max_tracker_dm_min", "dm_max": "global_max_tracker_dm_max"}

    @classmethod
    def from_json(cls, j: dict[str, Any]) -> Dedisperser:
        """Accepts settings in a nested ``initializer``; those that steer memory or normalization of another engine have no meaning here."""
        flat = {k: v for k, v in (j | j.get("initializer", {})).items() if k not in ("initializer", *IGNORED)}
        back = {v: k for k, v in cls.json_renames.items()}
        return super().from_json({back.get(k, k): v for k, v in flat.items()})

    def settings(self) -> dict[str, Any]:
        got = (read_config(self.config_filename) if self.config_filename else {}) | self.config
        return {"max_dm": 100.0, "ndm_per_trigger": 1, "nt_per_trigger": 16} | got

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("freq_lo_MHz", "freq_hi_MHz", "dt_sample")
        s = self.settings()
        if "nfreq" in s and s["nfreq"] != meta.nfreq:
            raise ValueError("the config's nfreq differs from the stream's")
        for k, tolerance in (("freq_lo_MHz", 1e-4), ("freq_hi_MHz", 1e-4), ("dt_sample", 1e-3)):
            if k in s and reldist(s[k], getattr(meta, k)) > tolerance:
                raise ValueError(f"the config's {k} differs from the stream's")
        return meta

    def apply(self, grid: Grid) -> Grid:
        s = self.settings()
        last = max(self.ntrial - 1, 1)
        found = dedisperse(grid, [s["max_dm"] * k / last for k in range(self.ntrial)])
        triggers = coarse_triggers(found, s["ndm_per_trigger"], s["nt_per_trigger"])
        if self.hdf5_output_filename:
            per = max(1, self.nt_per_hdf5_file // s["nt_per_trigger"])
            triggers.withColumn("file", F.expr(f"t_bin div {per}")).write.partitionBy("file").mode("errorifexists").parquet(self.hdf5_output_filename)
        grid = grid.with_output("triggers", triggers)
        return grid.with_output("global_max", global_max(found, self.dm_min, self.dm_max)) if self.track_global_max else grid


@dataclass
class DedisperserPlots(Dedisperser):
    """The dedisperser with waterfall tiles of the trigger plane: output ``trigger_tiles`` (zoom, tile, x, y, trigger, hot).

    Triggers are pooled by maxima to img_ndm rows, and to tiles of img_nt columns of
    downsample_nt * 2^zoom samples; hot counts the thresholds (0, 1 or 2) they exceed.
    """

    img_prefix: str | None = "triggers"
    img_ndm: int = 256
    img_nt: int = 256
    downsample_nt: int = 1
    n_zoom: int = 1
    plot_threshold1: float = 6.0
    plot_threshold2: float = 10.0
    dynamic_plotter: bool = False
    plot_all_trees: bool = False
    class_name = "bonsai_dedisperser_python"

    def apply(self, grid: Grid) -> Grid:
        grid = super().apply(grid)
        if not self.img_prefix or not self.n_zoom:
            return grid
        s = self.settings()
        rows = -(-self.ntrial // s["ndm_per_trigger"])
        y = F.expr(f"dm_bin * {self.img_ndm} div {rows}") if rows > self.img_ndm else F.col("dm_bin")
        step = max(1, self.downsample_nt // s["nt_per_trigger"])
        level = grid.outputs["triggers"].groupBy(y.alias("y"), F.expr(f"t_bin div {step}").alias("c")).agg(F.max("trigger").alias("trigger")).withColumn("zoom", F.lit(0))
        out = level
        for z in range(1, self.n_zoom):
            level = level.groupBy("y", F.expr("c div 2").alias("c")).agg(F.max("trigger").alias("trigger")).withColumn("zoom", F.lit(z))
            out = out.unionByName(level)
        hot = (F.col("trigger") >= self.plot_threshold1).cast("int") + (F.col("trigger") >= self.plot_threshold2).cast("int")
        return grid.with_output("trigger_tiles", out.select("zoom", F.expr(f"c div {self.img_nt}").alias("tile"), F.expr(f"cast(c % {self.img_nt} as int)").alias("x"), "y", "trigger", hot.alias("hot")))
