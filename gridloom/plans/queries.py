"""Registered queries: operators on the grids of the relational tables, and their results in short."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.colours import colour_tiles
from ..functions.resample import downsample, expand, max_pool, pack_mask, unpack_mask, upsample, upsample_weights, zoom_pyramid
from ..functions.stats import group_stats, weighted_mean_and_rms
from ..grid import CELL, SCHEMA, Grid, densify
from ..operators.analyzers import PlotterTransform, SpectrumAnalyzer, StripeAnalyzer, VarianceEstimator, variance_v1, variance_v2
from ..operators.base import FunctionTransform, Operator
from ..operators.clippers import IntensityClipper, KurtosisFilter, StdDevClipper
from ..operators.containers import Pipeline, PipelineFork, Reverter, Saver, SubPipeline
from ..operators.dedispersion import FrbInjector, Pulse, PulseAdder, coarse_triggers, dedisperse, global_max
from ..operators.detrenders import PolynomialDetrender, RCDetrender, SplineDetrender
from ..operators.fillers import MaskFiller, NoiseFiller, OnlineMaskFiller, compare_variances, evaluate, interpolate_zeros
from ..operators.fused import FusedChain, Packed, PackedFileStream, apply_to_arrays, pack_cells, unpack_cells
from ..operators.masks import AdversarialMasker, BadChannelMask, Derippler, MaskCounter, MaskExpander, MeanWeightMask, SpikeMask, ThermalNoiseWeight, last_measurements, mask_measurements, mask_rectangles, measurement_stats
from ..sinks.packets import packets
from ..sources.files import FileStream, FileWriter, acquisition, scan
from ..sources.synthetic import DummyNetworkStream, GaussianNoiseStream
from ..storage import shared_path
from .grids import EMB_CHUNK, EVENT_CHUNK, LINE_CHUNK, emb_grid, event_grid, lineitem_grid, summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DMS = (0.0, 10.0, 20.0, 40.0, 80.0)
RANGES = [(420.0, 431.0), (555.5, 556.0), (790.0, 805.0)]
RECTS = [(3, 20, 10, 90), (0, 64, 120, 124), (40, 41, 0, 400), (15, 50, 200, 330)]
V1, V2 = 16, 5


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on_embeddings(name: str, op: Callable[[], Operator]) -> None:
    QUERIES[name] = lambda spark, sf_dir: summary(op()(emb_grid(spark, sf_dir)).cells, EMB_CHUNK)


def on_lines(name: str, op: Callable[[], Operator]) -> None:
    QUERIES[name] = lambda spark, sf_dir: summary(op()(lineitem_grid(spark, sf_dir)).cells, LINE_CHUNK)


on_embeddings("clip_time", lambda: IntensityClipper(64, "time", 1.2))
on_embeddings("clip_time_niter3", lambda: IntensityClipper(64, "time", 1.2, niter=3, iter_sigma=1.5))
on_embeddings("clip_freq", lambda: IntensityClipper(0, "freq", 1.3, niter=2))
on_embeddings("clip_none", lambda: IntensityClipper(64, "none", 1.25, niter=3))
on_embeddings("clip_2d_df2_dt4", lambda: IntensityClipper(64, "none", 1.3, niter=2, Df=2, Dt=4))
on_lines("clip_time_lines", lambda: IntensityClipper(128, "time", 1.5, niter=2))
on_lines("clip_freq_df4", lambda: IntensityClipper(128, "freq", 1.4, niter=1, Df=4, Dt=2))
on_embeddings("stddev_clip_time", lambda: StdDevClipper(64, "time", 1.3))
on_embeddings("stddev_clip_freq", lambda: StdDevClipper(64, "freq", 1.3, Df=2, Dt=2))
on_embeddings("sub_pipeline_mask", lambda: SubPipeline(Pipeline([IntensityClipper(64, "time", 1.4), StdDevClipper(64, "time", 1.5)]), w_cutoff=0.5, Df=4, Dt=2))
on_embeddings("poly0_time", lambda: PolynomialDetrender(64, "time", 0))
on_embeddings("poly1_freq", lambda: PolynomialDetrender(0, "freq", 1))
on_embeddings("poly2_time", lambda: PolynomialDetrender(64, "time", 2))
on_embeddings("poly6_time", lambda: PolynomialDetrender(64, "time", 6, epsilon=1e-4))
on_embeddings("spline_freq", lambda: SplineDetrender(64, "freq", 2))
on_embeddings("rc_detrend", lambda: RCDetrender(64, 0.9))
on_embeddings("badchannel_range_join", lambda: BadChannelMask(mask_ranges=RANGES))
on_embeddings("spike_mask", lambda: SpikeMask())
on_embeddings("derippler", lambda: Derippler(0.8))
on_embeddings("rect_mask", lambda: FunctionTransform(lambda df, m: mask_rectangles(Grid(df, m), RECTS, 64).df))
on_embeddings("adversarial_mask", lambda: AdversarialMasker(64, 64, 6000))
on_embeddings("kurtosis_mask", lambda: KurtosisFilter((-0.8, 0.8), 64))
on_embeddings("thermal_weight", lambda: Pipeline([FunctionTransform(lambda df, m: df.withColumn("intensity", F.col("intensity") + 5.0)), ThermalNoiseWeight(64)]))
on_embeddings("mean_weight_mask", lambda: MeanWeightMask(1.78, "time", 64))
on_lines("mean_weight_mask_freq", lambda: MeanWeightMask(0.7, "freq", 128))
on_embeddings("saver_reverter", lambda: Pipeline([Saver("kept"), IntensityClipper(64, "time", 1.1), Reverter("kept"), IntensityClipper(64, "none", 1.6)]))
on_embeddings("pulse_adder", lambda: PulseAdder([Pulse(0.05, 8.0, 0.4, 0.002), Pulse(0.21, 3.0, 0.2, 0.004, 0.5, -1.0)]))
on_embeddings("noise_filler", lambda: NoiseFiller(64, 0.1))
on_embeddings("online_mask_filler", lambda: OnlineMaskFiller(v1_chunk=16, w_clamp=0.2, var_weight=0.1, var_clamp_add=0.05, var_clamp_mult=0.1, nt_chunk=64))


@query
def weighted_mean_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = emb_grid(spark, sf_dir)
    out = weighted_mean_and_rms(g.cells.withColumn("chunk", F.expr(f"t div {EMB_CHUNK}")), ["chunk", "freq"], 3, 1.5)
    return out.select("chunk", "freq", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), F.round("total", 4).alias("total"))


@query
def weighted_mean_rms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weighted_mean_and_rms(lineitem_grid(spark, sf_dir).cells, [], 2, 2.0)
    return out.select(F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), F.round("total", 3).alias("total"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select("t", "freq", F.round("intensity", 9).alias("intensity"), F.round("weight", 9).alias("weight"))


@query
def wi_downsample_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(downsample(emb_grid(spark, sf_dir), 4, 8).df)


@query
def wi_downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(downsample(lineitem_grid(spark, sf_dir), 8, 16, "mean").df)


@query
def weight_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = emb_grid(spark, sf_dir)
    return summary(upsample_weights(g, downsample(g, 2, 2), 6.0), EMB_CHUNK)


@query
def upsample_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(upsample(downsample(event_grid(spark, sf_dir), 4, 6), 4, 3).df)


@query
def expand_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expand(event_grid(spark, sf_dir).cells, ["t"], "weight", "sum")
    return out.select("t", "freq", F.round(F.col("weight") / F.col("expanded"), 6).alias("share"))


@query
def fork_delta_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline([PipelineFork([("WEIGHTS", "before")]), IntensityClipper(64, "time", 1.2)])
    df = p(emb_grid(spark, sf_dir)).cells
    return df.groupBy("freq").agg(F.count_if((F.col("before") > 0) & (F.col("weight") == 0)).alias("newly_masked"), F.count_if(F.col("before") == 0).alias("masked_before"))


@query
def mask_expander(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline([PipelineFork([("WEIGHTS", "before")]), IntensityClipper(64, "time", 1.2), MaskExpander("before", 0.05, 0.5, 0.3)])
    return summary(p(emb_grid(spark, sf_dir)).cells, EMB_CHUNK)


@query
def mask_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = MaskCounter(64, "start")(emb_grid(spark, sf_dir))
    return g.outputs["mask_counter_start"].select("pos", "nf", "nt", "nsamples", "unmasked", F.array_join("freqs", ",").alias("freqs"))


@query
def mask_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_measurements(mask_measurements(lineitem_grid(spark, sf_dir), LINE_CHUNK), 4).select("pos", "nsamples", "unmasked")


@query
def mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measurement_stats(mask_measurements(lineitem_grid(spark, sf_dir), LINE_CHUNK), 6)
    return out.select("nsamples", "unmasked", F.round("rfi_mask_pct_masked", 6).alias("pct_masked"))


@query
def variance_v1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance_v1(emb_grid(spark, sf_dir), V1).select("v1_idx", "freq", F.round("v1", 6).alias("v1"))


@query
def variance_v2_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = VarianceEstimator("", V1, V2, 80)(emb_grid(spark, sf_dir))
    return g.outputs["variance"].select("freq", "v2_idx", F.round("time", 6).alias("time"), F.round("variance", 6).alias("variance"))


def line_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variance table with some zeros: estimates that are too low count as none."""
    g = lineitem_grid(spark, sf_dir)
    out = variance_v2(variance_v1(g, 32), 4, 10**6)
    cell = F.when((F.col("freq") * 5 + F.col("v2_idx") * 3) % 7 == 0, 0.0).otherwise(F.col("variance"))
    return out.select("freq", "v2_idx", ((F.col("v2_idx") + 0.5) * (128 * g.meta.dt_sample)).alias("time"), cell.alias("variance"))


@query
def variance_interp_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = lineitem_grid(spark, sf_dir).cells.select((F.col("t") * 1e-3).alias("ts"), "freq")
    return evaluate(interpolate_zeros(line_variance(spark, sf_dir)), asks).select("freq", F.round("ts", 6).alias("ts"), F.round("v", 5).alias("v"))


@query
def variance_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lineitem_grid(spark, sf_dir)
    fine, coarse = variance_v2(variance_v1(g, 32), 2, 10**6), variance_v2(variance_v1(g, 32), 8, 10**6)
    return compare_variances(fine, coarse, 4).select("freq", "v2_idx", F.round("ratio", 6).alias("ratio"))


@query
def mask_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid samples stay and weights become 2 or 0; the noise itself is random by hash and not returned."""
    table = line_variance(spark, sf_dir)
    g = lineitem_grid(spark, sf_dir)
    g = PipelineFork([("WEIGHTS", "before")])(g)
    out = MaskFiller("", 0.9, LINE_CHUNK, variance=table)(g).cells
    kept = F.when(F.col("before") > 0.9, F.col("intensity"))
    return out.groupBy("freq").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") > 0.9).alias("valid"), F.sum("weight").alias("wsum"), F.round(F.sum(kept), 4).alias("kept"))


@query
def spectrum_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SpectrumAnalyzer(4, 8)(emb_grid(spark, sf_dir)).outputs["spectrum"]
    return out.select("chunk", "freq", F.round("value", 6).alias("value"))


@query
def stripe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = FunctionTransform(lambda df, m: df.withColumn("intensity", F.col("intensity") + 3.0))(emb_grid(spark, sf_dir))
    out = StripeAnalyzer(4, 2, 8)(g).outputs["stripes"]
    return out.select("chunk", "block", "u", F.round("value", 6).alias("value"))


@query
def bitmask_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_mask(emb_grid(spark, sf_dir))


@query
def bitmask_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_mask(pack_mask(event_grid(spark, sf_dir)))


@query
def zoom_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zoom_pyramid(lineitem_grid(spark, sf_dir), 4)
    return out.select("zoom", "t", "freq", F.round("intensity", 9).alias("intensity"), F.round("weight", 9).alias("weight"))


@query
def max_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_pool(emb_grid(spark, sf_dir).cells, "intensity", {"t": 16, "freq": 4}).withColumn("intensity", F.round("intensity", 6))


@query
def waterfall_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = downsample(emb_grid(spark, sf_dir), 4, 4).df.withColumn("tile", F.expr("t div 128"))
    out = colour_tiles(low, ["tile"], 2, 2.5)
    return out.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.sum("red").alias("red"), F.sum("blue").alias("blue"))


@query
def plotter_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PlotterTransform("w", 16, 32, 2, 3)(emb_grid(spark, sf_dir)).outputs["tiles_w"]
    return out.groupBy("zoom", "tile").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x_max"), F.round(F.sum("weight"), 4).alias("wsum"), F.sum("red").alias("red"))


@query
def dedisperse_trial_dm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedisperse(emb_grid(spark, sf_dir), DMS)
    return out.select("dm_idx", "t", F.round("value", 6).alias("value"), F.round("norm", 6).alias("norm"))


@query
def coarse_dm_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coarse_triggers(dedisperse(emb_grid(spark, sf_dir), DMS), 2, 32)
    return out.select("dm_bin", "t_bin", F.round("trigger", 6).alias("trigger"))


@query
def global_max_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = global_max(dedisperse(emb_grid(spark, sf_dir), DMS), 5.0, 50.0)
    return out.select(F.round("value", 6).alias("value"), "dm", "t")


@query
def frb_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pulse of known place is found again: what the search returns after injection."""
    g = FrbInjector(snr=60.0, undispersed_arrival_time=0.2, dm=20.0, intrinsic_width=0.001)(emb_grid(spark, sf_dir))
    out = global_max(dedisperse(g, DMS))
    return out.select(F.round("value", 4).alias("value"), "dm", "t")


@query
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(event_grid(spark, sf_dir), 0, 720).cells.select("t", "freq", F.round("intensity", 6).alias("intensity"), "weight")


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition cells of the embeddings: files of 50 samples, each second one in rising channel order, with a gap after every third."""
    a = acquisition(emb_grid(spark, sf_dir))
    n = F.floor(F.col("time") * 1000 / 50 + 1e-6)
    up = n % 2 == 1
    time = 20.0 + (F.round(F.col("time") * 1000) + F.floor(n / 3) * 7) / 1000
    return a.withColumns({"file": F.format_string("%08d", n.cast("long")), "increasing": up, "freq": F.when(up, F.col("nfreq") - 1 - F.col("freq")).otherwise(F.col("freq")), "time": time})


@query
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(acquisitions(spark, sf_dir)).cells, EMB_CHUNK)


@query
def noise_align_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream begins at a multiple of 64 samples of the noise source's period."""
    dt = 2.56e-6 * 512
    a = acquisitions(spark, sf_dir).withColumn("dt_sample", F.lit(dt)).withColumn("time", F.round(F.col("time") * 1000) * dt)
    return summary(scan(a, align=64).cells, EMB_CHUNK)


@query
def packet_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(emb_grid(spark, sf_dir), 2, 16, 2.0, coarse=8).select("t0", "f0", "n", "unmasked")


@query
def tumbling_chunk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_grid(spark, sf_dir)
    out = group_stats(g.cells.withColumn("chunk", F.expr(f"t div {EVENT_CHUNK}")), ["chunk", "freq"])
    return out.select("chunk", "freq", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), "total")


@query
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running total of weight per channel: a frame from the start."""
    w = Window.partitionBy("freq").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return event_grid(spark, sf_dir).cells.select("t", "freq", F.sum("weight").over(w).alias("running"))


@query
def gaussian_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a synthetic stream, and whether its moments are within five standard errors."""
    g = GaussianNoiseStream(32, 4096, 400.0, 800.0, 1e-3, 2.0, seed=3).load(spark)
    n = 32 * 4096
    return g.df.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("intensity")) < 5 * 2 / n**0.5).alias("mean_ok"), (F.abs(F.stddev("intensity") - 2) < 5 * 2 / (2 * n) ** 0.5).alias("rms_ok"))


@query
def dummy_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = DummyNetworkStream(64, 1, pool_gb=1e-3).load(spark)
    return g.df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("freq").alias("nfreq"), F.max("t").alias("t_max"), F.sum("weight").alias("wsum"))


def production() -> list[Operator]:
    """A chain as in production: clip at low resolution, detrend, clip again."""
    return [
        BadChannelMask(mask_ranges=RANGES),
        SubPipeline(Pipeline([IntensityClipper(64, "time", 1.5), IntensityClipper(64, "freq", 1.5), StdDevClipper(64, "time", 1.6)]), Df=2, Dt=2),
        PolynomialDetrender(64, "time", 1),
        PolynomialDetrender(64, "freq", 2),
        IntensityClipper(64, "time", 2.0, niter=2),
    ]


on_embeddings("full_chain", lambda: Pipeline(production()))
on_embeddings("full_chain_fused", lambda: FusedChain(production(), 64))


@query
def full_chain_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = emb_grid(spark, sf_dir)
    out = FusedChain(production(), 64).apply_packed(pack_cells(g, 64, "<f8"), g.meta, "<f8")
    # packing fills a chunk's missing samples with weight 0; the stream ends before them
    end = g.df.agg(F.coalesce(F.max("t"), F.lit(-1))).first()[0]
    return summary(unpack_cells(out, g.meta, 64, "<f8").df.where(F.col("t") <= end), EMB_CHUNK)


@query
def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as acquisition files of several parts, and read back."""
    g = emb_grid(spark, sf_dir)
    at = shared_path(spark, "acquisition")
    FileWriter(f"{at}/00000000.parquet")(g.with_df(g.df.repartition(4, "freq")))
    return summary(FileStream.from_acqdir(at).load(spark).cells, EMB_CHUNK)


@query
def packed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed chunks written, read back, and taken through a chain, without rows of cells between."""
    at = shared_path(spark, "packed")
    Packed.of(emb_grid(spark, sf_dir), 64, "<f8").write(at)
    return summary(Pipeline([PackedFileStream(at), *production()]).run_packed(spark).cells().df, EMB_CHUNK)


@query
def array_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain on plain arrays, a chunk at a time, by a user's function."""

    def each(t: pa.Table) -> pa.Table:
        f, k = t["freq"].to_numpy(), t["t"].to_numpy() % 64
        i, w = np.zeros((64, 64)), np.zeros((64, 64))
        i[f, k], w[f, k] = t["intensity"].to_numpy(), t["weight"].to_numpy()
        i, w = apply_to_arrays(Pipeline(production()), i, w, freq_lo_MHz=400.0, freq_hi_MHz=800.0)
        return pa.table([t["t"], t["freq"], pa.array(i[f, k]), pa.array(w[f, k])], names=list(CELL))

    cells = emb_grid(spark, sf_dir).cells.select(*CELL)
    return summary(cells.groupBy(F.expr("t div 64")).applyInArrow(each, SCHEMA), EMB_CHUNK)
