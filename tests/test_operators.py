"""Operators against array implementations on random grids, and identities between operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom.functions.stats as stats_module
from gridloom.functions.resample import downsample, pack_mask, unpack_mask, upsample, zoom_pyramid
from gridloom.functions.stats import group_stats, window_stats
from gridloom.grid import Grid, densify
from gridloom.operators.analyzers import VarianceEstimator
from gridloom.operators.clippers import IntensityClipper, KurtosisFilter, StdDevClipper
from gridloom.operators.containers import Pipeline, PipelineFork, Reverter, Saver, SubPipeline
from gridloom.operators.dedispersion import Dedisperser, FrbInjector, dedisperse, global_max, shifts
from gridloom.operators.detrenders import PolynomialDetrender, RCDetrender, SplineDetrender
from gridloom.operators.fillers import MaskFiller, NoiseFiller, OnlineMaskFiller, interpolate_zeros
from gridloom.operators.masks import AdversarialMasker, BadChannelMask, MaskCounter, MaskExpander, ThermalNoiseWeight, channel_ranges, mask_rectangles

from .arrays import arrays_of, block_mean, clip, grid_of, grow, mean_rms, random_grid, std_clip

RNG = np.random.default_rng(23)


def test_both_forms_of_statistics_agree_with_arrays(spark):
    i, w = random_grid(RNG, 6, 32)
    i[1] += 1e4
    w[2] = 0
    i[3] = 5.0
    g = grid_of(spark, i, w)
    windows = {r.freq: (r["__mean"], r["__rms"]) for r in window_stats(g.df, ["freq"], 3, 1.5).select("freq", "__mean", "__rms").distinct().collect()}
    groups = {r.freq: (r["mean"], r["rms"]) for r in group_stats(g.df, ["freq"], 3, 1.5, cut_passes=True).collect()}
    for f in range(6):
        want = mean_rms(i[f], w[f], 3, 1.5)
        assert windows[f] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert groups[f] == pytest.approx(want, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("axis", ["time", "freq", "none"])
@pytest.mark.parametrize(("df", "dt", "niter"), [(1, 1, 1), (1, 1, 3), (2, 4, 2)])
def test_intensity_clipper(spark, axis, df, dt, niter):
    i, w = random_grid(RNG, 8, 48)
    w[:, 16:32] *= RNG.uniform(size=(8, 16)) > 0.7
    w[3] = 0
    _, got = arrays_of(IntensityClipper(16, axis, 1.3, niter, 1.5, df, dt)(grid_of(spark, i, w)), 48)
    np.testing.assert_allclose(got, clip(i, w, axis, 16, 1.3, niter, 1.5, df, dt))


def test_large_groups_take_the_two_phase_path(spark, monkeypatch):
    i, w = random_grid(RNG, 8, 32)
    monkeypatch.setattr(stats_module, "GROUP_CELLS", 0)
    _, got = arrays_of(IntensityClipper(16, "none", 1.3, 3)(grid_of(spark, i, w)), 32)
    np.testing.assert_allclose(got, clip(i, w, "none", 16, 1.3, 3))


def test_clipping_along_time_is_clipping_each_row_block(spark):
    i, w = random_grid(RNG, 4, 32)
    _, got = arrays_of(IntensityClipper(32, "time", 1.2, Df=2)(grid_of(spark, i, w)), 32)
    for k in (0, 2):
        _, part = arrays_of(IntensityClipper(32, "none", 1.2, Df=2)(grid_of(spark, i[k : k + 2], w[k : k + 2])), 32)
        np.testing.assert_allclose(got[k : k + 2], part)


@pytest.mark.parametrize("axis", ["time", "freq"])
@pytest.mark.parametrize(("df", "dt"), [(1, 1), (2, 2)])
def test_std_dev_clipper(spark, axis, df, dt):
    i, w = random_grid(RNG, 8, 32)
    i[5] *= 4
    w[2] = 0
    _, got = arrays_of(StdDevClipper(16, axis, 1.2, df, dt)(grid_of(spark, i, w)), 32)
    np.testing.assert_allclose(got, std_clip(i, w, axis, 16, 1.2, df, dt))


@pytest.mark.parametrize("axis", ["time", "freq"])
@pytest.mark.parametrize("degree", [0, 1, 3, 4, 6])
def test_polynomial_detrender(spark, axis, degree):
    nfreq, nt, chunk = 12, 32, 16
    i, w = random_grid(RNG, nfreq, nt, 0.1)
    if axis == "time":
        w[3, :chunk] = 0
        w[3, :degree] = 1.0
    else:
        w[:, 3] = 0
        w[:degree, 3] = 1.0
    gi, gw = arrays_of(PolynomialDetrender(chunk, axis, degree, 1e-4)(grid_of(spark, i, w)), nt)
    rows = [(f, slice(a, a + chunk)) for f in range(nfreq) for a in range(0, nt, chunk)] if axis == "time" else [(slice(None), t) for t in range(nt)]
    for c in rows:
        x, y = i[c], w[c]
        basis = np.polynomial.legendre.legvander(np.linspace(-1, 1, len(x)), degree)
        if (y > 0).sum() <= degree:
            assert (gw[c] == 0).all()
            continue
        assert (gw[c] == y).all()
        k = np.linalg.lstsq(basis * np.sqrt(y)[:, None], x * np.sqrt(y), rcond=None)[0]
        np.testing.assert_allclose(gi[c] * y, (x - basis @ k) * y, atol=1e-7)


def test_spline_detrender_takes_smooth_shapes_out(spark):
    f = np.linspace(0, 1, 64)
    shape = np.sin(5 * f) + f**2
    i = np.repeat(shape[:, None], 70, 1)
    _, w = random_grid(RNG, 64, 70)
    w[:, 7] = 0
    gi, gw = arrays_of(SplineDetrender(64, "freq", 4, 1e-6)(grid_of(spark, i, w)), 70)
    assert (gw[:, 7] == 0).all()
    assert np.abs(gi * gw).max() < 1e-2
    assert ((gw > 0) == (w > 0)).all()


def rc_by_definition(i, w, a, chunk):
    out = i.copy()
    for f in range(i.shape[0]):
        fw = dfw = 0.0
        for c in range(0, i.shape[1], chunk):
            n = min(chunk, i.shape[1] - c)
            x, on = np.zeros(chunk), np.zeros(chunk, bool)
            x[:n], on[:n] = i[f, c : c + n], w[f, c : c + n] != 0
            F_, D = np.zeros(chunk), np.zeros(chunk)
            for k in range(chunk):
                if on[k]:
                    new = fw * a + x[k] * (1 - a)
                    dfw = dfw * a + (new - fw) * (1 - a)
                    fw = new
                F_[k], D[k] = fw, dfw
            b, e = F_[-1], 0.0
            B, E = np.zeros(chunk), np.zeros(chunk)
            B[-1] = b
            for k in range(chunk - 2, -1, -1):
                if on[k]:
                    new = b * a + x[k] * (1 - a)
                    e = e * a + (new - b) * (1 - a)
                    b = new
                B[k], E[k] = b, e
            out[f, c : c + n] -= np.where(np.abs(D) < np.abs(E), F_, B)[:n]
    return out


def test_rc_detrender_runs_on_over_chunks(spark):
    i, w = random_grid(RNG, 3, 40)
    gi, _ = arrays_of(RCDetrender(16, 0.8)(grid_of(spark, i, w)), 40)
    np.testing.assert_allclose(gi, rc_by_definition(i, w, 0.8, 16), atol=1e-12)


@pytest.mark.parametrize(("width", "alpha"), [(0.1, 0.3), (0.05, -0.5), (5e-4, 0.0)])
def test_mask_expander(spark, width, alpha):
    nfreq, th = 24, 0.4
    i, w = random_grid(RNG, nfreq, 12, 0.1)
    g = PipelineFork([("WEIGHTS", "prev")])(grid_of(spark, i, w))
    now = w * (RNG.uniform(size=w.shape) > 0.5)
    g = g.with_df(g.df.drop("weight").join(grid_of(spark, i, now).df.select("t", "freq", "weight"), ["t", "freq"]))
    _, got = arrays_of(MaskExpander("prev", width, th, alpha)(g), 12)
    a = math.exp(-1 / (width * nfreq))
    b = (1 - th) / (1 - a)
    vp = 1 - th + alpha * th if alpha >= 0 else (1 + alpha) * (1 - th)
    x = np.where(now > 0, 1.0, np.where(w > 0, 0.0, vp))
    up, down = np.zeros_like(x), np.zeros_like(x)
    s = np.full(12, vp / (1 - a))
    for k in range(nfreq):
        s = x[k] + a * s
        up[k] = s
    s = np.full(12, vp / (1 - a))
    for k in range(nfreq - 1, -1, -1):
        s = x[k] + a * s
        down[k] = s
    np.testing.assert_allclose(got, np.where((up < b) & (down < b), 0, now))


def test_sub_pipeline_equals_its_parts(spark):
    i, w = random_grid(RNG, 8, 32)
    w[:4, :8] = 0
    inner = IntensityClipper(16, "time", 1.2)
    gi, got = arrays_of(SubPipeline(inner, 0.4, Df=2, Dt=4)(grid_of(spark, i, w)), 32)
    bi, bw = block_mean(i, w, 2, 4)
    low = clip(bi, bw, "time", 4, 1.2)
    np.testing.assert_allclose(got, np.where(grow(low, 2, 4) > 0.4, w, 0))
    np.testing.assert_allclose(gi, i)


def test_sub_pipeline_factors(spark):
    g = grid_of(spark, *random_grid(RNG, 8, 16))
    assert SubPipeline(Pipeline(), nfreq_out=4, nds_out=2).factors(g.meta) == (2, 2)
    for bad in ({"Df": 3, "Dt": 1}, {"Df": 2}, {"Df": 2, "nfreq_out": 2, "Dt": 1}, {"Df": 2, "Dt": 2, "nds_out": 4}):
        with pytest.raises(ValueError):
            SubPipeline(Pipeline(), **bad).bind(g.meta)
    with pytest.raises(ValueError):  # detrenders may run inside, expanders may not
        SubPipeline(ThermalNoiseWeight(16), Df=2, Dt=2).bind(g.meta)


def test_saver_and_reverter(spark):
    i, w = random_grid(RNG, 4, 16)
    gi, gw = arrays_of(Pipeline([Saver("a"), PolynomialDetrender(16, "time", 1), IntensityClipper(16, "none", 1.1), Reverter("a")])(grid_of(spark, i, w)), 16)
    np.testing.assert_allclose(gi, i)
    np.testing.assert_allclose(gw, w)


def test_bad_channels(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text("# MHz\n450.0, 460.0\n799.0,900.0  # over the edge\n")
    i, w = random_grid(RNG, 40, 4, 0)
    _, got = arrays_of(BadChannelMask(str(path), [(600.0, 610.0)])(grid_of(spark, i, w)), 4)
    assert sorted(np.flatnonzero(got.sum(1) == 0)) == [0, 19, 34]
    meta = grid_of(spark, i, w).meta
    for bad in ((300.0, 310.0), (300.0, 900.0), (500.0, 500.0)):
        with pytest.raises(ValueError):
            channel_ranges([bad], meta)


def test_rectangles(spark):
    i, w = random_grid(RNG, 16, 64, 0)
    rects = [(0, 4, 0, 10), (2, 16, 8, 20), (5, 6, 0, 64)]
    _, got = arrays_of(mask_rectangles(grid_of(spark, i, w), rects, 16), 64)
    want = w.copy()
    for a, b, c, d in rects:
        want[a:b, c:d] = 0
    np.testing.assert_allclose(got, want)


def test_adversarial_masker_is_repeatable(spark):
    g = grid_of(spark, *random_grid(RNG, 16, 256, 0))
    op = AdversarialMasker(64, 64, 6000, 5)
    a, b = arrays_of(op(g), 256)[1], arrays_of(op(g), 256)[1]
    np.testing.assert_allclose(a, b)
    rects, coins = op.layout(16)
    assert 0 < (a == 0).mean() < 1 and len(coins) == 8 and all(0 <= r[0] < r[1] <= 16 for r in rects)


def test_mask_counter_counts_missing_channels_as_masked(spark):
    i, w = random_grid(RNG, 4, 20)
    g = grid_of(spark, i, w)
    g = g.with_df(g.df.where("freq <> 2"))
    got = MaskCounter(16, "x")(g).outputs["mask_counter_x"].orderBy("pos").collect()
    on = w > 0
    on[2] = False
    assert [r.unmasked for r in got] == [on[:, :16].sum(), on[:, 16:].sum()]
    assert got[0].freqs == on[:, :16].sum(1).tolist() and got[0].nsamples == 64
    with pytest.raises(ValueError):
        Pipeline([MaskCounter(16, "x"), MaskCounter(16, "x")]).bind(g.meta)


def test_kurtosis(spark):
    i, w = random_grid(RNG, 4, 32, 0)
    i[1, 5] = 100.0
    i[2] = 1.0
    _, got = arrays_of(KurtosisFilter((-3.0, 3.0), 32)(grid_of(spark, i, w)), 32)
    assert (got[1] == 0).all() and (got[2] == 0).all() and (got[0] > 0).all()


def online_by_definition(i, w, p):
    var, wt = np.zeros(len(i)), np.zeros(len(i))
    out = np.zeros_like(w)
    for a in range(0, i.shape[1], p.v1_chunk):
        x, y = i[:, a : a + p.v1_chunk], w[:, a : a + p.v1_chunk]
        for f in range(len(i)):
            ok = (y[f] != 0).sum() >= 0.25 * p.v1_chunk
            v = np.average(x[f] ** 2, weights=y[f]) if ok else 0.0
            if v:
                wt[f] = min(2.0, wt[f] + p.w_clamp)
                step = p.var_clamp_add + var[f] * p.var_clamp_mult
                var[f] = max(min((1 - p.var_weight) * var[f] + p.var_weight * v, var[f] + step), var[f] - step)
            else:
                wt[f] = max(0.0, wt[f] - p.w_clamp)
        out[:, a : a + p.v1_chunk] = wt[:, None]
    return out


def test_online_mask_filler(spark):
    p = OnlineMaskFiller(8, 0.2, 0.05, 0.1, 0.3, 0.6, 16)
    i, w = random_grid(RNG, 3, 64)
    w[1, 16:32] = 0
    gi, gw = arrays_of(p(grid_of(spark, i, w)), 64)
    np.testing.assert_allclose(gw, online_by_definition(i, w, p), atol=1e-12)
    np.testing.assert_allclose(gi[w > 0.6], i[w > 0.6])


def test_variance_and_mask_filler(spark, tmp_path):
    i, w = random_grid(RNG, 4, 256)
    w[1] = 0
    path = str(tmp_path / "var")
    VarianceEstimator(path, 16, 4, 64)(grid_of(spark, i, w))
    table = spark.read.parquet(path)
    rows = {(r.freq, r.v2_idx): r.variance for r in table.collect()}
    v1 = [np.average(i[0, a : a + 16] ** 2, weights=w[0, a : a + 16]) for a in range(64, 128, 16)]
    assert rows[0, 1] == pytest.approx(np.median(v1)) and rows[1, 0] == 0
    g = MaskFiller(path, 0.7, 64)(grid_of(spark, i, w))
    gi, gw = arrays_of(g, 256)
    assert (gw[1] == 0).all() and (gw[0] == 2).all()
    np.testing.assert_allclose(gi[w > 0.7], i[w > 0.7])
    assert np.abs(gi[0][w[0] <= 0.7].std() - 1) < 0.4


def test_zeros_are_interpolated(spark):
    rows = [(0, k, k * 1.0, v) for k, v in enumerate([0.0, 2.0, 0.0, 0.0, 8.0, 0.0])] + [(1, k, k * 1.0, 1.0 if k == 3 else 0.0) for k in range(6)]
    got = interpolate_zeros(spark.createDataFrame(rows, "freq int, v2_idx long, time double, variance double"))
    by = {(r.freq, r.v2_idx): r.variance for r in got.collect()}
    assert [by[0, k] for k in range(6)] == [2, 2, 4, 6, 8, 8]
    assert all(by[1, k] == 0 for k in range(6))


def test_noise_filler_scale(spark):
    i, w = random_grid(RNG, 2, 512, 0)
    g = NoiseFiller(256, 1.0, 4)(grid_of(spark, i, w))
    gi, _ = arrays_of(g, 512)
    used = {(r.freq, r.chunk): r.variance for r in g.outputs["noise_variance"].collect()}
    for f in range(2):
        for c in range(2):
            assert gi[f, c * 256 : (c + 1) * 256].std() == pytest.approx(math.sqrt(used[f, c]), rel=0.2)


def test_dedispersion_against_loops(spark):
    i, w = random_grid(RNG, 16, 96)
    g = grid_of(spark, i, w)
    dms = [0.0, 15.0, 40.0]
    got = {(r.dm_idx, r.t): r.value for r in dedisperse(g, dms).collect()}
    s = {(k, f): n for k, _, f, n in shifts(g.meta, dms)}
    for k in range(3):
        for t in range(0, 96, 7):
            at = [(f, t + s[k, f]) for f in range(16) if t + s[k, f] < 96]
            num = sum(w[c] * i[c] for c in at)
            den = math.sqrt(sum(w[c] ** 2 for c in at))
            if den:
                assert got[k, t] == pytest.approx(num / den)


def test_injected_pulse_is_found(spark):
    i, _ = random_grid(RNG, 32, 512)
    g = grid_of(spark, i, np.ones_like(i))
    g = FrbInjector(80.0, 0.1, 30.0, intrinsic_width=1e-3)(g)
    best = global_max(dedisperse(g, [0.0, 15.0, 30.0, 45.0])).first()
    assert best.dm == 30.0 and best.value > 20 and abs(best.t - 1000 * (0.1 + 4.148808e-3 * 30 / 0.64)) < 4
    out = Dedisperser(config={"max_dm": 45.0, "nt_per_trigger": 16}, ntrial=4, track_global_max=True)(g).outputs
    assert out["global_max"].first().dm == 30.0 and out["triggers"].count() > 0
    with pytest.raises(ValueError):
        Dedisperser(config={"nfreq": 5}).bind(g.meta)


def test_resampling(spark):
    i, w = random_grid(RNG, 4, 16)
    g = grid_of(spark, i, w)
    low = downsample(g, 2, 4)
    bi, bw = block_mean(i, w, 2, 4)
    gi, gw = arrays_of(low, 4)
    np.testing.assert_allclose(gi, bi)
    np.testing.assert_allclose(gw, bw)
    ui, _ = arrays_of(upsample(low, 2, 4), 16)
    np.testing.assert_allclose(ui, grow(bi, 2, 4))
    z = {(r.zoom, r.t, r.freq): r.weight for r in zoom_pyramid(g, 3).collect()}
    assert z[2, 4, 1] == pytest.approx(w[1, 4:8].sum())
    assert {(r.t, r.freq) for r in unpack_mask(pack_mask(g)).collect()} == {(t, f) for f, t in zip(*np.nonzero(w), strict=True)}


def test_densify_keeps_cells_and_saved_buffers(spark):
    i, w = random_grid(RNG, 3, 8)
    g = Saver("s")(grid_of(spark, i, w))
    g = densify(g.with_df(g.df.where("t % 2 = 0")), 0, 8)
    gi, gw = arrays_of(g, 8)
    assert g.cells.count() == 24 and (gw[:, 1::2] == 0).all()
    np.testing.assert_allclose(gi[:, ::2], i[:, ::2])
    assert g.cells.where("s_weight IS NULL").count() == 0


def test_empty_grids_pass(spark):
    g = grid_of(spark, *random_grid(RNG, 4, 16))
    empty = Grid(g.df.limit(0), g.meta)
    chain = Pipeline([BadChannelMask(mask_ranges=[(500.0, 510.0)]), IntensityClipper(16, "time", 2.0), StdDevClipper(16, "time", 2.0), PolynomialDetrender(16, "freq", 1), SubPipeline(IntensityClipper(16, "none", 2.0), Df=2, Dt=2)])
    assert chain(empty).cells.count() == 0


def test_one_axis_one_shuffle(spark):
    """Consecutive passes and operators along the same axis share one exchange."""
    g = grid_of(spark, *random_grid(RNG, 4, 64))
    out = Pipeline([IntensityClipper(16, "time", 2.0, niter=3), PolynomialDetrender(16, "time", 2), IntensityClipper(16, "time", 2.0)])(g).cells
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert out.select(F.sum("weight")).first()[0] > 0


def test_trigger_tiles(spark):
    from gridloom.operators.dedispersion import DedisperserPlots

    i, w = random_grid(RNG, 8, 128)
    g = DedisperserPlots(config={"max_dm": 5.0, "nt_per_trigger": 4}, ntrial=8, img_ndm=4, img_nt=8, n_zoom=2, plot_threshold1=1.0, plot_threshold2=2.0)(grid_of(spark, i, w))
    tiles = g.outputs["trigger_tiles"].collect()
    top = max(r.trigger for r in g.outputs["triggers"].collect())
    assert max(r.trigger for r in tiles) == top and {r.zoom for r in tiles} == {0, 1} and max(r.y for r in tiles) == 3 and max(r.x for r in tiles) == 7
    assert all(r.hot == (r.trigger >= 1) + (r.trigger >= 2) for r in tiles)


def production_chain():
    return [
        BadChannelMask(mask_ranges=[(500.0, 510.0)]),
        SubPipeline(Pipeline([IntensityClipper(16, "time", 1.5, 2), IntensityClipper(16, "none", 1.6), StdDevClipper(32, "time", 1.5), StdDevClipper(16, "freq", 1.6)]), 0.2, Df=2, Dt=2),
        PolynomialDetrender(16, "time", 2),
        SplineDetrender(0, "freq", 2),
        PolynomialDetrender(0, "freq", 1),
        IntensityClipper(32, "freq", 1.7, 2, Df=2, Dt=4),
    ]


def test_fused_chain_equals_its_operators(spark, monkeypatch):
    from gridloom.operators import containers
    from gridloom.operators.fused import FusedChain, fusible, pack_cells, runs, unpack_cells

    i, w = random_grid(RNG, 16, 80)
    w[:, 40:44] = 0
    g = grid_of(spark, i, w)
    chain = FusedChain(production_chain(), 32)
    assert fusible(chain) and not fusible(FusedChain([RCDetrender()]))
    assert [type(x) for x in runs([*production_chain(), RCDetrender(16), *production_chain()[:1]], g, 3)] == [FusedChain, RCDetrender, type(production_chain()[0])]
    by_default = arrays_of(Pipeline(production_chain())(g), 80)
    monkeypatch.setattr(containers, "FUSE", 1000)
    want_i, want_w = arrays_of(Pipeline(production_chain())(g), 80)
    np.testing.assert_allclose(by_default[1], want_w)
    np.testing.assert_allclose(by_default[0] * by_default[1], want_i * want_w, atol=1e-9)
    got_i, got_w = arrays_of(chain(g), 80)
    np.testing.assert_allclose(got_w, want_w)
    np.testing.assert_allclose(got_i * got_w, want_i * want_w, atol=1e-9)
    packed = pack_cells(g, 32, "<f8")
    assert packed.count() == 16 * 3
    back = unpack_cells(chain.apply_packed(packed, g.meta, "<f8"), g.meta, 32, "<f8")
    pi, pw = arrays_of(back, 96)
    np.testing.assert_allclose(pw[:, :80], want_w)
    assert (pw[:, 80:] == 0).all()
    np.testing.assert_allclose(pi[:, :80] * pw[:, :80], want_i * want_w, atol=1e-9)
    floats, _ = arrays_of(unpack_cells(pack_cells(g, 32), g.meta, 32), 96)
    np.testing.assert_allclose(floats[:, :80], i, rtol=1e-6)
    for bad in (FusedChain([IntensityClipper(24, "time", 2.0)], 32), FusedChain([RCDetrender(16)], 32)):
        with pytest.raises(ValueError):
            bad.bind(g.meta)


def test_operators_on_plain_arrays():
    from gridloom.operators.fused import apply_to_arrays

    i, w = random_grid(RNG, 8, 32)
    before = w.copy()
    _, got = apply_to_arrays(IntensityClipper(32, "none", 1.3, 2, Df=2, Dt=4), i, w)
    np.testing.assert_allclose(got, clip(i, w, "none", 32, 1.3, 2, 0, 2, 4))
    np.testing.assert_allclose(w, before)
    _, got = apply_to_arrays(StdDevClipper(16, "time", 1.2), i, w)
    np.testing.assert_allclose(got, std_clip(i, w, "time", 16, 1.2))
    with pytest.raises(ValueError):
        apply_to_arrays(RCDetrender(32), i, w)


def test_packed_from_source_to_sink(spark, tmp_path):
    """A source that makes chunks, a chain on them, files, and the files again: no shuffle before the sink, and one value for every cell."""
    from gridloom.operators.base import from_json
    from gridloom.operators.fused import FusedChain, Packed, PackedFileStream
    from gridloom.sources.synthetic import GaussianNoiseStream

    source = GaussianNoiseStream(12, 150, 400.0, 800.0, 1e-3, sample_rms=2.0, randomize_weights=True, seed=5)
    raw = source.load_packed(spark, 64)
    assert raw.together and raw.df.count() == 36
    i, w = arrays_of(raw.cells(), 150)
    assert 1.8 < i.std() < 2.2 and 0.45 < w.mean() < 0.55
    ops = [IntensityClipper(32, "time", 1.5), StdDevClipper(16, "time", 1.4), PolynomialDetrender(32, "time", 1)]
    done = Pipeline([source, *ops]).run_packed(spark, 64)
    assert "Exchange" not in done.df._jdf.queryExecution().toString()
    want = arrays_of(FusedChain(ops, 64)(grid_of(spark, i, w)), 150)
    got = arrays_of(done.cells(), 150)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-6)
    np.testing.assert_allclose(got[0] * got[1], want[0] * want[1], atol=1e-5)
    done.write(str(tmp_path / "packed"))
    stream = from_json(PackedFileStream(str(tmp_path / "packed")).jsonize())
    back = arrays_of(stream.load(spark), 150)
    np.testing.assert_allclose(back, got)
    assert stream.load_packed(spark, 64).meta.nfreq == 12
    again = Pipeline([stream, IntensityClipper(32, "time", 100.0)]).run_packed(spark)
    np.testing.assert_allclose(arrays_of(again.cells(), 150)[1], got[1])
    with pytest.raises(ValueError):
        stream.load_packed(spark, 32)
    with pytest.raises(ValueError):
        Pipeline([source, RCDetrender(32)]).run_packed(spark, 64)
    assert Packed.of(grid_of(spark, i, w).with_df(grid_of(spark, i, w).df.limit(0)), 64).cells().df.count() == 0


def test_a_stream_of_one_sample_has_a_chunk(spark):
    from gridloom.operators.analyzers import VarianceEstimator

    g = grid_of(spark, np.ones((2, 1)), np.ones((2, 1)), t_initial=0.0, dt_sample=1e-3)
    assert VarianceEstimator(None, 4, 2, 8)(g).outputs["variance"].count() == 2
