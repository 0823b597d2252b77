"""DuckDB SQL for the registered queries, written from the operators' definitions and not from their plans."""

from __future__ import annotations

import math

from ..operators.masks import RIPPLE
from .queries import DMS, RANGES, RECTS, V1, V2

EMB = """(SELECT vec_id AS t, CAST(k - 1 AS INTEGER) AS freq, CAST(embedding[k] AS DOUBLE) AS intensity,
  CAST(CASE WHEN (vec_id * 7 + (k - 1) * 13) % 11 = 0 THEN 0 ELSE 1 + (vec_id + k - 1) % 3 END AS DOUBLE) AS weight
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"""
EVENTS = """(SELECT CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS t, CAST(user_id % 16 AS INTEGER) AS freq, avg(value) AS intensity,
  CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1, 2)"""
LINES = """(SELECT date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS t, CAST(l_suppkey % 32 AS INTEGER) AS freq,
  sum(l_quantity * (1 - l_discount)) / sum(1 - l_discount) AS intensity, sum(1 - l_discount) AS weight FROM lineitem GROUP BY 1, 2)"""


def summary(src: str, chunk: int) -> str:
    return f"""SELECT freq, t // {chunk} AS chunk, count(*) AS n, count(*) FILTER (weight > 0) AS unmasked, round(sum(weight), 4) AS wsum,
  round(sum(CASE WHEN weight > 0 THEN weight * intensity ELSE 0 END), 4) AS wisum FROM {src} GROUP BY 1, 2"""


def stats(src: str, keys: str, niter: int, sigma: float, i: str = "intensity", w: str = "weight") -> str:
    """src with mean and rms per group."""
    q = f"SELECT *, {w} AS w0 FROM {src}"
    for p in range(niter):
        if p:
            q = f"SELECT * EXCLUDE (w0, mean, rms), CASE WHEN abs({i} - mean) < {sigma}e0 * rms THEN w0 ELSE 0e0 END AS w0 FROM ({q})"
        q = f"SELECT *, sum(w0) OVER k AS tot, coalesce(sum(w0 * {i}) OVER k / nullif(sum(w0) OVER k, 0), 0) AS mean FROM ({q}) WINDOW k AS (PARTITION BY {keys})"
        q = f"SELECT *, sum(w0 * ({i} - mean) * ({i} - mean)) OVER k / nullif(tot, 0) AS v FROM ({q}) WINDOW k AS (PARTITION BY {keys})"
        q = f"SELECT * EXCLUDE (tot, v), CASE WHEN tot > 0 AND v > 1e-10 * mean * mean THEN sqrt(v) ELSE 0e0 END AS rms FROM ({q})"
    return f"({q})"


def masked(src: str, keep: str, weight: str = "weight") -> str:
    return f"(SELECT t, freq, intensity, CASE WHEN {keep} THEN {weight} ELSE 0e0 END AS weight FROM {src})"


def blocks(src: str, df: int, dt: int, weights: str = "sum(weight)", nds: int = 1) -> str:
    """Downsampled src, bins at their first sample."""
    k = dt * nds
    return f"(SELECT t // {k} * {k} AS t, CAST(freq // {df} AS INTEGER) AS freq, coalesce(sum(weight * intensity) / nullif(sum(weight), 0), 0) AS intensity, {weights} AS weight FROM {src} GROUP BY 1, 2)"


def keep_low(high: str, low: str, df: int, dt: int, cutoff: float = 0) -> str:
    """high, masked where low's weight is at or below the cutoff."""
    return f"""(SELECT h.t, h.freq, h.intensity, CASE WHEN l.weight > {cutoff} THEN h.weight ELSE 0e0 END AS weight
  FROM {high} h LEFT JOIN {low} l ON h.t // {dt} * {dt} = l.t AND h.freq // {df} = l.freq)"""


def keys_of(axis: str, chunk: int) -> str:
    return {"time": f"t // {chunk}, freq", "freq": "t", "none": f"t // {chunk}"}[axis]


def clip(src: str, axis: str, chunk: int, sigma: float, niter: int = 1, iter_sigma: float = 0, df: int = 1, dt: int = 1) -> str:
    """Clipping by its definition: downsample, statistics of blocks, and the mask carried up."""
    low = src if df == dt == 1 else blocks(src, df, dt)
    low = masked(stats(low, keys_of(axis, chunk), niter, iter_sigma or sigma), f"abs(intensity - mean) < {sigma}e0 * rms")
    return low if df == dt == 1 else keep_low(src, low, df, dt)


def std_clip(src: str, axis: str, chunk: int, sigma: float, df: int = 1, dt: int = 1) -> str:
    low = src if df == dt == 1 else blocks(src, df, dt)
    row = "freq" if axis == "time" else "t"
    rows = f"(SELECT t // {chunk} AS c, {row} AS r, any_value(rms * rms) AS sd, any_value(CASE WHEN rms > 0 THEN 1e0 ELSE 0e0 END) AS sdw FROM {stats(low, f't // {chunk}, {row}', 1, 3)} GROUP BY 1, 2)"
    good = f"(SELECT c, r FROM {stats(rows, 'c', 1, 3, 'sd', 'sdw')} WHERE sdw > 0 AND abs(sd - mean) < {sigma}e0 * rms)"
    at = f"s.freq // {df}" if axis == "time" else f"s.t // {dt} * {dt}"
    return f"(SELECT t, freq, intensity, CASE WHEN g.c IS NULL THEN 0e0 ELSE weight END AS weight FROM {src} s LEFT JOIN {good} g ON s.t // {chunk} = g.c AND {at} = g.r)"


def detrend(src: str, axis: str, chunk: int, nfreq: int, degree: int, epsilon: float = 1e-2) -> str:
    """Weighted fit in monomials by Gram-Schmidt: each basis function is made orthogonal to those before, group by group."""
    size = nfreq if axis == "freq" else chunk
    at = "freq" if axis == "freq" else f"(t % {chunk})"
    keys = keys_of(axis, chunk)
    q = f"SELECT *, {at} * {2 / (size - 1)!r} - 1e0 AS x FROM {src}"
    legendre = ["1e0", "x", "(1.5e0 * x * x - 0.5e0)"]
    q = f"SELECT *, " + ", ".join(f"{legendre[d]} AS p{d}" for d in range(degree + 1)) + f" FROM ({q})"
    q = f"SELECT *, intensity AS r, TRUE AS good FROM ({q})"
    for d in range(degree + 1):
        # q{d}: p{d} without its parts along the earlier ones; its weighted square is the Cholesky pivot
        parts = "".join(f" - q{e} * (sum(weight * p{d} * q{e}) OVER k / nullif(sum(weight * q{e} * q{e}) OVER k, 0))" for e in range(d))
        q = f"SELECT *, p{d}{parts} AS q{d} FROM ({q}) WINDOW k AS (PARTITION BY {keys})"
        low = f"sum(weight * q{d} * q{d}) OVER k > " + (f"{epsilon} * sum(weight * p{d} * p{d}) OVER k" if d else "0")
        q = f"SELECT * EXCLUDE (r, good), good AND coalesce({low}, FALSE) AS good, r - q{d} * coalesce(sum(weight * intensity * q{d}) OVER k / nullif(sum(weight * q{d} * q{d}) OVER k, 0), 0) AS r FROM ({q}) WINDOW k AS (PARTITION BY {keys})"
    return f"(SELECT t, freq, CASE WHEN good THEN r ELSE intensity END AS intensity, CASE WHEN good THEN weight ELSE 0e0 END AS weight FROM ({q}))"


def bad_channels(ranges: list[tuple[float, float]], nfreq: int, low: float = 400.0, high: float = 800.0) -> str:
    """Channels whose band overlaps a range."""
    width = (high - low) / nfreq
    over = " OR ".join(f"({high} - freq * {width} > {a} + {width} * 1e-3 AND {high} - (freq + 1) * {width} < {b} - {width} * 1e-3)" for a, b in ranges)
    return f"({over})"


RECT = " OR ".join(f"(freq >= {a} AND freq < {b} AND t >= {c} AND t < {d})" for a, b, c, d in RECTS)


def expander_sql(before: str, src: str, width: float, th: float, alpha: float, nfreq: int) -> str:
    """Sums over all pairs of channels of a sample, as defined; channels that have no cell count as masked in both."""
    a = math.exp(-1 / (width * nfreq))
    b = (1 - th) / (1 - a)
    vp = 1 - th + alpha * th if alpha >= 0 else (1 + alpha) * (1 - th)
    vb = vp / (1 - a)
    x = f"(SELECT s.t, s.freq, s.intensity, s.weight, CASE WHEN s.weight > 0 THEN 1e0 WHEN p.weight > 0 THEN 0e0 ELSE {vp!r} END AS x FROM {src} s JOIN {before} p USING (t, freq))"
    return f"""(WITH x AS MATERIALIZED {x},
 y AS (SELECT i.t, i.freq, any_value(i.intensity) AS intensity, any_value(i.weight) AS weight,
   sum(CASE WHEN j.freq <= i.freq THEN j.x * pow({a!r}, i.freq - j.freq) ELSE 0 END) + pow({a!r}, i.freq + 1) * {vb!r} AS f,
   sum(CASE WHEN j.freq >= i.freq THEN j.x * pow({a!r}, j.freq - i.freq) ELSE 0 END) + pow({a!r}, {nfreq} - i.freq) * {vb!r} AS g FROM x i JOIN x j USING (t) GROUP BY 1, 2)
 SELECT t, freq, intensity, CASE WHEN f < {b!r} AND g < {b!r} THEN 0e0 ELSE weight END AS weight FROM y)"""


def rounded(src: str) -> str:
    return f"SELECT t, freq, round(intensity, 9) AS intensity, round(weight, 9) AS weight FROM {src}"


def measurements(src: str, nfreq: int, chunk: int) -> str:
    return f"(SELECT t // {chunk} * {chunk} AS pos, CAST({nfreq * chunk} AS BIGINT) AS nsamples, count(*) FILTER (weight > 0) AS unmasked FROM {src} GROUP BY 1)"


def v1(src: str, n: int) -> str:
    return f"(SELECT t // {n} AS v1_idx, freq, CASE WHEN count(*) FILTER (weight <> 0) >= {n / 4} THEN sum(weight * intensity * intensity) / sum(weight) ELSE 0e0 END AS v1 FROM {src} GROUP BY 1, 2)"


def v2(src: str, n: int) -> str:
    return f"(SELECT v1_idx // {n} AS v2_idx, freq, CASE WHEN count(*) FILTER (v1 <> 0) >= {n / 4} THEN median(v1) FILTER (v1 <> 0) ELSE 0e0 END AS variance FROM {src} GROUP BY 1, 2)"


LINE_VARIANCE = f"(SELECT freq, v2_idx, (v2_idx + 0.5e0) * 0.128e0 AS time, CASE WHEN (freq * 5 + v2_idx * 3) % 7 = 0 THEN 0e0 ELSE variance END AS variance FROM {v2(v1(LINES, 32), 4)})"


def interp(x: str, table: str, tx: str, ty: str, on: str) -> str:
    """Linear in tx between a table's neighbours of x, clamped: by correlated subqueries."""
    lo = f"(SELECT max_by(struct_pack(x := k.{tx}, y := k.{ty}), k.{tx}) FROM {table} k WHERE {on} AND k.{tx} <= {x})"
    hi = f"(SELECT min_by(struct_pack(x := k.{tx}, y := k.{ty}), k.{tx}) FROM {table} k WHERE {on} AND k.{tx} >= {x})"
    return f"coalesce({lo}, {hi}) AS lo, coalesce({hi}, {lo}) AS hi"


LINEAR = "lo.y + CASE WHEN hi.x > lo.x THEN ({x} - lo.x) / (hi.x - lo.x) ELSE 0 END * (hi.y - lo.y)"
FILLED = f"""lv AS MATERIALIZED {LINE_VARIANCE}, nz AS MATERIALIZED (SELECT *, CAST(v2_idx AS DOUBLE) AS ix FROM lv WHERE variance <> 0),
 enough AS (SELECT freq, count(*) FILTER (variance <> 0) >= 0.25 * count(*) AS ok FROM lv GROUP BY 1),
 near AS (SELECT lv.*, ok, {interp("lv.v2_idx", "nz", "ix", "variance", "k.freq = lv.freq")} FROM lv JOIN enough USING (freq)),
 filled AS MATERIALIZED (SELECT freq, v2_idx, time, CASE WHEN ok AND lo IS NOT NULL THEN {LINEAR.format(x="v2_idx")} ELSE 0e0 END AS variance FROM near)"""


def zoom(src: str, n: int) -> str:
    one = "SELECT {z} AS zoom, t // {k} * {k} AS t, freq, round(coalesce(sum(weight * intensity) / nullif(sum(weight), 0), 0), 9) AS intensity, round(sum(weight), 9) AS weight FROM {src} GROUP BY t // {k}, freq"
    return " UNION ALL ".join(one.format(z=z, k=1 << z, src=src) for z in range(n))


def colours(src: str, tile: str, niter: int, sigma: float) -> str:
    """src with red and blue."""
    q = f"SELECT *, max(weight) OVER (PARTITION BY {tile}) AS top FROM {stats(src, tile, niter, sigma)}"
    q = f"SELECT *, least(greatest(0.5e0 + 0.16e0 * CASE WHEN rms > 0 THEN (intensity - mean) / rms ELSE 0 END, 1e-4), 0.9999e0) AS c, CASE WHEN top > 0 THEN weight / top ELSE 0 END AS light FROM ({q})"
    return f"(SELECT *, CAST(floor(256 * c * light) AS BIGINT) AS red, CAST(floor(256 * (1 - c) * light) AS BIGINT) AS blue FROM ({q}))"


def delays(nfreq: int = 64, dt: float = 1e-3) -> str:
    """(dm_idx, dm, freq, shift) from the cold-plasma law, at the channels' middles."""
    dms = ", ".join(f"({k}, {d}e0)" for k, d in enumerate(DMS))
    width = 400 / nfreq
    return f"""(SELECT dm_idx, dm, CAST(f AS INTEGER) AS freq, CAST(floor(4.148808e-3 * dm * (pow((800e0 - (f + 0.5e0) * {width}) / 1000, -2) - pow(0.8e0, -2)) / {dt} + 0.5e0) AS BIGINT) AS shift
  FROM (VALUES {dms}) v(dm_idx, dm), range(0, {nfreq}) r(f))"""


TRIALS = f"""(SELECT dm_idx, dm, g.t - shift AS t, sum(weight * intensity) / sqrt(sum(weight * weight)) AS value, sqrt(sum(weight * weight)) AS norm
  FROM {EMB} g JOIN {delays()} d USING (freq) WHERE weight > 0 AND g.t >= shift GROUP BY 1, 2, 3)"""

ACQUIRED = f"(SELECT *, t // 50 AS file, t + t // 50 // 3 * 7 AS moved FROM {EMB})"
SHIFTED = f"(SELECT * REPLACE (intensity + 5.0e0 AS intensity) FROM {EMB})"


def thermal(src: str) -> str:
    rows = f"(SELECT t // 64 AS c, freq, sum(weight * intensity) AS num, sum(weight) AS den FROM {src} GROUP BY 1, 2)"
    good = f"(SELECT *, num / den / sqrt(2 * 1e-3 * 400e6 / 64) AS sd FROM (SELECT *, sum(den) OVER (PARTITION BY c) / 64 AS average FROM {rows}) WHERE den >= 0.001 * average AND num <> 0)"
    return f"(SELECT t, s.freq, intensity, coalesce(weight / sd, 0) AS weight FROM {src} s LEFT JOIN {good} g ON s.t // 64 = g.c AND s.freq = g.freq)"


def mean_mask(src: str, keys: str, size: int, thr: float) -> str:
    return masked(f"(SELECT *, sum(weight) OVER (PARTITION BY {keys}) / {size} AS m FROM {src})", f"m > {thr}")


CLIPPED = clip(EMB, "time", 64, 1.2)
GOOD_CHAIN = masked(EMB, f"NOT {bad_channels(RANGES, 64)}")
LOW = blocks(GOOD_CHAIN, 2, 2)
LOW = std_clip(clip(clip(LOW, "time", 64, 1.5), "freq", 64, 1.5), "time", 64, 1.6)
CHAIN = clip(detrend(detrend(keep_low(GOOD_CHAIN, LOW, 2, 2), "time", 64, 64, 1), "freq", 64, 64, 2), "time", 64, 2.0, 2)
SUB_LOW = std_clip(clip(blocks(EMB, 4, 2), "time", 64, 1.4), "time", 64, 1.5)
STRIPE_FINE = f"(SELECT * FROM {blocks('(SELECT * REPLACE (intensity + 3.0e0 AS intensity) FROM ' + EMB + ')', 1, 4)})"


def e(src: str) -> str:
    return summary(src, 64)


ORACLES: dict[str, str] = {
    "clip_time": e(CLIPPED),
    "clip_time_niter3": e(clip(EMB, "time", 64, 1.2, 3, 1.5)),
    "clip_freq": e(clip(EMB, "freq", 64, 1.3, 2)),
    "clip_none": e(clip(EMB, "none", 64, 1.25, 3)),
    "clip_2d_df2_dt4": e(clip(EMB, "none", 64, 1.3, 2, 0, 2, 4)),
    "clip_time_lines": summary(clip(LINES, "time", 128, 1.5, 2), 128),
    "clip_freq_df4": summary(clip(LINES, "freq", 128, 1.4, 1, 0, 4, 2), 128),
    "stddev_clip_time": e(std_clip(EMB, "time", 64, 1.3)),
    "stddev_clip_freq": e(std_clip(EMB, "freq", 64, 1.3, 2, 2)),
    "sub_pipeline_mask": e(keep_low(EMB, SUB_LOW, 4, 2, 0.5)),
    "poly0_time": e(detrend(EMB, "time", 64, 64, 0)),
    "poly1_freq": e(detrend(EMB, "freq", 64, 64, 1)),
    "poly2_time": e(detrend(EMB, "time", 64, 64, 2)),
    "badchannel_range_join": e(GOOD_CHAIN),
    "spike_mask": e(masked(EMB, "freq % 16 <> 15")),
    "derippler": e(f"(SELECT * REPLACE (intensity / (1 + 0.8e0 * (([{', '.join(map(repr, RIPPLE))}]::DOUBLE[])[freq % 16 + 1] - 1)) AS intensity) FROM {EMB})"),
    "rect_mask": e(masked(EMB, f"NOT ({RECT})")),
    "kurtosis_mask": e(masked(f"(SELECT * FROM {EMB} JOIN (SELECT t // 64 AS c, freq, kurtosis_pop(intensity) FILTER (weight > 0) AS kurt FROM {EMB} GROUP BY 1, 2) k USING (freq) WHERE t // 64 = c)", "CASE WHEN kurt IS NULL OR NOT isfinite(kurt) THEN -4 ELSE kurt END BETWEEN -0.8 AND 0.8")),
    "thermal_weight": e(thermal(SHIFTED)),
    "mean_weight_mask": e(mean_mask(EMB, "t // 64, freq", 64, 1.78)),
    "mean_weight_mask_freq": summary(mean_mask(LINES, "t", 32, 0.7), 128),
    "saver_reverter": e(clip(EMB, "none", 64, 1.6)),
    "weighted_mean_rms": f"SELECT chunk, freq, round(mean, 6) AS mean, round(rms, 6) AS rms, round(total, 4) AS total FROM (SELECT t // 64 AS chunk, freq, any_value(mean) AS mean, any_value(rms) AS rms, sum(w0) AS total FROM {stats(EMB, 't // 64, freq', 3, 1.5)} GROUP BY 1, 2)",
    "weighted_mean_rms_all": f"SELECT round(any_value(mean), 6) AS mean, round(any_value(rms), 6) AS rms, round(sum(w0), 3) AS total FROM {stats(LINES, '1', 2, 2.0)}",
    "wi_downsample_sum": rounded(blocks(EMB, 4, 8)),
    "wi_downsample_mean": rounded(blocks(LINES, 8, 16, "sum(weight) / 128")),
    "weight_upsample": e(keep_low(EMB, blocks(EMB, 2, 2), 2, 2, 6)),
    "upsample_cells": rounded(f"(SELECT b.t + i * 2 AS t, CAST(b.freq * 4 + j AS INTEGER) AS freq, intensity, weight FROM {blocks(EVENTS, 4, 6)} b, range(0, 3) r(i), range(0, 4) s(j))"),
    "expand_axis": f"SELECT t, freq, round(weight / sum(weight) OVER (PARTITION BY t), 6) AS share FROM {EVENTS}",
    "fork_delta_mask": f"SELECT a.freq, count(*) FILTER (a.weight > 0 AND b.weight = 0) AS newly_masked, count(*) FILTER (a.weight = 0) AS masked_before FROM {EMB} a JOIN {CLIPPED} b USING (t, freq) GROUP BY 1",
    "mask_expander": e(expander_sql(EMB, CLIPPED, 0.05, 0.5, 0.3, 64)),
    "mask_counter": f"SELECT pos, 64 AS nf, 64 AS nt, CAST(4096 AS BIGINT) AS nsamples, CAST(sum(n) AS BIGINT) AS unmasked, string_agg(CAST(n AS VARCHAR), ',' ORDER BY freq) AS freqs FROM (SELECT t // 64 * 64 AS pos, freq, count(*) FILTER (weight > 0) AS n FROM {EMB} GROUP BY 1, 2) GROUP BY 1",
    "mask_last_n": f"SELECT * FROM {measurements(LINES, 32, 128)} ORDER BY pos DESC LIMIT 4",
    "mask_stats": f"SELECT CAST(sum(nsamples) AS BIGINT) AS nsamples, CAST(sum(unmasked) AS BIGINT) AS unmasked, round(100e0 * (sum(nsamples) - sum(unmasked)) / sum(nsamples), 6) AS pct_masked FROM (SELECT * FROM {measurements(LINES, 32, 128)} ORDER BY pos DESC LIMIT 6)",
    "variance_v1_blocks": f"SELECT v1_idx, freq, round(v1, 6) AS v1 FROM {v1(EMB, V1)}",
    "variance_v2_median": f"SELECT freq, v2_idx, round((v2_idx + 0.5e0) * {V1 * V2 * 1e-3}, 6) AS time, round(variance, 6) AS variance FROM {v2(v1(EMB, V1), V2)} WHERE (v2_idx + 1) * {V2} <= (SELECT (max(vec_id) // 80 + 1) * 5 FROM embeddings)",
    "variance_interp_asof": f"WITH {FILLED}, asks AS (SELECT t * 1e-3 AS ts, freq FROM {LINES}), q AS (SELECT asks.*, {interp('asks.ts', 'filled', 'time', 'variance', 'k.freq = asks.freq')} FROM asks) SELECT freq, round(ts, 6) AS ts, round({LINEAR.format(x='ts')}, 5) AS v FROM q",
    "variance_compare": f"SELECT a.freq, a.v2_idx, round(greatest(a.variance, 1e-5) / greatest(b.variance, 1e-5), 6) AS ratio FROM {v2(v1(LINES, 32), 2)} a JOIN {v2(v1(LINES, 32), 8)} b ON a.freq = b.freq AND a.v2_idx // 4 = b.v2_idx",
    "mask_filler": f"WITH {FILLED}, asks AS (SELECT DISTINCT t // 128 AS c, freq, (t // 128 + 0.5e0) * 0.128e0 AS ts FROM {LINES}), q AS (SELECT asks.*, {interp('asks.ts', 'filled', 'time', 'variance', 'k.freq = asks.freq')} FROM asks), v AS (SELECT c, freq, {LINEAR.format(x='ts')} AS v FROM q) SELECT g.freq, count(*) AS n, count(*) FILTER (weight > 0.9) AS valid, sum(CASE WHEN v > 0 THEN 2e0 ELSE 0e0 END) AS wsum, round(sum(CASE WHEN weight > 0.9 THEN intensity END), 4) AS kept FROM {LINES} g LEFT JOIN v ON g.t // 128 = v.c AND g.freq = v.freq GROUP BY 1",
    "spectrum_median": f"SELECT t // 32 AS chunk, freq, round(CASE WHEN count(*) FILTER (weight > 0) > 2 THEN median(intensity) FILTER (weight > 0) ELSE 0 END, 6) AS value FROM {blocks(EMB, 1, 4)} GROUP BY 1, 2",
    "stripe_ratio": f"SELECT chunk, block, u, round(CASE WHEN count(*) FILTER (ok) > 4 THEN median(ratio) FILTER (ok) ELSE 0 END, 6) AS value FROM (SELECT f.t // 32 AS chunk, CAST(f.freq // 16 // 2 AS BIGINT) AS block, f.freq % 16 AS u, f.intensity / c.intensity AS ratio, c.intensity > 0 AND f.weight > 0 AS ok FROM {STRIPE_FINE} f JOIN {blocks(STRIPE_FINE, 16, 1)} c ON f.t = c.t AND f.freq // 16 = c.freq) GROUP BY 1, 2, 3",
    "bitmask_pack": f"SELECT t // 8 AS t8, freq, CAST(sum(1 << CAST(t % 8 AS INTEGER)) AS INTEGER) AS bits FROM {EMB} WHERE weight > 0 GROUP BY 1, 2",
    "bitmask_unpack": f"SELECT t, freq FROM {EVENTS} WHERE weight > 0",
    "zoom_levels": zoom(LINES, 4),
    "max_pooling": f"SELECT t // 16 AS t, CAST(freq // 4 AS BIGINT) AS freq, round(max(intensity), 6) AS intensity FROM {EMB} GROUP BY 1, 2",
    "waterfall_colours": f"SELECT tile, count(*) AS n, CAST(sum(red) AS BIGINT) AS red, CAST(sum(blue) AS BIGINT) AS blue FROM {colours('(SELECT *, t // 128 AS tile FROM ' + blocks(EMB, 4, 4) + ')', 'tile', 2, 2.5)} GROUP BY 1",
    "dedisperse_trial_dm": f"SELECT dm_idx, t, round(value, 6) AS value, round(norm, 6) AS norm FROM {TRIALS}",
    "coarse_dm_triggers": f"SELECT CAST(dm_idx // 2 AS BIGINT) AS dm_bin, t // 32 AS t_bin, round(max(value), 6) AS trigger FROM {TRIALS} GROUP BY 1, 2",
    "global_max_trigger": f"SELECT round(value, 6) AS value, dm, t FROM {TRIALS} WHERE dm BETWEEN 5 AND 50 ORDER BY value DESC, dm, t LIMIT 1",
    "gap_fill": f"SELECT r.t AS t, CAST(s.f AS INTEGER) AS freq, round(coalesce(intensity, 0), 6) AS intensity, coalesce(weight, 0) AS weight FROM range(0, 720) r(t) CROSS JOIN range(0, 16) s(f) LEFT JOIN {EVENTS} e ON e.t = r.t AND e.freq = s.f",
    "file_scan": e(f"(SELECT * REPLACE (moved AS t) FROM {ACQUIRED})"),
    "noise_align_discard": e(f"(SELECT * REPLACE (moved - (-20000 % 64 + 64) % 64 AS t) FROM {ACQUIRED} WHERE moved >= (-20000 % 64 + 64) % 64)"),
    "packet_mask": f"SELECT t // 16 * 16 AS t0, CAST(freq // 16 * 16 AS INTEGER) AS f0, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (weight >= 2) AS INTEGER) AS unmasked FROM {EMB} GROUP BY 1, 2",
    "tumbling_chunk_events": f"SELECT t // 24 AS chunk, freq, round(any_value(mean), 6) AS mean, round(any_value(rms), 6) AS rms, sum(weight) AS total FROM {stats(EVENTS, 't // 24, freq', 1, 3)} GROUP BY 1, 2",
    "running_counts": f"SELECT t, freq, sum(weight) OVER (PARTITION BY freq ORDER BY t) AS running FROM {EVENTS}",
    "gaussian_noise": "SELECT CAST(131072 AS BIGINT) AS n, TRUE AS mean_ok, TRUE AS rms_ok",
    "dummy_stream": "SELECT CAST(65536 AS BIGINT) AS n, CAST(1024 AS BIGINT) AS nfreq, CAST(63 AS BIGINT) AS t_max, 65536e0 AS wsum",
    "full_chain": e(CHAIN),
    "full_chain_fused": e(CHAIN),
    "full_chain_packed": e(CHAIN),
    "packed_round_trip": e(CHAIN),
    "array_form": e(CHAIN),
    "file_round_trip": e(EMB),
}
