"""Array forms of grids: whole chunks as (channel, sample) arrays, for chains that run in one pass."""

from __future__ import annotations

import numpy as np

from .stats import RELATIVE_VARIANCE


def mean_rms(i: np.ndarray, w: np.ndarray, axes: tuple[int, ...], niter: int = 1, sigma: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and rms along axes (kept with size 1), clipped niter - 1 times."""
    mean = rms = np.zeros(1)
    for p in range(niter):
        if p:
            w = np.where(np.abs(i - mean) < sigma * rms, w, 0.0)
        total = w.sum(axes, keepdims=True)
        one = np.where(total > 0, total, 1.0)
        mean = (w * i).sum(axes, keepdims=True) / one
        d = i - mean
        var = (w * d * d).sum(axes, keepdims=True) / one
        rms = np.where((total > 0) & (var > RELATIVE_VARIANCE * mean * mean), np.sqrt(var), 0.0)
    return mean, rms


def block_means(i: np.ndarray, w: np.ndarray, df: int, dt: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and summed weights of df x dt blocks."""
    if df == dt == 1:
        return i, w
    shape = (i.shape[0] // df, df, i.shape[1] // dt, dt)
    total = w.reshape(shape).sum((1, 3))
    return (w * i).reshape(shape).sum((1, 3)) / np.where(total > 0, total, 1.0), total


def spread(x: np.ndarray, df: int, dt: int) -> np.ndarray:
    """Each element repeated over df channels and dt samples."""
    x = np.repeat(x, df, 0) if df > 1 else x
    return np.repeat(x, dt, 1) if dt > 1 else x


def in_chunks(x: np.ndarray, n: int) -> np.ndarray:
    """(channel, chunk, sample)."""
    return x.reshape(x.shape[0], -1, n)


def clip(i: np.ndarray, w: np.ndarray, axis: str, n: int, sigma: float, niter: int, iter_sigma: float, df: int, dt: int) -> np.ndarray:
    """New weights; chunks are of n samples before downsampling."""
    bi, bw = block_means(i, w, df, dt)
    if axis == "freq":
        mean, rms = mean_rms(bi, bw, (0,), niter, iter_sigma)
        keep = np.abs(bi - mean) < sigma * rms
    else:
        ci, cw = in_chunks(bi, n // dt), in_chunks(bw, n // dt)
        mean, rms = mean_rms(ci, cw, (2,) if axis == "time" else (0, 2), niter, iter_sigma)
        keep = (np.abs(ci - mean) < sigma * rms).reshape(bi.shape)
    return np.where(spread(keep, df, dt), w, 0.0)


def std_dev_clip(i: np.ndarray, w: np.ndarray, axis: str, n: int, sigma: float, df: int, dt: int) -> np.ndarray:
    bi, bw = block_means(i, w, df, dt)
    ci, cw = in_chunks(bi, n // dt), in_chunks(bw, n // dt)
    rows, level = (2, 0) if axis == "time" else (0, 2)
    rms = mean_rms(ci, cw, (rows,))[1]
    sd, live = rms * rms, (rms > 0) * 1.0
    mean, spread_ = mean_rms(sd, live, (level,))
    keep = (live > 0) & (np.abs(sd - mean) < sigma * spread_)
    return np.where(spread(np.broadcast_to(keep, ci.shape).reshape(bi.shape), df, dt), w, 0.0)
