"""Grids from and to arrays, and the array forms of the operators that tests compare with."""

import math

import numpy as np
import pandas as pd

from gridloom.grid import Grid, GridMeta


def grid_of(spark, i, w, nds=1, **meta):
    """A dense grid of (nfreq, nt) arrays."""
    nfreq, nt = i.shape
    f, t = np.meshgrid(np.arange(nfreq, dtype=np.int32), np.arange(nt, dtype=np.int64) * nds, indexing="ij")
    pdf = pd.DataFrame({"t": t.ravel(), "freq": f.ravel(), "intensity": i.astype(float).ravel(), "weight": w.astype(float).ravel()})
    m = {"freq_lo_MHz": 400.0, "freq_hi_MHz": 800.0, "dt_sample": 1e-3, "t_initial": 0.0} | meta
    return Grid(spark.createDataFrame(pdf, "t long, freq int, intensity double, weight double"), GridMeta(nfreq, nds, **m))


def arrays_of(grid, nt=None, nds=None):
    """(intensity, weight) as (nfreq, nt); missing cells are 0."""
    pdf = grid.cells.select("t", "freq", "intensity", "weight").toPandas()
    nds = nds or grid.meta.nds
    nt = nt or int(pdf["t"].max()) // nds + 1
    i, w = np.zeros((grid.meta.nfreq, nt)), np.zeros((grid.meta.nfreq, nt))
    i[pdf["freq"], pdf["t"] // nds] = pdf["intensity"]
    w[pdf["freq"], pdf["t"] // nds] = pdf["weight"]
    return i, w


def random_grid(rng, nfreq, nt, masked=0.2):
    i = rng.normal(size=(nfreq, nt))
    w = rng.uniform(0.5, 1.0, size=(nfreq, nt)) * (rng.uniform(size=(nfreq, nt)) > masked)
    return i, w


def mean_rms(i, w, niter=1, sigma=3.0):
    """Mean and rms of all elements."""
    w = w.copy()
    mean = rms = 0.0
    for p in range(niter):
        if p:
            w[np.abs(i - mean) >= sigma * rms] = 0
        total = w.sum()
        mean = (w * i).sum() / total if total > 0 else 0.0
        var = (w * (i - mean) ** 2).sum() / total if total > 0 else 0.0
        rms = math.sqrt(var) if total > 0 and var > 1e-10 * mean**2 else 0.0
    return mean, rms


def block_mean(i, w, df, dt):
    """Weighted block means and summed weights."""
    f, t = i.shape
    s = lambda x: x.reshape(f // df, df, t // dt, dt).sum((1, 3))
    sw, swi = s(w), s(w * i)
    return np.where(sw > 0, swi / np.where(sw > 0, sw, 1), 0), sw


def grow(x, df, dt):
    return np.repeat(np.repeat(x, df, 0), dt, 1)


def clip(i, w, axis, chunk, sigma, niter=1, iter_sigma=0, df=1, dt=1):
    """New weights."""
    bi, bw = block_mean(i, w, df, dt)
    keep = np.zeros(bi.shape, dtype=bool)
    per = chunk // dt
    for a in range(0, bi.shape[1], per):
        part = slice(a, a + per)
        if axis == "none":
            cells = [(slice(None), part)]
        elif axis == "time":
            cells = [(slice(k, k + 1), part) for k in range(bi.shape[0])]
        else:
            cells = [(slice(None), slice(k, k + 1)) for k in range(a, min(a + per, bi.shape[1]))]
        for c in cells:
            mean, rms = mean_rms(bi[c], bw[c], niter, iter_sigma or sigma)
            keep[c] = np.abs(bi[c] - mean) < sigma * rms
    return np.where(grow(keep, df, dt), w, 0)


def std_clip(i, w, axis, chunk, sigma, df=1, dt=1):
    bi, bw = block_mean(i, w, df, dt)
    per, out = chunk // dt, w.copy()
    for a in range(0, bi.shape[1], per):
        x, y = bi[:, a : a + per], bw[:, a : a + per]
        if axis == "freq":
            x, y = x.T, y.T
        rms = np.array([mean_rms(p, q)[1] for p, q in zip(x, y, strict=True)])
        sd, sdw = rms**2, (rms > 0) * 1.0
        m, r = mean_rms(sd, sdw)
        bad = (sdw == 0) | (np.abs(sd - m) >= sigma * r)
        if axis == "time":
            out[np.repeat(bad, df), a * dt : (a + per) * dt] = 0
        else:
            out[:, a * dt : (a + per) * dt][:, np.repeat(bad, dt)] = 0
    return out
