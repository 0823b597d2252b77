"""Detrenders: polynomial, spline, and bidirectional RC filter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import axis_keys, check_chunk, parse_axis
from ..grid import Grid, GridMeta
from .base import Operator

#: Up to this degree the normal equations are solved in Spark expressions.
NATIVE_DEGREE = 4
#: Samples (or channels) per Python group, so that a group is neither tiny nor unbounded.
BLOCK = 64


def legendre(x: Column, degree: int) -> list[Column]:
    """P_0 to P_degree by the three-term recurrence."""
    p = [F.lit(1.0), x]
    for n in range(1, degree):
        p.append(((2 * n + 1) * x * p[n] - n * p[n - 1]) / float(n + 1))
    return p[: degree + 1]


def solve_expressions(df: DataFrame, n: int, epsilon: float) -> DataFrame:
    """df with __good and coefficients __k0..: the Cholesky solution of __m{a}_{b} k = __v{a}.

    A system is good if every pivot exceeds epsilon times its diagonal entry.
    """
    good = F.lit(True)
    for a in range(n):
        for b in range(a + 1):
            s = F.col(f"__m{b}_{a}")
            for k in range(b):
                s = s - F.col(f"__l{a}_{k}") * F.col(f"__l{b}_{k}")
            if a == b:
                df = df.withColumn("__p", s)
                good = F.col("__good") & (F.col("__p") > epsilon * F.col(f"__m{a}_{a}")) if a else F.col("__p") > 0
                df = df.withColumn("__good", good).withColumn(f"__l{a}_{a}", F.sqrt(F.when(F.col("__good"), F.col("__p")).otherwise(1.0)))
            else:
                df = df.withColumn(f"__l{a}_{b}", s / F.col(f"__l{b}_{b}"))
    for a in range(n):
        s = F.col(f"__v{a}")
        for k in range(a):
            s = s - F.col(f"__l{a}_{k}") * F.col(f"__y{k}")
        df = df.withColumn(f"__y{a}", s / F.col(f"__l{a}_{a}"))
    for a in reversed(range(n)):
        s = F.col(f"__y{a}")
        for k in range(a + 1, n):
            s = s - F.col(f"__l{k}_{a}") * F.col(f"__k{k}")
        df = df.withColumn(f"__k{a}", s / F.col(f"__l{a}_{a}"))
    return df


def solve_arrays(i: np.ndarray, w: np.ndarray, basis: np.ndarray, epsilon: float, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and whether each row is well conditioned; rows of i and w are independent fits over x."""
    n = len(basis)
    # products of basis functions first: two matrix products over all rows
    m = (w @ (basis[:, None] * basis[None]).reshape(n * n, -1).T).reshape(-1, n, n)
    v = (w * i) @ basis.T
    m[:, range(n), range(n)] += ridge * m[:, range(n), range(n)].mean(1, keepdims=True)
    low = np.zeros_like(m)
    good = np.ones(len(w), dtype=bool)
    for a in range(n):
        pivot = m[:, a, a] - (low[:, a, :a] ** 2).sum(1)
        good &= pivot > (epsilon * m[:, a, a] if a or ridge else 0)
        low[:, a, a] = np.sqrt(np.where(good, pivot, 1))
        for b in range(a + 1, n):
            low[:, b, a] = (m[:, b, a] - (low[:, b, :a] * low[:, a, :a]).sum(1)) / low[:, a, a]
    low[~good] = np.eye(n)
    k = np.linalg.solve(np.swapaxes(low, 1, 2), np.linalg.solve(low, v[..., None]))[..., 0]
    return np.where(good[:, None], i - k @ basis, i), good


@dataclass
class PolynomialDetrender(Operator):
    """Subtract a weighted least-squares polynomial along time (per channel and chunk) or frequency (per sample).

    Positions count, not ranks: the abscissa runs from -1 to 1 over the full chunk or
    band. A row whose system is ill-conditioned against epsilon is masked. Masked cells
    of a good row get the polynomial subtracted too.
    """

    nt_chunk: int
    axis: object
    polydeg: int
    epsilon: float = 1e-2
    class_name = "polynomial_detrender"
    in_sub_pipeline = True

    def __post_init__(self) -> None:
        self.axis = parse_axis(self.axis)
        if self.axis == "none":
            raise ValueError("axis must be freq or time")
        if self.polydeg < 0 or self.epsilon <= 0:
            raise ValueError("polydeg must be at least 0 and epsilon positive")

    def _bind(self, meta: GridMeta) -> GridMeta:
        if self.axis == "time" or self.nt_chunk:
            check_chunk(meta, self.nt_chunk)
        return meta

    def kernel(self, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
        size = meta.nfreq if self.axis == "freq" else self.nt_chunk // meta.nds
        basis = np.polynomial.legendre.legvander(np.linspace(-1, 1, size) if size > 1 else np.array([-1.0]), self.polydeg).T
        rows = (lambda x: x.T) if self.axis == "freq" else (lambda x: x.reshape(-1, size))
        new, good = solve_arrays(rows(i), rows(w), basis, self.epsilon)
        weight = np.where(good[:, None], rows(w), 0.0)
        return (new.T, weight.T) if self.axis == "freq" else (new.reshape(i.shape), weight.reshape(i.shape))

    def apply(self, grid: Grid) -> Grid:
        m = grid.meta
        df, keys = axis_keys(grid.df, m, self.axis, self.nt_chunk)
        size = m.nfreq if self.axis == "freq" else self.nt_chunk // m.nds
        at = F.col("freq") if self.axis == "freq" else F.expr(f"(t % {self.nt_chunk}) div {m.nds}")
        df = df.withColumn("__x", at * (2.0 / (size - 1)) - 1.0 if size > 1 else F.lit(-1.0))
        if self.polydeg > NATIVE_DEGREE:
            return grid.with_df(self.fit_in_python(df, keys, size))
        n = self.polydeg + 1
        df = df.withColumns({f"__b{k}": p for k, p in enumerate(legendre(F.col("__x"), self.polydeg))})
        over = Window.partitionBy(*keys)
        sums = {f"__m{a}_{b}": F.sum(F.col("weight") * F.col(f"__b{a}") * F.col(f"__b{b}")).over(over) for a in range(n) for b in range(a, n)}
        sums |= {f"__v{a}": F.sum(F.col("weight") * F.col("intensity") * F.col(f"__b{a}")).over(over) for a in range(n)}
        df = solve_expressions(df.withColumns(sums), n, self.epsilon)
        fit = sum((F.col(f"__k{a}") * F.col(f"__b{a}") for a in range(1, n)), F.col("__k0"))
        df = df.withColumns({"intensity": F.when(F.col("__good"), F.col("intensity") - fit).otherwise(F.col("intensity")), "weight": F.when(F.col("__good"), F.col("weight")).otherwise(0.0)})
        return grid.with_df(df.drop(*[c for c in df.columns if c.startswith("__") and c not in keys and not c.startswith(("__c", "__t", "__f"))]))

    def fit_in_python(self, df: DataFrame, keys: list[str], size: int) -> DataFrame:
        """Any degree: rows of a block of channels (or samples) are fitted together over Arrow."""
        basis = np.polynomial.legendre.legvander(np.linspace(-1, 1, size) if size > 1 else np.array([-1.0]), self.polydeg).T
        epsilon, row = self.epsilon, keys[-1]
        at = F.col("freq") if self.axis == "freq" else F.round((F.col("__x") + 1) * ((size - 1) / 2)).cast("int")
        df = df.drop(*[c for c in df.columns if c.startswith("__") and c not in (*keys, "__x")]).withColumns({"__at": at.cast("int"), "__blk": F.expr(f"`{row}` div {BLOCK}")}).drop("__x")
        out = df.drop("__at", "__blk")

        def each(t: pa.Table) -> pa.Table:
            rows, r = np.unique(t[row].to_numpy(), return_inverse=True)
            x = t["__at"].to_numpy()
            i, w = np.zeros((len(rows), size)), np.zeros((len(rows), size))
            i[r, x], w[r, x] = t["intensity"].to_numpy(), t["weight"].to_numpy()
            new, good = solve_arrays(i, w, basis, epsilon)
            t = t.set_column(t.schema.get_field_index("intensity"), "intensity", pa.array(new[r, x]))
            t = t.set_column(t.schema.get_field_index("weight"), "weight", pa.array(np.where(good[r], w[r, x], 0.0)))
            return t.drop_columns(["__at", "__blk"])

        return df.groupBy(*keys[:-1], "__blk").applyInArrow(each, out.schema)


def hermite_basis(x: np.ndarray, nbins: int) -> np.ndarray:
    """Piecewise cubic Hermite basis over [0, 1]: a value and a slope per knot, nbins + 1 knots."""
    u = x * nbins
    k = np.minimum(u.astype(int), nbins - 1)
    s = u - k
    out = np.zeros((2 * (nbins + 1), len(x)))
    at = np.arange(len(x))
    out[2 * k, at] = (1 + 2 * s) * (1 - s) ** 2
    out[2 * k + 1, at] = s * (1 - s) ** 2
    out[2 * k + 2, at] = s * s * (3 - 2 * s)
    out[2 * k + 3, at] = s * s * (s - 1)
    return out


@dataclass
class SplineDetrender(Operator):
    """Subtract a weighted least-squares cubic spline along frequency, per sample.

    nbins equal bins of Hermite cubics, with a ridge of epsilon times the mean diagonal.
    A sample without weight is masked. The samples of a block are fitted together.
    """

    nt_chunk: int
    axis: object
    nbins: int
    epsilon: float = 3e-4
    class_name = "spline_detrender"
    in_sub_pipeline = True

    def __post_init__(self) -> None:
        self.axis = parse_axis(self.axis)
        if self.axis != "freq":
            raise ValueError("axis must be freq")
        if self.nbins < 1 or self.epsilon <= 0:
            raise ValueError("nbins must be at least 1 and epsilon positive")

    def kernel(self, i: np.ndarray, w: np.ndarray, meta: GridMeta, t0: int) -> tuple[np.ndarray, np.ndarray]:
        new, live = self.fit(i.T, w.T)
        return new.T, np.where(live, w, 0.0)

    def fit(self, i: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of rows of samples, and which rows have a fit."""
        basis = hermite_basis((np.arange(i.shape[1]) + 0.5) / i.shape[1], self.nbins)
        live, new = w.sum(1) > 0, i.copy()
        if live.any():
            new[live], good = solve_arrays(i[live], w[live], basis, 1e-12, ridge=self.epsilon)
            live[np.flatnonzero(live)[~good]] = False
        return new, live

    def apply(self, grid: Grid) -> Grid:
        n, nds = grid.meta.nfreq, grid.meta.nds
        fit, cells = self.fit, grid.cells

        def each(t: pa.Table) -> pa.Table:
            times, r = np.unique(t["t"].to_numpy(), return_inverse=True)
            f = t["freq"].to_numpy()
            i, w = np.zeros((len(times), n)), np.zeros((len(times), n))
            i[r, f], w[r, f] = t["intensity"].to_numpy(), t["weight"].to_numpy()
            new, live = fit(i, w)
            t = t.set_column(t.schema.get_field_index("intensity"), "intensity", pa.array(new[r, f]))
            t = t.set_column(t.schema.get_field_index("weight"), "weight", pa.array(np.where(live[r], w[r, f], 0.0)))
            return t.drop_columns(["__blk"])

        return grid.with_df(cells.withColumn("__blk", F.expr(f"t div {BLOCK * nds}")).groupBy("__blk").applyInArrow(each, cells.schema))


def rc_forward(i: np.ndarray, on: np.ndarray, a: float, fw: np.ndarray, dfw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low-pass and its smoothed step, per row and sample, from the states before."""
    f, d = np.empty_like(i), np.empty_like(i)
    for k in range(i.shape[1]):
        new = np.where(on[:, k], fw * a + i[:, k] * (1 - a), fw)
        dfw = np.where(on[:, k], dfw * a + (new - fw) * (1 - a), dfw)
        fw = new
        f[:, k], d[:, k] = fw, dfw
    return f, d


def rc_chunk(i: np.ndarray, on: np.ndarray, a: float, fw: np.ndarray, dfw: np.ndarray) -> np.ndarray:
    """Residuals of a chunk: the steadier of the forward and the backward filter is subtracted."""
    f, d = rc_forward(i, on, a, fw, dfw)
    # the backward filter starts at the forward one's end, with step 0
    b, e = rc_forward(i[:, -2::-1], on[:, -2::-1], a, f[:, -1], np.zeros(len(i)))
    b = np.concatenate([b[:, ::-1], f[:, -1:]], axis=1)
    e = np.concatenate([e[:, ::-1], np.zeros((len(i), 1))], axis=1)
    return i - np.where(np.abs(d) < np.abs(e), f, b)


@dataclass
class RCDetrender(Operator):
    """Subtract a one-pole low-pass run forwards or backwards in time, whichever is steadier.

    The forward filter runs on from chunk to chunk. It is linear, so each chunk's effect
    on the state is three numbers per channel; those are chained per channel first
    (one small row per chunk), and then all chunks are filtered independently.
    """

    nt_chunk: int = 1024
    a: float = 0.99
    class_name = "rc_detrender"

    def _bind(self, meta: GridMeta) -> GridMeta:
        check_chunk(meta, self.nt_chunk)
        if not 0 < self.a < 1:
            raise ValueError("a must be between 0 and 1")
        return meta

    def apply(self, grid: Grid) -> Grid:
        a, nt, cells = self.a, self.nt_chunk, grid.cells
        df = cells.withColumns({"__c": F.expr(f"t div {nt}"), "__blk": F.expr(f"freq div {BLOCK}"), "__at": F.expr(f"cast(t % {nt} as int)")})

        def block(t: pa.Table) -> tuple:
            chans, r = np.unique(t["freq"].to_numpy(), return_inverse=True)
            x = t["__at"].to_numpy()
            i, w = np.zeros((len(chans), nt)), np.zeros((len(chans), nt))
            i[r, x], w[r, x] = t["intensity"].to_numpy(), t["weight"].to_numpy()
            return chans, r, x, i, w != 0

        def effect(t: pa.Table) -> pa.Table:
            chans, _, _, i, on = block(t)
            zero = np.zeros(len(chans))
            f, d = rc_forward(i, on, a, zero, zero)
            return pa.table({"c": pa.array(np.full(len(chans), t["__c"][0].as_py())), "freq": pa.array(chans, pa.int32()), "n": pa.array(on.sum(1)), "f": pa.array(f[:, -1]), "d": pa.array(d[:, -1])})

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("c", kind="stable")
            fw = dfw = 0.0
            out = []
            for c, n, f, d in pdf[["c", "n", "f", "d"]].itertuples(index=False, name=None):
                out.append((c, fw, dfw))
                # the step's reply to the old state: a constant input of the state's decay
                dfw = a**n * dfw - (1 - a) ** 2 * n * (a ** (n - 1) if n else 0.0) * fw + d
                fw = a**n * fw + f
            res = pd.DataFrame(out, columns=["c", "fw", "dfw"])
            res["freq"] = pdf["freq"].to_numpy()
            return res[["c", "freq", "fw", "dfw"]]

        states = df.groupBy("__c", "__blk").applyInArrow(effect, "c long, freq int, n long, f double, d double").groupBy("freq").applyInPandas(chain, "c long, freq int, fw double, dfw double")

        def final(t: pa.Table, s: pa.Table) -> pa.Table:
            if not t.num_rows:
                return t.drop_columns(["__c", "__blk", "__at"])
            chans, r, x, i, on = block(t)
            at = np.searchsorted(chans, s["freq"].to_numpy())
            fw, dfw = np.zeros(len(chans)), np.zeros(len(chans))
            fw[at], dfw[at] = s["fw"].to_numpy(), s["dfw"].to_numpy()
            new = rc_chunk(i, on, a, fw, dfw)
            t = t.set_column(t.schema.get_field_index("intensity"), "intensity", pa.array(new[r, x]))
            return t.drop_columns(["__c", "__blk", "__at"])

        left = df.groupBy("__c", "__blk")
        right = states.withColumns({"__c": F.col("c"), "__blk": F.expr(f"freq div {BLOCK}")}).groupBy("__c", "__blk")
        return grid.with_df(left.cogroup(right).applyInArrow(final, cells.schema), branches=grid.branches + 1)
