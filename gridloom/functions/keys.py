"""Grouping keys: chunks of nt_chunk native samples, and bins of channels and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import GridMeta

AXES = ("freq", "time", "none")


def parse_axis(axis: object) -> str:
    """freq, time or none from any of the accepted spellings: 0, 1, None, AXIS_FREQ, FREQ, ..."""
    if axis is None:
        return "none"
    if axis in (0, 1) and not isinstance(axis, bool):
        return AXES[int(axis)]  # type: ignore[call-overload]
    name = str(axis).lower().removeprefix("axis_")
    if name not in AXES:
        raise ValueError(f"unknown axis {axis!r}")
    return name


def with_key(df: DataFrame, name: str, expr: str) -> DataFrame:
    """df with a key column, which is only made once: equal keys are one attribute, so Spark keeps the partitioning."""
    return df if name in df.columns else df.withColumn(name, F.expr(expr))


def chunk_key(df: DataFrame, nt_chunk: int) -> tuple[DataFrame, str]:
    return with_key(df, f"__c{nt_chunk}", f"t div {nt_chunk}"), f"__c{nt_chunk}"


def freq_key(df: DataFrame, Df: int) -> tuple[DataFrame, str]:  # noqa: N803
    return (df, "freq") if Df == 1 else (with_key(df, f"__f{Df}", f"cast(freq div {Df} as int)"), f"__f{Df}")


def time_key(df: DataFrame, meta: GridMeta, Dt: int) -> tuple[DataFrame, str]:  # noqa: N803
    k = Dt * meta.nds
    return (df, "t") if Dt == 1 else (with_key(df, f"__t{k}", f"t div {k}"), f"__t{k}")


def axis_keys(df: DataFrame, meta: GridMeta, axis: str, nt_chunk: int, Df: int = 1, Dt: int = 1) -> tuple[DataFrame, list[str]]:  # noqa: N803
    """The key of the statistics along an axis: a sample for freq, (chunk, channel) for time, the chunk for none."""
    if axis == "freq":
        df, tb = time_key(df, meta, Dt)
        return df, [tb]
    df, c = chunk_key(df, nt_chunk)
    if axis == "none":
        return df, [c]
    df, fb = freq_key(df, Df)
    return df, [c, fb]


def check_chunk(meta: GridMeta, nt_chunk: int, Dt: int = 1) -> None:  # noqa: N803
    """A chunk holds a whole number of (downsampled) samples."""
    if nt_chunk <= 0 or nt_chunk % (Dt * meta.nds):
        raise ValueError(f"nt_chunk={nt_chunk} must be a positive multiple of Dt*nds={Dt * meta.nds}")
