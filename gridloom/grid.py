"""The data model: a grid is a table of cells and what is known of its axes.

Cells are rows ``(t BIGINT, freq INT, intensity DOUBLE, weight DOUBLE)`` plus any saved
buffers. ``t`` counts native samples; a grid that was downsampled by ``nds`` keeps the
first native sample of each bin. Channel 0 is the highest frequency. A cell that is
missing is one of weight 0. Columns that begin with ``__`` are keys that operators
leave to the next operator, so that Spark sees that the data is partitioned already.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("t", "freq", "intensity", "weight")
SCHEMA = "t BIGINT, freq INT, intensity DOUBLE, weight DOUBLE"


@dataclass(frozen=True)
class GridMeta:
    """What the bind step knows: axis sizes, band, sampling, and free attributes."""

    nfreq: int
    nds: int = 1
    freq_lo_MHz: float | None = None  # noqa: N815  the attribute's public name
    freq_hi_MHz: float | None = None  # noqa: N815
    dt_sample: float | None = None
    t_initial: float | None = None
    attrs: Mapping[str, Any] = field(default_factory=lambda: MappingProxyType({}))

    def __post_init__(self) -> None:
        if self.nfreq <= 0 or self.nds <= 0:
            raise ValueError("nfreq and nds must be positive")

    def need(self, *names: str) -> None:
        """Raise if an attribute that an operator relies on is not known."""
        for n in names:
            if getattr(self, n) is None:
                raise ValueError(f"the stream does not define {n}")

    def with_attrs(self, **more: Any) -> GridMeta:
        return replace(self, attrs=MappingProxyType({**self.attrs, **more}))


@dataclass(frozen=True)
class Grid:
    """Cells, their meta data, and the tables that analyzers have put out so far, by name."""

    df: DataFrame
    meta: GridMeta
    outputs: Mapping[str, DataFrame] = field(default_factory=lambda: MappingProxyType({}))
    #: How often plans have branched from the cells since they were last written.
    branches: int = 0

    def with_df(self, df: DataFrame, **changes: Any) -> Grid:
        return replace(self, df=df, **changes)

    def with_output(self, name: str, df: DataFrame) -> Grid:
        k, n = name, 1
        while k in self.outputs:
            n += 1
            k = f"{name}_{n}"
        return replace(self, outputs=MappingProxyType({**self.outputs, k: df}))

    @property
    def cells(self) -> DataFrame:
        """The cells without operators' keys."""
        return self.df.drop(*[c for c in self.df.columns if c.startswith("__")])


def densify(grid: Grid, t_from: int, t_to: int) -> Grid:
    """Every cell of [t_from, t_to): missing ones come with intensity 0 and weight 0.

    The frame is times by channels, made by exploding each time; one equi-join fills it.
    """
    spark, m = grid.df.sparkSession, grid.meta
    frame = spark.range(t_from, t_to, m.nds).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(m.nfreq - 1))).alias("freq"))
    rest = [c for c in grid.cells.columns if c not in ("t", "freq")]
    filled = frame.join(grid.cells, ["t", "freq"], "left")
    zero = {f.name: (F.lit(False) if f.dataType.typeName() == "boolean" else F.lit(0).cast(f.dataType)) for f in grid.cells.schema if f.name in rest and f.dataType.typeName() in ("double", "float", "integer", "long", "boolean")}
    return grid.with_df(filled.select("t", "freq", *[F.coalesce(c, zero[c]).alias(c) if c in zero else F.col(c) for c in rest]))
