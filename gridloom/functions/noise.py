"""Random numbers from hashes of the cell: the same in every run, task retry and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1): the upper 52 bits of a hash, centred."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (h.cast("double") + 0.5) / float(1 << 52)


def gaussian(seed: int, *cols: Column) -> Column:
    """A number of N(0, 1), by the Box-Muller transform of two hashes."""
    return F.sqrt(-2.0 * F.log(uniform(seed, *cols))) * F.cos(2 * math.pi * uniform(seed ^ 0x5BD1E995, *cols))
