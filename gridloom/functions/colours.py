"""The colour rule of waterfall tiles, as a projection, and a small PNG writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import window_stats


def colour_tiles(df: DataFrame, tile: list[str], niter: int = 3, sigma: float = 3.0, i: str = "intensity", w: str = "weight") -> DataFrame:
    """df with red, green and blue (0 to 255) of every pixel.

    The colour runs from blue to red with the distance from the tile's clipped mean in
    units of its rms; brightness is the weight relative to the tile's largest.
    """
    out = window_stats(df, tile, niter, sigma, i, w).withColumn("__top", F.max(w).over(Window.partitionBy(*tile)))
    z = F.when(F.col("__rms") > 0, (F.col(i) - F.col("__mean")) / F.col("__rms")).otherwise(0.0)
    out = out.withColumn("__x", F.greatest(F.least(0.5 + 0.16 * z, F.lit(0.9999)), F.lit(1e-4)))
    light = F.when(F.col("__top") > 0, F.col(w) / F.col("__top")).otherwise(0.0)
    return out.withColumns({"red": F.floor(256 * F.col("__x") * light).cast("int"), "green": F.lit(0), "blue": F.floor(256 * (1 - F.col("__x")) * light).cast("int")}).drop("__mean", "__rms", "__top", "__x")


def png_bytes(rgb: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 3) of bytes."""
    h, w, _ = rgb.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")
