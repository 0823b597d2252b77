"""Image files of tiles, and their manifest."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colours import png_bytes


def tile_images(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """(zoom, tile, png): each tile's pixels become one image on the executors; a tile has width x height pixels at most."""

    def each(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = np.zeros((height, width, 3), np.uint8)
        rgb[pdf["y"], pdf["x"]] = pdf[["red", "green", "blue"]].to_numpy().clip(0, 255)
        return pd.DataFrame({"zoom": [key[0]], "tile": [key[1]], "png": [png_bytes(rgb)]})

    return tiles.groupBy("zoom", "tile").applyInPandas(each, "zoom int, tile long, png binary")


def write_tiles(images: DataFrame, outdir: str, prefix: str, clobber: bool = True) -> list[dict]:
    """Write images as files one by one, and return the manifest's rows; for the driver's disk."""
    os.makedirs(outdir, exist_ok=True)
    manifest = []
    for r in images.orderBy("zoom", "tile").toLocalIterator():
        name = f"{prefix}_{r.zoom}_{r.tile}.png"
        with open(os.path.join(outdir, name), "wb" if clobber else "xb") as f:
            f.write(r.png)
        manifest.append({"zoom": r.zoom, "tile": r.tile, "filename": name})
    return manifest


def manifest(tiles: DataFrame, prefix: str, width: int) -> DataFrame:
    """(zoom, tile, filename, x0, nx): one row per tile, in order."""
    per = tiles.groupBy("zoom", "tile").agg(F.min("x").alias("x0"), (F.max("x") - F.min("x") + 1).alias("nx"))
    return per.select("zoom", "tile", F.format_string(f"{prefix}_%d_%d.png", "zoom", "tile").alias("filename"), (F.col("x0") + F.col("tile") * width).alias("x0"), "nx")
