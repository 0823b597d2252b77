"""Grids of the relational tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, GridMeta

EMB_CHUNK, EVENT_CHUNK, LINE_CHUNK = 64, 24, 128


def meta(nfreq: int) -> GridMeta:
    return GridMeta(nfreq, 1, 400.0, 800.0, 1e-3, 0.0)


def emb_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Dense: a sample per vector, a channel per component; some cells have weight 0."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    off = (F.col("vec_id") * 7 + F.col("p") * 13) % 11 == 0
    w = F.when(off, 0.0).otherwise(1 + (F.col("vec_id") + F.col("p")) % 3).cast("double")
    return Grid(e.select(F.col("vec_id").alias("t"), F.col("p").alias("freq"), F.col("e").cast("double").alias("intensity"), w.alias("weight")), meta(64))


def event_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Sparse: hours by users modulo 16, mean value weighted by count."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value")
    hour = F.expr("cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 3600 as bigint)")
    g = e.groupBy(hour.alias("t"), (F.col("user_id") % 16).cast("int").alias("freq")).agg(F.avg("value").alias("intensity"), F.count(F.lit(1)).cast("double").alias("weight"))
    return Grid(g.select("t", "freq", "intensity", "weight"), meta(16))


def lineitem_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Large and sparse: days by suppliers modulo 32, with fractional weights."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_quantity", "l_discount")
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    left = 1 - F.col("l_discount")
    g = x.groupBy(day.alias("t"), (F.col("l_suppkey") % 32).cast("int").alias("freq")).agg((F.sum(F.col("l_quantity") * left) / F.sum(left)).alias("intensity"), F.sum(left).alias("weight"))
    return Grid(g.select("t", "freq", "intensity", "weight"), meta(32))


def summary(df: DataFrame, chunk: int) -> DataFrame:
    """(freq, chunk, n, unmasked, wsum, wisum): what is left of each channel in each chunk."""
    wi = F.when(F.col("weight") > 0, F.col("weight") * F.col("intensity")).otherwise(0.0)
    return df.groupBy("freq", F.expr(f"t div {chunk}").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("weight") > 0).alias("unmasked"), F.round(F.sum("weight"), 4).alias("wsum"), F.round(F.sum(wi), 4).alias("wisum")
    )
