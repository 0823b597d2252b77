"""Chunk-wise streams: a chunk leaves once the watermark has passed its end.

A chunk's cells are gathered per (chunk, channel) in the state store, by Spark's own
windowed aggregation, so state is bounded by the chunks that are still open. Late cells
beyond the watermark are dropped. Whole chunks then go through any pipeline in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..grid import Grid, GridMeta
from ..operators.base import Operator


def event_time(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """cells with ``ts``, the sample's time as a timestamp."""
    meta.need("dt_sample")
    return cells.withColumn("ts", F.timestamp_micros(F.round((F.col("t") * meta.dt_sample + (meta.t_initial or 0.0)) * 1e6).cast("long")))


def complete_chunks(cells: DataFrame, meta: GridMeta, nt_chunk: int, late_s: float) -> DataFrame:
    """(chunk, freq, samples) in append mode: an array of (t, intensity, weight) per channel of each complete chunk."""
    us = round(nt_chunk * meta.dt_sample * 1e6)
    if abs(us - nt_chunk * meta.dt_sample * 1e6) > 1e-6 * us:
        raise ValueError("a chunk must be a whole number of microseconds")
    start = round((meta.t_initial or 0.0) * 1e6) % us
    timed = event_time(cells, meta).withWatermark("ts", f"{round(late_s * 1e6)} microseconds")
    window = F.window("ts", f"{us} microseconds", startTime=f"{start} microseconds")
    got = timed.groupBy(window.alias("w"), "freq").agg(F.collect_list(F.struct("t", "intensity", "weight")).alias("samples"))
    return got.select(F.expr(f"samples[0].t div {nt_chunk}").alias("chunk"), "freq", "samples")


def to_cells(chunks: DataFrame) -> DataFrame:
    return chunks.select("freq", F.explode("samples").alias("x")).select("x.t", "freq", "x.intensity", "x.weight")


def run_chunks(cells: DataFrame, meta: GridMeta, nt_chunk: int, late_s: float, op: Operator, sink: Callable[[Grid, int], None]) -> DataStreamWriter:
    """A writer that applies op to each batch of complete chunks and hands the grid to sink.

    The chain must not look beyond chunks of nt_chunk. ``sink(grid, batch_id)`` should
    replace what an earlier try of the same batch wrote.
    """
    op.bind(meta)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(op(Grid(to_cells(batch), meta)), batch_id)

    return complete_chunks(cells, meta, nt_chunk, late_s).writeStream.foreachBatch(each)


def running_mask_counts(cells: DataFrame, nt_chunk: int) -> DataFrame:
    """(pos, nsamples, unmasked) per chunk, for update or complete mode."""
    return cells.groupBy(F.expr(f"t div {nt_chunk} * {nt_chunk}").alias("pos")).agg(F.count(F.lit(1)).alias("nsamples"), F.count_if(F.col("weight") > 0).alias("unmasked"))
