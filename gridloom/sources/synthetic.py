"""Synthetic grids: Gaussian noise, a replayed pool, user functions, and a Python data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.noise import gaussian, uniform
from ..grid import SCHEMA, Grid, GridMeta
from ..operators.base import Source
from ..operators.fused import PACKED, Packed, binary

#: Cells that one partition makes.
PARTITION_CELLS = 4_000_000
#: Seconds per raw count of the instrument's sampling clock, and raw counts of its noise source's period. Fixed values.
SECONDS_PER_COUNT = 2.56e-6
NOISE_SOURCE_COUNTS = 1 << 23


def frame(spark: SparkSession, nt: int, nfreq: int) -> DataFrame:
    """(t, freq) of a dense grid: times are ranged over the cluster, channels explode in place; no join, no shuffle."""
    parts = max(1, min(-(-nt * nfreq // PARTITION_CELLS), nt))
    times = spark.range(0, nt, 1, max(parts, min(spark.sparkContext.defaultParallelism, nt) or 1))
    return times.select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(nfreq - 1))).alias("freq"))


@dataclass
class GaussianNoiseStream(Source):
    """Independent normal intensities; weight 1, or uniform. The same seed gives the same cells in any partitioning."""

    nfreq: int
    nt_tot: int
    freq_lo_MHz: float  # noqa: N815
    freq_hi_MHz: float  # noqa: N815
    dt_sample: float
    sample_rms: float = 1.0
    nt_chunk: int = 0
    randomize_weights: bool = False
    seed: int = 0
    class_name = "gaussian_noise_stream"

    def __post_init__(self) -> None:
        if self.nfreq <= 0 or self.nt_tot <= 0 or self.dt_sample <= 0 or self.sample_rms < 0 or not 0 < self.freq_lo_MHz < self.freq_hi_MHz:
            raise ValueError("nfreq, nt_tot and dt_sample must be positive, sample_rms not negative, and the band rising")

    def meta(self) -> GridMeta:
        return GridMeta(self.nfreq, 1, self.freq_lo_MHz, self.freq_hi_MHz, self.dt_sample, 0.0)

    def values(self) -> tuple[Column, Column]:
        at = (F.col("t"), F.col("freq"))
        return gaussian(self.seed, *at) * self.sample_rms, uniform(self.seed + 7, *at) if self.randomize_weights else F.lit(1.0)

    def load(self, spark: SparkSession) -> Grid:
        i, w = self.values()
        return Grid(frame(spark, self.nt_tot, self.nfreq).withColumns({"intensity": i, "weight": w}), self.meta())

    def load_packed(self, spark: SparkSession, nt_chunk: int) -> Packed:
        """Noise in packed chunks, drawn by chunk from (seed, chunk): of the same distribution as the cells of ``load``, but other numbers."""
        n, nt, rms, seed, weights = self.nfreq, self.nt_tot, self.sample_rms, self.seed, self.randomize_weights

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in b.column(0).to_pylist():
                    r = np.random.Generator(np.random.SFC64([seed, c]))
                    inside = np.arange(nt_chunk) < nt - c * nt_chunk
                    i = r.standard_normal((n, nt_chunk), dtype=np.float32) * np.float32(rms)
                    w = r.random((n, nt_chunk), dtype=np.float32) if weights else np.ones((n, nt_chunk), np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c)), pa.array(np.arange(n, dtype=np.int32)), binary(i * inside, "<f4"), binary(w * inside, "<f4")], ["chunk", "freq", "intensity", "weight"])

        chunks = -(-nt // nt_chunk)
        numbers = spark.range(0, chunks, 1, max(1, min(chunks, max(spark.sparkContext.defaultParallelism, chunks * nt_chunk * n // PARTITION_CELLS))))
        return Packed(numbers.mapInArrow(each, PACKED), self.meta(), nt_chunk, nt, together=True)


@dataclass
class DummyNetworkStream(Source):
    """A small pool of random 8-bit samples, repeated: for timing."""

    nt_tot: int
    nupfreq: int = 16
    nt_per_packet: int = 16
    fpga_counts_per_sample: int = 384
    pool_gb: float = 1.0
    class_name = "chime_dummy_network_stream"

    def meta(self) -> GridMeta:
        m = GridMeta(1024 * self.nupfreq, 1, 400.0, 800.0, self.fpga_counts_per_sample * SECONDS_PER_COUNT, 0.0)
        return m.with_attrs(initial_fpga_count=0, frame0_nano=0, fpga_counts_per_sample=self.fpga_counts_per_sample)

    def load(self, spark: SparkSession) -> Grid:
        m = self.meta()
        pool = max(1024, int(self.pool_gb * 1e9 / m.nfreq) // 1024 * 1024)
        byte = F.pmod(F.xxhash64(F.lit(5), F.col("t") % pool, F.col("freq")), F.lit(256)).cast("double")
        return Grid(frame(spark, self.nt_tot, m.nfreq).withColumns({"intensity": byte - 128.0, "weight": F.lit(1.0)}), m)


class PythonStream(Source):
    """A user's source: ``f(chunk) -> (intensity, weight)`` arrays of (nfreq, nt_chunk), or None past the end.

    Chunks are made independently on the executors; nchunks bounds them.
    """

    def __init__(self, meta: GridMeta, nt_chunk: int, nchunks: int, f: Callable[[int], tuple[np.ndarray, np.ndarray] | None]) -> None:
        self._meta, self.nt_chunk, self.nchunks, self.f = meta, nt_chunk, nchunks, f

    def meta(self) -> GridMeta:
        return self._meta

    def load(self, spark: SparkSession) -> Grid:
        f, nt, nfreq = self.f, self.nt_chunk, self._meta.nfreq

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c in b.column(0).to_pylist():
                    got = f(c)
                    if got is not None:
                        yield cells_batch(got[0], got[1], c * nt, nfreq)

        return Grid(spark.range(0, self.nchunks, 1, self.nchunks).mapInArrow(each, SCHEMA), self._meta)


def cells_batch(intensity: np.ndarray, weight: np.ndarray, t0: int, nfreq: int) -> pa.RecordBatch:
    """Cells of arrays (nfreq, nt)."""
    nt = intensity.shape[1]
    t = np.tile(np.arange(t0, t0 + nt, dtype=np.int64), nfreq)
    f = np.repeat(np.arange(nfreq, dtype=np.int32), nt)
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(f), pa.array(intensity.astype(float).ravel()), pa.array(weight.astype(float).ravel())], ["t", "freq", "intensity", "weight"])


class TableStream(Source):
    """Cells from any DataFrame with columns t, freq, intensity, weight."""

    def __init__(self, df: DataFrame, meta: GridMeta) -> None:
        self.df, self._meta = df, meta

    def load(self, spark: SparkSession) -> Grid:
        return Grid(self.df, self._meta)


class NoiseReader(DataSourceReader):
    """Batches of normal cells; a partition per chunk."""

    def __init__(self, options: dict[str, str]) -> None:
        self.nfreq, self.nt = int(options.get("nfreq", "16")), int(options.get("nt", "1024"))
        self.nt_chunk, self.seed = int(options.get("nt_chunk", "1024")), int(options.get("seed", "0"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in range(0, self.nt, self.nt_chunk)]

    def chunk(self, t0: int) -> pa.RecordBatch:
        n = min(self.nt_chunk, self.nt - t0)
        return cells_batch(np.random.default_rng((self.seed, t0)).normal(size=(self.nfreq, n)), np.ones((self.nfreq, n)), t0, self.nfreq)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield self.chunk(partition.value)


class NoiseStreamReader(SimpleDataSourceStreamReader):
    """The same cells as a stream, one chunk per read, up to nt samples."""

    def __init__(self, options: dict[str, str]) -> None:
        self.batch = NoiseReader(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"t": 0}

    def rows(self, a: int, b: int) -> Iterator[tuple]:
        for t in range(a, b, self.batch.nt_chunk):
            yield from zip(*(c.to_pylist() for c in self.batch.chunk(t).columns), strict=True)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["t"] + self.batch.nt_chunk, self.batch.nt)
        return iter(list(self.rows(start["t"], end))), {"t": end}  # a batch is kept and copied

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self.rows(start["t"], end["t"])


class NoiseDataSource(DataSource):
    """``spark.read.format("grid_noise")`` and ``spark.readStream.format("grid_noise")``; options nfreq, nt, nt_chunk, seed."""

    @classmethod
    def name(cls) -> str:
        return "grid_noise"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> NoiseReader:
        return NoiseReader(self.options)

    def simpleStreamReader(self, schema: Any) -> NoiseStreamReader:  # noqa: N802
        return NoiseStreamReader(self.options)
