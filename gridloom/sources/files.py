"""File scans: acquisition files with gaps, in any channel order, aligned to a noise source.

An acquisition file is Parquet with a row per cell: ``time`` (seconds, start of the
sample), ``freq`` (channel in the file's order), intensity, weight, and constants of the
file: nfreq, freq_lo_MHz, freq_hi_MHz, dt_sample, increasing (channel 0 is the lowest).
Constant columns are dictionary-encoded and cost next to nothing.

The scan makes one aggregation for a row per file; files are ordered and checked on
that table, which gives each its first sample. Missing samples stay missing: weight 0.
"""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..grid import Grid, GridMeta
from ..operators.base import Operator, Source
from .synthetic import NOISE_SOURCE_COUNTS, SECONDS_PER_COUNT

CONSTANTS = ("nfreq", "freq_lo_MHz", "freq_hi_MHz", "dt_sample", "increasing")
MAX_GAP = 10_000.01


def discard_for_alignment(t_lo: float, dt: float, align: int) -> int:
    """Samples to drop at the start, so that the stream begins at a multiple of align of the noise source's period."""
    if not align:
        return 0
    if dt < 1e-4:
        raise ValueError("noise_source_align needs dt_sample of at least 1e-4 s")
    period = NOISE_SOURCE_COUNTS * SECONDS_PER_COUNT / dt
    if abs(period - round(period)) > 1e-4 or round(period) % align:
        raise ValueError(f"noise_source_align={align} does not divide the noise source's period of {period} samples")
    return -round(t_lo / dt) % align


def file_table(cells: DataFrame, exact: bool = False) -> DataFrame:
    """One row per file: first sample ``start``, its time, its number of samples, and what is wrong with it.

    ``problem`` is null or says how the file breaks the order, the spacing or the agreement with the first.
    """
    per = cells.groupBy("file").agg(F.min("time").alias("t_lo"), F.max("time").alias("t_last"), *[F.min(c).alias(c) for c in CONSTANTS], F.max(F.struct(*CONSTANTS)).alias("top"), F.min(F.struct(*CONSTANTS)).alias("low"))
    per = per.withColumns({"nt": F.round((F.col("t_last") - F.col("t_lo")) / F.col("dt_sample")).cast("long") + 1})
    order = Window.partitionBy(F.lit(0)).orderBy("t_lo", "file")  # one row per file
    first = F.first(F.struct(*CONSTANTS)).over(order)
    gap = (F.col("t_lo") - F.lag(F.col("t_lo") + F.col("nt") * F.col("dt_sample")).over(order)) / F.col("dt_sample")
    per = per.withColumns({"one": first, "gap": F.coalesce(gap, F.lit(0.0))})
    near = lambda c: F.abs(F.col(c) - F.col(f"one.{c}")) <= (0.0 if exact else 1e-4) * F.abs(F.col(f"one.{c}"))
    problem = (
        F.when(F.col("low") != F.col("top"), "constants differ within the file")
        .when(F.col("gap") < -0.01, "it begins before the previous file ends")
        .when(F.col("gap") > MAX_GAP, "the gap before it is too long")
        .when(F.abs(F.col("gap") - F.round("gap")) > 0.01, "the gap before it is no whole number of samples")
        .when(F.col("nfreq") != F.col("one.nfreq"), "nfreq differs")
        .when(~(near("freq_lo_MHz") & near("freq_hi_MHz")), "the band differs")
        .when(~near("dt_sample"), "dt_sample differs")
    )
    step = F.col("nt") + F.coalesce(F.lead("gap").over(order), F.lit(0.0)).cast("double")
    start = F.coalesce(F.sum(F.round(step)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).cast("long")
    return per.select("file", "t_lo", "nt", "gap", start.alias("start"), problem.alias("problem"), *CONSTANTS)


def scan(cells: DataFrame, align: int = 0, exact: bool = False) -> Grid:
    """The grid of acquisition cells with a column ``file``."""
    files = file_table(cells, exact)
    # two small rows come to the driver: the first file, and a file with a problem if any
    first = files.orderBy("start", "t_lo").first()
    if first is None:
        raise ValueError("there are no files")
    if bad := files.where("problem IS NOT NULL").orderBy("start").first():
        raise ValueError(f"{bad.file}: {bad.problem}")
    drop = discard_for_alignment(first.t_lo, first.dt_sample, align)
    meta = GridMeta(first.nfreq, 1, first.freq_lo_MHz, first.freq_hi_MHz, first.dt_sample, first.t_lo + drop * first.dt_sample)
    at = files.select("file", F.col("t_lo").alias("__lo"), "start", F.col("increasing").alias("__up"), F.col("dt_sample").alias("__dt"))
    df = cells.select("file", "time", "freq", "intensity", "weight").join(at, "file")
    t = (F.col("start") + F.round((F.col("time") - F.col("__lo")) / F.col("__dt")).cast("long") - drop).alias("t")
    f = F.when(F.col("__up"), meta.nfreq - 1 - F.col("freq")).otherwise(F.col("freq")).cast("int").alias("freq")
    return Grid(df.select(t, f, F.col("intensity").cast("double").alias("intensity"), F.col("weight").cast("double").alias("weight")).where("t >= 0"), meta)


def braces(pattern: str) -> list[str]:
    """The patterns that {a,b} alternatives stand for."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    return [pattern] if not m else [q for x in m[1].split(",") for q in braces(pattern[: m.start()] + x + pattern[m.end() :])]


def matching(pattern: str) -> list[str]:
    """Paths that a pattern matches, in order: by Spark's file systems where a session is active, else by the local one."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return sorted({f for p in braces(pattern) for f in glob.glob(p)})
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    whole = "://" in pattern
    return sorted({f.getPath().toString() if whole else f.getPath().toUri().getPath() for f in found})


def acquisition_files(dirname: str, nfiles: int = 0) -> list[str]:
    """Files named by eight digits, in order; the first nfiles if that is positive."""
    found = [f for f in matching(f"{dirname.rstrip('/')}/*.parquet") if re.fullmatch(r"[0-9]{8}\.parquet", f.rsplit("/", 1)[-1])]
    return found[:nfiles] if nfiles else found


@dataclass
class FileStream(Source):
    """A scan of acquisition files in a list; Spark splits large ones."""

    filename_list: list
    nt_chunk: int = 0
    noise_source_align: int = 0
    class_name = "chime_file_stream"
    exact = False

    def load(self, spark: SparkSession) -> Grid:
        if not self.filename_list:
            raise ValueError("filename_list is empty")
        cells = spark.read.parquet(*self.filename_list).withColumn("file", F.input_file_name())
        return scan(cells, self.noise_source_align, self.exact)

    @classmethod
    def from_filename(cls, filename: str, nt_chunk: int = 0, noise_source_align: int = 0) -> FileStream:
        return cls([filename], nt_chunk, noise_source_align)

    @classmethod
    def from_acqdir(cls, dirname: str, nt_chunk: int = 0, noise_source_align: int = 0, nfiles: int = 0) -> FileStream:
        return cls(acquisition_files(dirname, nfiles), nt_chunk, noise_source_align)

    @classmethod
    def from_glob(cls, pattern: str, nt_chunk: int = 0, noise_source_align: int = 0) -> FileStream:
        return cls(matching(os.path.expanduser(pattern)), nt_chunk, noise_source_align)

    @classmethod
    def from_times(cls, spark: SparkSession, dirname: str, t0: float, t1: float, nt_chunk: int = 0, noise_source_align: int = 0) -> FileStream:
        """The files that overlap [t0, t1]. The range is pushed down to the scan, which skips row groups by their statistics."""
        files = acquisition_files(dirname)
        if not files:
            raise ValueError(f"{dirname} has no acquisition files")
        cells = spark.read.parquet(*files)
        head = cells.select("dt_sample").first()
        dt = head.dt_sample if head else 0.0
        # a sample on either side, so that a file is found whose samples lie around a short range
        spans = cells.where((F.col("time") >= t0 - dt) & (F.col("time") <= t1 + dt)).groupBy(F.input_file_name().alias("file")).agg(F.min("time").alias("a"), F.max("time").alias("b"))
        inside = sorted(r.file for r in spans.where((F.col("b") >= t0) & (F.col("a") <= t1)).select("file").collect())  # one name per file
        return cls(inside, nt_chunk, noise_source_align)


@dataclass
class PacketFileStream(FileStream):
    """Files of assembled packets: later files must agree with the first exactly."""

    class_name = "chime_frb_file_stream"
    exact = True


@dataclass
class FileWriter(Operator):
    """Write the grid as an acquisition file of parts by ranges of time, which ``FileStream`` reads back; the grid passes unchanged.

    clobber replaces what is there; bitshuffle (0 to 3) chooses the codec.
    """

    filename: str
    clobber: bool = False
    bitshuffle: int = 2
    nt_chunk: int = 0
    class_name = "chime_file_writer"

    def _bind(self, meta: GridMeta) -> GridMeta:
        meta.need("freq_lo_MHz", "freq_hi_MHz", "dt_sample")
        if not 0 <= self.bitshuffle <= 3:
            raise ValueError("bitshuffle must be 0 to 3")
        return meta

    def apply(self, grid: Grid) -> Grid:
        parts = acquisition(grid).repartitionByRange("time").sortWithinPartitions("time", "freq")
        parts.write.mode("overwrite" if self.clobber else "errorifexists").option("compression", ("none", "snappy", "zstd", "zstd")[self.bitshuffle]).parquet(self.filename)
        return grid


def acquisition(grid: Grid) -> DataFrame:
    """The grid's cells in the form of acquisition files."""
    m = grid.meta
    time = (F.col("t") * m.dt_sample + (m.t_initial or 0.0)).alias("time")
    constants = [F.lit(m.nfreq).alias("nfreq"), F.lit(m.freq_lo_MHz).alias("freq_lo_MHz"), F.lit(m.freq_hi_MHz).alias("freq_hi_MHz"), F.lit(m.dt_sample * m.nds).alias("dt_sample"), F.lit(False).alias("increasing")]
    return grid.cells.select(time, "freq", "intensity", "weight", *constants)


def search_file_cells(rows: DataFrame, nfreq: int) -> DataFrame:
    """Cells of packed search-mode rows (row BIGINT, nt INT, data BINARY, weights ARRAY<DOUBLE>).

    data holds nt x nfreq bytes, channel fastest; weights has one number per channel of
    the row. Bytes are read by position, in Spark.
    """
    wide = rows.select("row", "nt", "weights", F.hex("data").alias("h"), F.explode(F.expr("sequence(0, nt - 1)")).alias("k"))
    wide = wide.select("row", "nt", "weights", "k", F.expr(f"substr(h, 1 + k * {2 * nfreq}, {2 * nfreq})").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(nfreq - 1))).alias("freq"))
    byte = F.conv(F.expr("substr(h, 1 + 2 * freq, 2)"), 16, 10).cast("double")
    return wide.select((F.col("row") * F.col("nt") + F.col("k")).cast("long").alias("t"), "freq", byte.alias("intensity"), F.element_at("weights", F.col("freq") + 1).cast("double").alias("weight"))
