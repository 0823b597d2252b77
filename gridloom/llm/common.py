"""Helpers that the operators share: shared storage, checkpoints, numbering, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests in local mode) is a local one made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.gettempdir() + f"/gridloom-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/gridloom-" in f}:
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(conf).delete(p, True)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.mapInArrow(each, schema)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """For the jobs that run within: Arrow batches end at so many rows or bytes, unless the session's own limits are lower."""
    names = [f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Records", "Bytes")]
    before = {k: spark.conf.get(k, None) for k in names}
    for k, most in zip(names, (rows, size), strict=True):
        own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(k))
        spark.conf.set(k, str(min(own, most) if own > 0 else most))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def buckets_for(rows: int, per_bucket: int, least: int = 1) -> int:
    """How many hash buckets keep about per_bucket rows each."""
    return max(least, -(-rows // per_bucket))


def number_within(df: DataFrame, group: str, order: list[str], bucket: str, out: str) -> DataFrame:
    """Add ``out``: a gapless number from 0 within ``group``, by bucket and then ``order``.

    ``bucket`` must be fine enough that a (group, bucket) pair fits into a task: only
    such a pair is sorted together; the groups' offsets come from the small table of
    counts per (group, bucket).
    """
    counts = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    at = F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order))
    return df.withColumn("__at", at).join(offsets, [group, bucket]).withColumn(out, F.col("__base") + F.col("__at") - 1).drop("__at", "__base")


def in_order(df: DataFrame, order: list[str | Column], out: str, name: str) -> DataFrame:
    """df written in order, with ``out``: a gapless number from 0.

    Rows are sorted by ranges; only one row per range meets in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number is of the sorted range as it is written: its index in the high bits, the row in the low 33
    ranged = materialize(ranged.withColumn(out, F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright(out, 33))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return ranged.join(base, "__part").withColumn(out, F.col("__base") + F.col(out).bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__base")


def sample_rows(df: DataFrame, n: int, id_col: str, seed: str) -> DataFrame:
    """At most n different rows, the same in every run: those of the lowest seeded hash of id and content.

    Only hashes are sorted; rows that are equal share a hash, and one of them is taken.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col), *[F.col(c) for c in df.columns if c != id_col])
    cut = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(cut)).dropDuplicates()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def map_rows(df: DataFrame, f: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], text_col: str) -> DataFrame:
    """mapInArrow over whole rows: f gets a batch and its texts, and returns a batch of the same columns."""
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b, b.column(at))

    return df.mapInArrow(each, df.schema)
