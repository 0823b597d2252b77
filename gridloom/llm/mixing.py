"""Operator 10, mixing sources to target weights.

Words are summed per source, targets are shared out by weight under a cap of
``max_epochs`` times the source, and each document comes floor(rate) times plus
once more if its hash, read as a uniform number, is below the fraction. The hash is
of the id; of rows that share an id or have none, it is of id, text and a number
among equal ones, so that each row has a draw of its own.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; a source without words has rate 0; rows that are equal in id, text and source
have different draws, and which of them gets which is not defined; extra columns are neither read nor returned
by ``mix``; an empty table gives an empty result. No document comes more than
``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buckets_for, in_order, materialize, number_within

WEIGHTS = (5, 2, 1)
#: So many rows of a name and two numbers are a few MB.
BROADCAST_ROWS = 20_000
ROWS_PER_BUCKET = 20_000


def size_of(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE + "+"), "")), F.lit(0)).cast("long") * F.when(text.isNull(), 0).otherwise(1)


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """Per source: source_size and target, from a table of (source, size).

    Sources are numbered by ranges of their names, and the level of water (target per
    weight) rises in rounds: sources below it are full, and the others share the rest by
    weight, until no more are full. A round adds up three numbers over one row per source.
    """
    # order by code point: Spark compares strings by their UTF-8 bytes
    per = in_order(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "k", "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    per = materialize(per.select("source", "source_size", w.alias("w"), (max_epochs * F.col("source_size")).cast("long").alias("cap")), "weights")
    words, all_w = (int(x or 0) for x in per.agg(F.sum("source_size"), F.sum("w")).first())
    total, full, level = float(words * share_percent) / 100, -1, 0.0
    caps = used = n = 0
    while n != full:
        if used == all_w:
            return per.select("source", "source_size", F.col("cap").cast("double").alias("target"))
        full, level = n, (total - caps) / (all_w - used)
        caps, used, n = (int(x or 0) for x in per.where(F.lit(level) * F.col("w") > F.col("cap")).agg(F.sum("cap"), F.sum("w"), F.count(F.lit(1))).first())
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) of a hash of the columns, the same in every run and engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def checked(side: DataFrame, most: int | None = None) -> DataFrame:
    """A materialized side of a join: broadcast if it has few rows, else joined by a shuffle, whose hot keys adaptive execution splits."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side.hint("shuffle_hash")


def drawn(sized: DataFrame, ids: DataFrame, seed: str) -> DataFrame:
    """sized (row, id, text, ...) with a column ``draw`` for text; ids is the column id alone.

    Ids that stand in more than one row are found from ids alone. Their rows are written,
    and numbered among equal ones in buckets of bounded size.
    """
    own = uniform(seed, F.col("id"))
    again = materialize(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id")), "again")
    if again.isEmpty():
        return sized.withColumn("draw", own).drop("text")
    side, same = checked(again), F.col("id").eqNullSafe(F.col("__id"))
    once = sized.join(side, same, "left_anti").withColumn("draw", own).drop("text")
    many = sized.join(side, same, "left_semi").withColumn("md", F.md5(F.coalesce(F.col("text"), F.lit("")))).drop("text")
    many = many.withColumn("g", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), "md", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))))
    # written once, so that a row keeps its bucket
    many = materialize(many.withColumn("m", F.xxhash64(F.monotonically_increasing_id())), "repeated")
    buckets = buckets_for(many.count(), ROWS_PER_BUCKET)
    many = number_within(many.withColumn("b", F.pmod("m", F.lit(buckets))), "g", ["m"], "b", "number")
    return once.unionByName(many.withColumn("draw", uniform(seed, F.col("id"), F.col("md"), F.col("number"))).drop("md", "g", "m", "b", "number"))


def rated(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, **how) -> DataFrame:
    """(row, id, source, size, source_size, target, rate, copies): row is the input row as a struct."""
    text = F.col(text_col).cast("string")
    sized = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(text).alias("size"), text.alias("text"))
    rates = checked(materialize(source_rates(sized, **how).withColumnRenamed("source", "__source"), "rates"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = drawn(sized, df.select(F.col(id_col).alias("id")), seed).join(rates, F.col("source").eqNullSafe(F.col("__source"))).withColumn("rate", rate)
    return out.select("row", "id", "source", "size", "source_size", "target", "rate", copies(F.col("rate"), F.col("draw")).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **how) -> DataFrame:
    """Per input row: id, source, size, source_size, target, rate and the number of copies the mix takes."""
    return rated(df, id_col, text_col, source_col, seed, **how).drop("row")


def emit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **how) -> DataFrame:
    """The mix itself: df's rows with all their columns, each as often as the mix takes it."""
    taken = rated(df, id_col, text_col, source_col, seed, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
