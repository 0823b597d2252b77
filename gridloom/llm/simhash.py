"""Operator 4, SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits in 5 segments on a ring. If two fingerprints differ in
at most 4 bits, then from some segment on every chain of l consecutive segments
differs in at most floor(4 * l / 5) bits: 0, 1, 2, 3, 4. The first two of these
budgets are an equi-join (one segment equal, the next equal or one bit away); the
longer chains and the full distance are bit counts on the joined pairs.

A key with more than ``hot`` distinct fingerprints would make pairs with the square
of its size. Fingerprints that meet such a key are split by the next segment of their chain,
with a budget of 2 over the segments after the first: both sides go to their 27 keys
of at most one bit away, and two within that budget share one. Keys that are
still full hold fingerprints that truly crowd together. Those are linked without pairs, and
exactly: two of them are within 4 bits if and only if they share a point within 2
bits of both, and all that share a point are within 4 bits of each other. So each
goes to its 2,081 points, and a point links its fingerprints (2,081 at most) in a star.

Defined cases: null and empty texts, and those of white space, have fingerprint 0,
which links like any other; texts of one to three words hash their whole
sequence; equal fingerprints are one node, however many rows have it; rows with
a null id count, but a component's id is the smallest that is not null; repeated
rows stay; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import fresh, map_arrow, materialize
from .components import connected_components

DISTANCE = 4
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (low bit, bits)
SHINGLE = 4
HOT = 64
START_AT = 40  # a key's bits are below, the number of its first segment above
SALTS = 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned hashes of the text's word shingles in their order, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(line, 42)], dtype="<u8")
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    a, b = starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist()
    return np.array([xxh64_intdigest(line[i:j], 42) for i, j in zip(a, b, strict=True)], dtype="<u8")


def fold(h: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of hashes: the bits that over half of them have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of the text's word shingles."""
    return fold(shingle_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype="<u8").view("<i8")
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), each, "id long, fp long")


def mask(k: int) -> int:
    """Bits of segment k of the ring, as a signed long."""
    low, n = SEGMENTS[k % len(SEGMENTS)]
    return signed(((1 << n) - 1) << low)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_keys(fp: Column, start: int, length: int, flips: bool) -> Column:
    """The bits of ``length`` segments from ``start`` on, below the start's number; with flips also those one bit away behind the first segment."""
    low, n = SEGMENTS[start]
    bits = [SEGMENTS[(start + k) % len(SEGMENTS)][1] for k in range(length)]
    turned = fp if low == 0 else F.shiftrightunsigned(fp, low).bitwiseOR(F.shiftleft(fp, 64 - low))
    key = turned.bitwiseAND(F.lit((1 << sum(bits)) - 1).cast("long")).bitwiseOR(F.lit(start << START_AT).cast("long"))
    return F.array(*[key.bitwiseXOR(F.lit(f).cast("long")) for f in (0, *(1 << k for k in range(n, sum(bits) if flips else n)))])


def starts(keys: Callable[[int], Column]) -> Column:
    return F.flatten(F.array(*map(keys, range(len(SEGMENTS)))))


def start_of(key: str) -> Column:
    return F.shiftright(key, START_AT).cast("int")


def chain_holds(x: Column, y: Column, start: Column) -> Column:
    """Whether every chain from start stays within its budget, and the whole within DISTANCE."""
    m = len(SEGMENTS)
    diff = x.bitwiseXOR(y)
    ok = F.bit_count(diff) <= DISTANCE
    for length in range(1, m):
        masks = [0] * m
        for i in range(m):
            for k in range(length):
                masks[i] |= mask(i + k)
        at = F.element_at(F.array(*[F.lit(v).cast("long") for v in masks]), start + 1)
        ok = ok & (F.bit_count(diff.bitwiseAND(at)) <= DISTANCE * length // m)
    return ok


def points() -> list[int]:
    """Masks of at most DISTANCE / 2 bits."""
    return [signed(sum(1 << b for b in bits)) for r in range(DISTANCE // 2 + 1) for bits in combinations(range(64), r)]


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints that share a key: left is (key, x), right (key, y)."""
    return left.join(right, "key").where("x < y").where(chain_holds(F.col("x"), F.col("y"), start_of("key"))).select(F.col("x").alias("u"), F.col("y").alias("v"))


def full(keyed: DataFrame, hot: int) -> DataFrame:
    return materialize(keyed.groupBy("key").count().where(F.col("count") > hot).select("key"), "hotkeys")


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links within DISTANCE."""
    # a fingerprint becomes dozens of rows: they are dealt out before that
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = nodes.select(F.col("fp").alias("y"), F.explode(starts(lambda i: ring_keys(F.col("fp"), i, 2, False))).alias("key"))
    probe = nodes.select(F.col("fp").alias("x"), F.explode(starts(lambda i: ring_keys(F.col("fp"), i, 2, True))).alias("key"))
    heavy = full(index, hot)
    if heavy.isEmpty():
        return met(probe, index)
    pairs = met(probe, index.join(heavy, "key", "left_anti"))
    crowd = probe.join(heavy, "key", "left_semi").select("x", start_of("key").alias("start")).distinct()
    longer = F.element_at(F.array(*[ring_keys(F.col("x"), i, 3, True) for i in range(len(SEGMENTS))]), F.col("start") + 1)
    keyed = materialize(crowd.select("x", F.explode(longer).alias("key")), "longer")
    heavy = full(keyed, hot)
    cold = keyed.join(heavy, "key", "left_anti")
    pairs = pairs.union(met(cold, cold.withColumnRenamed("x", "y")).distinct())
    if heavy.isEmpty():
        return pairs
    crowd = keyed.join(heavy, "key", "left_semi").select("x").distinct()
    near = F.expr(f"transform(array({','.join(f'{p}L' if p != -(1 << 63) else '-9223372036854775807L - 1L' for p in points())}), p -> x ^ p)")
    stars = crowd.select("x", F.explode(near).alias("p")).groupBy("p").agg(F.collect_list("x").alias("xs"), F.min("x").alias("v")).where(F.size("xs") > 1)
    return pairs.union(stars.select(F.explode("xs").alias("u"), "v").where("u <> v").distinct())


def component_roots(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, root) for the distinct fingerprints of the column fp that have links; root is one fingerprint of the component."""
    nodes = materialize(fps.select("fp").distinct(), "nodes")
    return connected_components(links(nodes, hot)).select(F.col("node").alias("fp"), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(id, fp, component): one row per input row, component the smallest id linked to it over any number of links."""
    docs = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    first = materialize(docs.groupBy("fp").agg(F.min("id").alias("first")), "first")
    roots = materialize(component_roots(docs, hot).join(first, "fp"), "roots")
    # a component may hold most fingerprints: its root's name goes to every salt, and its fingerprints to one each
    salted = roots.select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    least = roots.groupBy("root").agg(F.min("first").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = salted.join(least, ["root", "salt"]).select("fp", "component")
    named = materialize(first.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component")), "named")
    return docs.join(named, "fp").select("id", "fp", "component")


def keep_first(rows: DataFrame, short: DataFrame, roots: DataFrame, row: str) -> DataFrame:
    """rows whose number, in the column row, is that of the smallest id of a component; short is (id, fp, row), roots (fp, root) of the nodes that have links."""
    first = short.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    stay = first.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    # rows are dealt out by number at every size: what stays grows with the rows, and is never sent to all tasks
    return rows.join(materialize(stay, "stay").hint("shuffle_hash"), row, "left_semi")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """df's rows with all their columns, one row of each component: that of the smallest id (null last), or any of them."""
    row, fp = fresh(df, "row"), fresh(df, "fp")
    wide = T.StructType([*df.schema.fields, T.StructField(fp, T.LongType())])
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(at).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, fp])

    # written once, so that a row keeps its number
    rows = materialize(df.mapInArrow(each, wide).withColumn(row, F.monotonically_increasing_id()), "numbered")
    short = rows.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    roots = materialize(component_roots(short, hot), "roots")
    return keep_first(rows, short, roots, row).select(df.columns)
