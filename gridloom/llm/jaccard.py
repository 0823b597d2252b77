"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles, for the pipeline.

Two texts are linked if their sets of five-word shingles have similarity 0.8 or more
(4 / 5, compared in integers). Candidates come from the SimHash operator first: texts whose
fingerprints, of the same shingles, its pigeonring search finds within 4 bits. Each is
checked on the whole sets, and what is linked makes groups.

Most pairs of similarity 0.8 differ in more bits, and no distance is sure to hold them all.
So the rest is found exactly, between sets of different groups: with the shingles of every
text in one common order, two sets of that similarity share one of their first
n - ceil(4n / 5) + 1, so an equi-join on those finds all candidates, and each is checked likewise.

The order puts shingles that are frequent in a sample last. It decides how many
candidates there are, not which links are found.

A shingle that heads more than ``hot`` sets would make pairs with the square of their
number. There, all are first checked against a few in the middle of the crowd; pairs are then made only
of sets that are not in one component yet, and that share heads enough.

Defined cases: words are those of the SimHash operator; null and empty texts, and those
of white space, are one set; texts of one to five words are one shingle, their whole
sequence; equal sets are one node. Sets are of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import bounded_batches, forget, fresh, materialize
from .components import connected_components
from .simhash import fold, keep_first, shingle_hashes, signed
from .simhash import links as fingerprint_links

SHINGLE = 5
HOT = 64
STARS = 4
SAMPLE_DOCS = 25_000
FREQUENT = 1 << 19
SLOTS = 1 << 22
PIECE = 500  # rows whose sets are in memory together, and that go to Python together
PIECE_BYTES = 8 << 20  # of those rows, but for one longer row


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Different hashes, signed and ascending."""
    return np.unique(hashes.view("<i8"))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's distinct word shingles, ascending."""
    return distinct(shingle_hashes(text, shingle))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, PIECE):
            yield b.slice(k, PIECE)


def digest(hashes: np.ndarray) -> int:
    """The name of a set, as a signed long; 0 for the empty one."""
    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), 42)).astype(np.int64)) if len(hashes) else 0


def heads(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the common order: those that similar sets must share one of."""
    n = len(hashes)
    if not n:
        return hashes
    rank = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))][: n - (4 * n + 4) // 5 + 1]


def frequent_shingles(df: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of shingles that stand in more than one text of a sample."""
    rows = max(1, df.count())
    texts = df.where(F.pmod(F.xxhash64(F.lit("shingles"), F.col(id_col)), F.lit(1 << 20)) < (1 << 20) * SAMPLE_DOCS / rows).select(F.col(text_col).cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, shingle) for t in b.column(0).to_pylist()]), pa.int64())], ["h"])

    with bounded_batches(df.sparkSession, PIECE, PIECE_BYTES):
        got = texts.mapInArrow(each, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, n = got["h"].to_numpy(), got["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def may_be_similar(a: str, b: str) -> Column:
    """Whether sets of n shingles that share the one at pos can reach the similarity.

    Two sets share no more than their common heads and what stands behind the heads of the
    one whose heads end first in the order; and no more common heads than either has heads
    that stand in other sets' heads (met).
    """
    n, m, p, q, c, d = (F.col(f"{t}.{x}") for x in ("n", "pos", "met") for t in (a, b))
    most = F.least(p, q) + 1 + F.least(n - 1 - p, m - 1 - q)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * most >= 4 * (n + m)) & (9 * (F.least(c, d) + behind(n, m)) >= 4 * (n + m))


def behind(n: Column, m: Column) -> Column:
    """How many shingles stand behind the heads of the larger set."""
    return F.floor((4 * F.greatest(n, m) + 4) / 5) - 1


def fingerprint_pairs(nodes: DataFrame, hot: int) -> DataFrame:
    """Distinct pairs (u, v) of sets whose fingerprints are equal or linked by the SimHash operator, if their sizes allow the similarity. nodes is (node, n, fp).

    One set stands for all of its fingerprint, and is paired with each of them.
    """
    first = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")).select("fp", "first.*"), "prints")
    same = nodes.alias("a").join(first.alias("b"), "fp").where("a.node <> b.node")
    near = fingerprint_links(first, hot).join(first.withColumnsRenamed({"fp": "u"}).alias("a"), "u").join(first.withColumnsRenamed({"fp": "v"}).alias("b"), "v")
    ends = (F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))
    sizes = 5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")
    return same.where(sizes).select(*ends).union(near.where(sizes).select(*ends)).distinct()


def meetings(left: DataFrame, right: DataFrame, how: Column, elsewhere: str) -> DataFrame:
    """A row per key at which two sets u > v of different roots meet. left and right are (key, node, n, pos, met, root, ...); elsewhere: the column of how many heads of a set meet others at keys not looked at."""
    both = left.alias("a").join(right.alias("b"), (F.col("a.key") == F.col("b.key")) & how & (F.col("a.root") != F.col("b.root")) & may_be_similar("a", "b"))
    n, m = F.col("a.n"), F.col("b.n")
    return both.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"), (n + m).alias("both"), (F.least(F.col(f"a.{elsewhere}"), F.col(f"b.{elsewhere}")) + behind(n, m)).alias("more"))


def pairs_of(meetings: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of meetings that can reach the similarity with as many common heads as they have."""
    pairs = meetings.groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"), F.max("both").alias("both"), F.max("more").alias("more"))
    return pairs.where(9 * (F.col("common") + F.col("more")) >= 4 * F.col("both")).select("u", "v")


def first_meetings(rest: DataFrame, rooted: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of sets of different roots that can reach the similarity, one of them in rest.

    A pair meets at many keys of its crowd; it is made at the first of them alone, where the
    common heads of the two are counted in place.
    """
    heads = rooted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("heads")).select("node", F.col("heads.key").alias("heads"))
    near = rooted.join(rest.select("key").distinct(), "key", "left_semi")
    a, b = rest.join(heads, "node").alias("a"), near.join(heads, "node").alias("b")
    common = F.array_intersect("a.heads", "b.heads")
    n, m = F.col("a.n"), F.col("b.n")
    enough = 9 * (F.size(common) + F.least("a.colds", "b.colds") + behind(n, m)) >= 4 * (n + m)
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & may_be_similar("a", "b") & (F.element_at(common, 1) == F.col("a.key")) & enough)
    return both.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def similar(pairs: DataFrame, rows: DataFrame, node: str, text_col: str, shingle: int) -> DataFrame:
    """The pairs (u, v) whose sets have similarity 4 / 5 or more."""
    pairs = materialize(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    # texts of other nodes stay where they are: nodes are told apart by some of their bits, in a map of fixed size
    slots = np.zeros(SLOTS, dtype=bool)
    slots[asked.select(F.col("node").bitwiseAND(F.lit(SLOTS - 1)).alias("s")).distinct().toArrow()["s"].to_numpy()] = True
    slots = np.packbits(slots, bitorder="little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = b.column(0).to_numpy() & (SLOTS - 1)
            b = b.filter(pa.array((slots[s >> 3] >> (s & 7) & 1).astype(bool)))
            found = [shingles(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "hs"])

    sets = rows.select(F.col(node).alias("node"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "node long, hs array<long>").dropDuplicates(["node"])
    with bounded_batches(rows.sparkSession, PIECE, PIECE_BYTES):
        sets = materialize(sets, "sets")
    got = pairs.join(sets.select(F.col("node").alias("u"), F.col("hs").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("hs").alias("y")), "v")
    links = materialize(got.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("u", "v"), "links")
    forget(pairs)
    forget(sets)
    return links


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """df's rows with all their columns, one row of each component: that of the smallest id (null last), or any of them."""
    row, node, size, bits, head = (fresh(df, c) for c in ("row", "node", "size", "fp", "heads"))
    wide = T.StructType([*df.schema.fields, T.StructField(node, T.LongType()), T.StructField(size, T.IntegerType()), T.StructField(bits, T.LongType()), T.StructField(head, T.ArrayType(T.LongType()))])
    at = [c.lower() for c in df.columns].index(text_col.lower())
    frequent, counts = frequent_shingles(df, id_col, text_col, shingle)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            all_hashes = [shingle_hashes(t, shingle) for t in b.column(at).to_pylist()]
            fps = pa.array([signed(fold(h)) for h in all_hashes], pa.int64())
            hs = [distinct(h) for h in all_hashes]
            new = [pa.array([digest(h) for h in hs], pa.int64()), pa.array([len(h) for h in hs], pa.int32()), fps, pa.array([heads(h, frequent, counts) for h in hs], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, node, size, bits, head])

    # written once, so that a row keeps its number
    with bounded_batches(df.sparkSession, PIECE, PIECE_BYTES):
        rows = materialize(df.mapInArrow(each, wide).withColumn(row, F.monotonically_increasing_id()), "numbered")
    prints = materialize(rows.groupBy(F.col(node).alias("node"), F.col(size).alias("n")).agg(F.min(bits).alias("fp")), "prints")
    by_print = similar(fingerprint_pairs(prints, hot), rows, node, text_col, shingle)
    forget(prints)
    groups = connected_components(by_print)
    nodes = rows.select(F.col(node).alias("node"), F.col(size).alias("n"), F.col(head).alias("heads")).dropDuplicates(["node"])
    keyed = nodes.select("node", "n", F.posexplode("heads").alias("pos", "key"))
    shared = keyed.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("sets > 1")
    of = Window.partitionBy("node")
    crowded = F.count_if(F.col("sets") > hot).over(of)
    shared = shared.withColumn("met", F.count(F.lit(1)).over(of)).withColumn("crowds", crowded).withColumn("colds", F.col("met") - F.col("crowds"))
    shared = materialize(shared.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "shared")
    cold, crowd = shared.where(F.col("sets") <= hot), shared.where(F.col("sets") > hot)
    pairs = pairs_of(meetings(cold, cold, F.col("a.node") < F.col("b.node"), "crowds"))
    if crowd.isEmpty():
        links = by_print.union(similar(pairs, rows, node, text_col, shingle))
    else:
        # those with most heads in common with others are in the middle of their crowd, and the same ones at most of its keys
        star = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("met"), F.xxhash64("node"), "node"))
        stars = crowd.withColumn("star", star).where(F.col("star") <= STARS)
        first = pairs_of(meetings(stars, crowd, F.col("a.node") != F.col("b.node"), "met"))
        links = by_print.union(similar(pairs.union(first).distinct(), rows, node, text_col, shingle))
        rooted = materialize(crowd.drop("root").join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        most = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
        # two sets of different roots are never both of the most frequent one
        rest = materialize(rooted.join(most, "key").where("root <> most").drop("most"), "rest")
        links = links.union(similar(first_meetings(rest, rooted), rows, node, text_col, shingle))
    roots = connected_components(links)
    forget(shared)
    short = rows.select(F.col(id_col).alias("id"), F.col(node).alias("fp"), F.col(row).alias("row"))
    return keep_first(rows, short, roots.select(F.col("node").alias("fp"), "root"), row).select(df.columns)
