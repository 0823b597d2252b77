"""Operator 3, sharding by balanced label propagation.

Documents of equal text are linked. Labels (shards) spread over links in rounds of
Spark joins: a document moves to the shard that holds most of its linked bytes, as
far as that shard's quota allows. Documents without links then fill what the
quotas have left. The law is ``bytes``: shards are of nearly equal size.

How the quota is held:

* Documents of over 1 / BIG of a shard number at most shards * BIG. They are placed
  first, on the driver, largest first into the emptiest shard, their links together.
* In a round, the share of movers that fits into a shard's free bytes moves. Whole
  groups move or stay, by a hash; a group of over a quarter of a shard moves by
  document, and aims at as many shards as it needs.
* What stands above a quota leaves again, and so do groups that are still apart: groups of at
  most TOGETHER documents whole. They and
  the documents without links are ordered by hash, and cut where the running sum of bytes meets the
  shards' free bytes; running sums are per bucket of a bounded number of rows.

Defined cases: a null or empty text has size 16 and links with all of them; ties
between shards go to the smaller; repeated rows are placed each; null ids are
allowed; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, forget, materialize, number_within

SHARDS = 40
OVERHEAD = 16
BIG = 200
#: Rounds end when the bytes that want to move stop falling; these are the most.
ROUNDS = 6
ROWS_PER_BUCKET = 20_000
#: Groups of at most so many documents also stay together when their shard is over its quota.
TOGETHER = 1000


def unit(*cols: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def described(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, g, key): g names the text, key orders rows at random and sets apart repeated ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.monotonically_increasing_id().alias("m"))
    return out.select("id", (F.octet_length("t") + OVERHEAD).cast("long").alias("size"), F.crc32("t").alias("crc"), F.xxhash64("t").alias("g"), F.xxhash64("m", "id", F.xxhash64("t")).alias("key"))


def place_big(rows: list, load: list[float], mean: float) -> list[tuple[int, int]]:
    """(key, shard) of the big documents: groups together while they fit, largest first into the emptiest shard."""
    groups: dict[int, list] = defaultdict(list)
    for r in rows:
        groups[r.g].append(r)
    items: list[list] = []
    for rs in groups.values():
        fit = max(1, int(mean / 4 // max(r.size for r in rs)))
        rs.sort(key=lambda r: r.key)
        items += [rs[k : k + fit] for k in range(0, len(rs), fit)]
    heap = [(x, s) for s, x in enumerate(load)]
    heapq.heapify(heap)
    out = []
    for rs in sorted(items, key=lambda rs: (-sum(r.size for r in rs), rs[0].key)):
        x, s = heapq.heappop(heap)
        out += [(r.key, s) for r in rs]
        heapq.heappush(heap, (x + sum(r.size for r in rs), s))
    for x, s in heap:
        load[s] = x
    return out


def per_shard(df: DataFrame, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum("size")).collect()}
    return [int(got.get(s) or 0) for s in range(shards)]


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def propagate(linked: DataFrame, quota: list[float], shards: int, rounds: int) -> DataFrame:
    """linked (id, size, crc, g, key, shard) after the rounds; a shard's linked bytes stay near its quota."""
    mean, before = sum(quota) / shards, float("inf")
    for step in range(rounds):
        cells = linked.groupBy("g", "shard").agg(F.sum("size").alias("bytes"))
        free = [q - x for q, x in zip(quota, per_shard(linked, shards), strict=True)]
        # a group's shards, fullest first, that can take more; as many as the group needs
        room = F.element_at(literal(free), F.col("shard") + 1)
        able = F.when(room > 0.01 * mean, F.struct(-F.col("bytes"), F.col("shard")))
        goals = cells.groupBy("g").agg(F.sum("bytes").alias("all"), F.sort_array(F.collect_list(able)).alias("open"), F.max(F.struct("bytes", -F.col("shard"))).alias("best")).where("size(open) > 0")
        width = F.least(F.greatest(F.ceil(F.col("all") / F.lit(mean)), F.lit(1)), F.size("open")).cast("int")
        goals = goals.select("g", "all", F.slice(F.transform("open", lambda x: x["shard"]), 1, width).alias("goals"), (-F.col("best")["col2"]).alias("home"), F.col("open")[0]["shard"].alias("first"))
        # written first: the join is then of two plain tables, and adaptive execution may split a hot group
        goals = materialize(goals, "goals")
        large = F.col("all") > mean / 4
        pick = F.element_at("goals", (F.pmod("key", F.size("goals")) + 1).cast("int"))
        # small groups gather at their fullest shard; if it is closed they stay, unless an open one is where they are going
        goal = F.when(large, F.when(F.array_contains("goals", F.col("shard")) | (F.col("shard") == F.col("home")), F.col("shard")).otherwise(pick)).otherwise(F.col("first"))
        aimed = materialize(linked.join(goals, "g", "left").withColumn("goal", F.coalesce(goal, F.col("shard"))).withColumn("draw", F.when(large, unit(F.lit(step), "key")).otherwise(unit(F.lit(step), "g"))).drop("all", "goals", "home", "first"), "aimed")
        want = {r[0]: r[1] for r in aimed.where("goal <> shard").groupBy("goal").agg(F.sum("size")).collect()}
        if not want or sum(want.values()) >= before:
            return aimed.drop("goal", "draw")
        before = sum(want.values())
        leave = {r[0]: r[1] for r in aimed.where("goal <> shard").groupBy("shard").agg(F.sum("size")).collect()}
        share = [min(1.0, max(0.0, free[s] + 0.5 * leave.get(s, 0)) / want[s]) if want.get(s) else 1.0 for s in range(shards)]
        goes = F.col("draw") < F.element_at(literal(share), F.col("goal") + 1)
        linked = aimed.withColumn("shard", F.when(goes, F.col("goal")).otherwise(F.col("shard"))).drop("goal", "draw")
    return linked


def pour(rest: DataFrame, free: list[float], rows: int) -> DataFrame:
    """rest with shards: in order of key, cut where the running bytes meet the shards' shares of them."""
    n = buckets_for(rows, ROWS_PER_BUCKET)
    rest = rest.withColumn("b", F.pmod("with", F.lit(n)))
    sums = rest.groupBy("b").agg(F.sum("size").alias("x"))
    base = sums.select("b", F.coalesce(F.sum("x").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = float(rest.agg(F.sum("size")).first()[0] or 0)
    edges, at = [], 0.0
    for x in free:
        at += x * total / max(1.0, sum(free))
        edges.append(at)
    within = Window.partitionBy("b").orderBy("with", "key").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("base") + F.sum("size").over(within) - F.col("size") / 2
    shard = sum((F.when(F.col("middle") >= e, 1).otherwise(0) for e in edges[:-1]), F.lit(0))
    return rest.join(base, "b").withColumn("middle", middle).withColumn("shard", shard.cast("int")).select("id", "size", "crc", "g", "key", "with", "shard")


def assign(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, size, crc, g, shard, slot) per row: slot numbers a shard's rows from 0."""
    base = materialize(described(df, id_col, text_col), "described")
    total, rows = (int(x or 0) for x in base.agg(F.sum("size"), F.count(F.lit(1))).first())
    mean = total / shards
    big = F.col("size") > mean / BIG
    load = [0.0] * shards
    placed = place_big(base.where(big).select("g", "size", "key").collect(), load, mean) if rows else []
    cols = ["id", "size", "crc", "g", "key", "with", "shard"]
    parts = []
    if placed:
        where = base.sparkSession.createDataFrame(placed, "key long, shard int")
        parts.append(base.where(big).withColumn("with", F.col("key")).join(F.broadcast(where), "key").select(cols))
    small = base.where(~big)
    twice = materialize(small.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    # with: what a document moves with, its group or itself
    marked = small.join(twice, "g", "left").withColumn("linked", F.col("n").isNotNull()).withColumn("with", F.when(F.col("n") <= TOGETHER, F.col("g")).otherwise(F.col("key"))).drop("n")
    marked = materialize(marked, "marked")
    quota = [max(0.0, mean - x) for x in load]
    linked = marked.where("linked").drop("linked").withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).select(cols)
    linked = propagate(linked, quota, shards, rounds)
    # small groups that the quotas kept apart are lifted out whole, and poured with the rest
    apart = linked.where(F.col("with") == F.col("g")).groupBy("g").agg(F.min("shard").alias("a"), F.max("shard").alias("z")).where("a <> z").select("g", F.lit(True).alias("apart"))
    linked = materialize(linked.join(materialize(apart, "apart"), "g", "left").withColumn("apart", F.col("apart").isNotNull()), "linked")
    lifted = linked.where("apart").select(cols[:-1])
    linked = linked.where("NOT apart").select(cols)
    have = per_shard(linked, shards)
    # what stands above the quota leaves by hash, with a little more, and is poured with the rest
    over = [min(1.0, 1.02 * (x - q) / x + 0.002) if x > q else -1.0 for x, q in zip(have, quota, strict=True)]
    out = unit(F.lit("over"), "with") < F.element_at(literal(over), F.col("shard") + 1)
    stay = linked.where(~out)
    rest = materialize(marked.where("NOT linked").drop("linked").select(cols[:-1]).union(lifted).union(linked.where(out).select(cols[:-1])), "rest")
    have = per_shard(stay, shards)
    parts += [stay.select(cols), pour(rest, [max(0.0, q - x) for x, q in zip(have, quota, strict=True)], rows).select(cols)]
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.union(p)
    everything = materialize(everything, "shards")
    forget(marked)
    buckets = buckets_for(-(-rows // shards), ROWS_PER_BUCKET)
    return number_within(everything.withColumn("b", F.pmod("key", F.lit(buckets))), "shard", ["key", "id"], "b", "slot").drop("b", "key", "with")
