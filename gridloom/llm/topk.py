"""Operator 6, exact top-k search by an impact-ordered, score-at-a-time index.

Components are integers, floor(256 * x). Rows go into blocks of about CELLS components
by hash; each block is indexed in one task: the postings of a dimension, sorted by
value, are cut into segments of one quantised level. For a query, segments are taken by
descending impact, the most that one of their postings can change a score, up or down.
What is left of a dimension is then a range of values round zero, so after a batch of
segments a row's score is at most what it has plus, for each dimension it still stands in, the
most that range can add. The rows that lead are scored exactly; a row whose bound is
below the k-th of those is proven out. Processing stops when at most a
sixteenth of the block is not proven out, or no segment is left; those rows are scored exactly.

Every block meets every query in pieces of at most QUERIES queries; its k best per
query are merged by a ranking over (blocks * k) rows per query.

Sums of integers below 2^53 are exact in doubles. Rows and queries with a component so
large that this could fail stand outside the index and are scored in whole numbers of any size.

Defined cases: rows with a null id, a null vector, or null or non-finite
components take no part; rows that repeat an id are rows of their own, as candidates
and as queries; missing components of shorter vectors count as 0; ties go to the smaller
id; a score beyond a long is ranked by its value (up to 38 digits) and returned as the
nearest long; fewer than k candidates give fewer rows; an empty table, or one without
queries, gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, materialize

SCALE = 256
CELLS = 1 << 18  # components of a block
QUERIES = 4096
LEVELS = 32  # quantised values on each side of zero
LEADERS = 32
LONG = (1 << 63) - 1
FAR = 10**38 - 1


class BlockIndex:
    """Impact-ordered segments over a block of vectors of integers, all small enough for exact sums."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        n, dims = x.shape
        self.ids, self.x, self.small = ids, x.astype(np.float64), x.astype(np.int32)
        order = np.argsort(x, axis=0, kind="stable")
        values = np.take_along_axis(self.x, order, axis=0)
        level = np.floor(values / max(1.0, np.ceil(np.abs(values).max(initial=0) / LEVELS)))
        first = np.vstack([np.ones((min(n, 1), dims), dtype=bool), level[1:] != level[:-1]])
        # postings and segments of all dimensions, one dimension after the other
        self.docs, self.values = order.T.ravel().astype(np.int32), values.T.ravel()
        self.starts = np.flatnonzero(first.T.ravel())
        self.ends = np.append(self.starts[1:], n * dims)
        self.dims = self.starts // max(1, n)
        self.low, self.high = self.values[self.starts], self.values[self.ends - 1]
        self.size = np.maximum(np.abs(self.low), np.abs(self.high))
        self.first = np.searchsorted(self.dims, np.arange(dims))

    def search(self, own: int, q: np.ndarray, k: int, few: int | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(positions, scores) of the k best rows but that at position own, best first, ties to the smaller id; rows scored exactly, postings processed."""
        n, dims = self.x.shape
        few = max(k, n // 16) if few is None else few
        alive = np.delete(np.arange(n), own) if own >= 0 else np.arange(n)
        processed, bar, score = 0, -np.inf, np.zeros(n)
        # a query without components scores 0 everywhere
        order = np.argsort(-np.abs(q[self.dims]) * self.size, kind="stable") if len(alive) > few else np.zeros(0, np.int64)
        sizes = (self.ends - self.starts)[order]
        done = np.cumsum(sizes)
        is_open = np.ones(len(self.dims), dtype=bool)
        at, budget, leaders = 0, 3 * n * dims // 8, np.zeros(0, np.int64)
        while at < len(order) and len(alive) > few:
            to = min(len(order), int(np.searchsorted(done, budget)) + 1)
            part, length = order[at:to], sizes[at:to]
            rows = np.repeat(self.starts[part] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            score += np.bincount(self.docs[rows], weights=self.values[rows] * np.repeat(q[self.dims[part]], length), minlength=n)
            processed, at, budget = processed + len(rows), to, budget + n * dims // 8
            is_open[part] = False
            low = np.minimum.reduceat(np.where(is_open, self.low, np.inf), self.first)
            high = np.maximum.reduceat(np.where(is_open, self.high, -np.inf), self.first)
            some = low <= high
            low, high = np.where(some, low, 0), np.where(some, high, 0)
            most = np.maximum(low * q, high * q)
            lead = alive if len(alive) <= LEADERS + k else alive[np.argpartition(-score[alive], LEADERS + k)[: LEADERS + k]]
            leaders = np.union1d(leaders, lead)
            bar = max(bar, np.partition(self.x[lead] @ q, len(lead) - k)[len(lead) - k])
            # a dimension without postings left adds 0, whatever the row has there
            x = self.small if len(alive) > n // 2 else self.small[alive]
            stands = (x - low.astype(np.int32)).view(np.uint32) <= (high - low).astype(np.uint32)
            upper = score[alive] + (stands @ most if len(x) == len(alive) else (stands @ most)[alive])
            alive = alive[upper >= bar]
        exact = self.x[alive] @ q
        best = np.lexsort((alive, self.ids[alive], -exact))[:k]
        return alive[best], exact[best], len(np.union1d(alive, leaders)), processed


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled with 0."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims))
    end = np.cumsum(size)
    out[np.repeat(np.arange(len(lists)), size), np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers."""
    return np.array([[int(v) * scale if abs(v) >= 1 << 52 else int(np.floor(scale * v)) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


class Block:
    """A block's rows, those with small components in an index, and the rest beside it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, scale: int) -> None:
        self.ids, self.rows, self.raw, self.scale = ids, rows, x, scale
        with np.errstate(over="ignore"):
            self.x = np.floor(scale * x)
        self.limit = np.floor(np.sqrt((1 << 53) / max(1, x.shape[1])))
        small = (np.abs(self.x) <= self.limit).all(1)
        self.inside, self.outside = np.flatnonzero(small), np.flatnonzero(~small)
        self.index = BlockIndex(ids[small], self.x[small])
        self.place = {int(r): k for k, r in enumerate(rows[small].tolist())}
        self.big = whole(x[~small], scale)

    def search(self, row: int, x: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int, int]:
        """[(score, position)] of the k best rows but that of the query itself, rows scored exactly, and postings processed."""
        with np.errstate(over="ignore"):
            q = np.floor(self.scale * x)
        if (np.abs(q) <= self.limit).all():
            at, score, scored, processed = self.index.search(self.place.get(row, -1), q, k)
            found = list(zip(map(int, score), self.inside[at].tolist(), strict=True))
            if not len(self.outside):
                return found, scored, processed
        else:
            scored, processed, q_all = len(self.inside), 0, whole(x[None, :], self.scale)[0]
            found = [(int(s), p) for s, p in zip(whole(self.raw[self.inside], self.scale) @ q_all, self.inside.tolist(), strict=True)]
        found += [(int(s), p) for s, p in zip(self.big @ whole(x[None, :], self.scale)[0], self.outside.tolist(), strict=True)]
        found = sorted(((s, p) for s, p in found if self.rows[p] != row), key=lambda f: (-f[0], self.ids[f[1]], f[1]))
        return found[:k], scored + len(self.outside), processed


FOUND = "query_row long, query_id long, id long, score long, far decimal(38,0), scored long, postings long"


def searched(df: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """FOUND: every block's k best rows per query; the first of them has the block's work, which is 0 in the others."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & ~F.coalesce(bad.alias("b"), F.lit(True)))
    # written once, so that a row keeps its number
    rows = materialize(rows.select("id", F.monotonically_increasing_id().alias("row"), F.col("v").cast("array<double>").alias("v")), "vectors")
    n, n_query, dims = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("v"))).first()
    dims = max(1, int(dims or 0))
    blocks, pieces = buckets_for(n, max(64, CELLS // dims)), buckets_for(n_query, QUERIES)
    # the query set against all rows, block by block: a row goes to every piece of queries, a query to every block
    docs = rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    # under names of its own: a cogroup loses columns that both sides have from one table
    asks = rows.where(is_query).select(F.col("id").alias("q_id"), F.col("row").alias("q_row"), F.col("v").alias("q")).withColumn("p", F.pmod(F.xxhash64(F.lit("query"), "q_row"), F.lit(pieces)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            # in the order of rows, so that the result does not depend on how they came
            left = left.sort_by("row")
            block = Block(left["id"].to_numpy(), left["row"].to_numpy(), matrix(left["v"], dims), scale)
            for row, i, q in zip(right["q_row"].to_pylist(), right["q_id"].to_pylist(), matrix(right["q"], dims), strict=True):
                found, scored, postings = block.search(row, q, k)
                for m, (s, p) in enumerate(found):
                    far = None if abs(s) <= LONG else Decimal(max(-FAR, min(FAR, s)))
                    out.append((row, i, int(block.ids[p]), max(-LONG - 1, min(LONG, s)), far, *((0, 0) if m else (scored, postings))))
        kinds = [pa.int64()] * 4 + [pa.decimal128(38, 0), pa.int64(), pa.int64()]
        names = ["query_row", "query_id", "id", "score", "far", "scored", "postings"]
        return pa.table({name: pa.array([r[c] for r in out], t) for c, (name, t) in enumerate(zip(names, kinds, strict=True))})

    return docs.groupBy("b", "p").cogroup(asks.groupBy("b", "p")).applyInArrow(each, FOUND)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): per query row the k rows of the largest inner product, rank from 1.

    is_query: a condition on the column ``id``.
    """
    found = searched(df, is_query, k, id_col, vector_col, scale)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.coalesce("far", F.col("score").cast("decimal(38,0)")).desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def work(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, scored, postings): how many rows a search scores exactly, and how many postings it processes, over all blocks."""
    return searched(df, is_query, k, id_col, vector_col, scale).groupBy("query_row", "query_id").agg(F.sum("scored").alias("scored"), F.sum("postings").alias("postings")).drop("query_row")
