"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected to ``DIMENSIONS`` numbers by a Gaussian (2-stable) matrix, so the squared
projected distance of a pair, over its squared true distance, follows a chi-square distribution
with that many degrees of freedom. Blocks of rows index their projections in a kd-tree. A query
takes the neighbours in order of projected distance, leaves of ``LEAF_ROWS`` one by one and then
more at a time, and verifies each on the original vectors, until the test holds: were any remaining vector nearer than the k-th
found, its projected distance would lie within the frontier with probability ``CONFIDENCE`` at
least. So each true neighbour is found with about that probability or more; there is no other limit.

Every row is indexed: rows are dealt to blocks of about ``BLOCK_ROWS`` by a hash of the id, each
block to a task of its own. The tree of a block is built once; all queries stream past it in batches
that go through the tree together, so memory is a block and a batch. The best of each block
are merged by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessitura.llm.common import Scratch, at, require

DIMENSIONS = 8
CONFIDENCE = 0.95
BLOCK_ROWS = 4096
BATCH_QUERIES = 512
LEAF_ROWS = 64
SEED = 7


def chi_square_cdf(x: float, degrees: int) -> float:
    """The chi-square distribution function for an even number of degrees, in closed form."""
    if x <= 0:
        return 0.0
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


class KdTree:
    """Points in leaves of up to ``leaf_rows``, halved at the median of their widest dimension."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        ends = [len(points)] if len(points) else []
        cuts = [(0, len(points))] if len(points) else []
        while cuts:
            first, last = cuts.pop()
            if last - first > leaf_rows:
                own = self.order[first:last]
                mid = (last - first) // 2
                side = points[own]
                self.order[first:last] = own[np.argpartition(side[:, int(np.argmax(np.ptp(side, axis=0)))], mid)]
                ends.append(first + mid)
                cuts += [(first, first + mid), (first + mid, last)]
        self.first = np.array(sorted({0, *ends} - {len(points)}), np.int64)
        self.last = np.append(self.first[1:], len(points))[: len(self.first)]
        own = points[self.order]
        self.low = np.minimum.reduceat(own, self.first, axis=0) if len(own) else own
        self.high = np.maximum.reduceat(own, self.first, axis=0) if len(own) else own

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of each point to the box of each leaf."""
        out = np.empty((len(points), len(self.first)))
        for i in range(0, len(points), 64):
            p = points[i : i + 64, None, :]
            gap = np.maximum(np.maximum(self.low[None] - p, p - self.high[None]), 0)
            out[i : i + 64] = (gap * gap).sum(axis=2)
        return out


class Block:
    """A block of rows with its tree; ``verified`` counts the pairs that were looked at whole."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.projection = projection
        self.tree = KdTree(vectors @ projection, leaf_rows)
        self.ids, self.vectors = ids[self.tree.order], vectors[self.tree.order]  # rows of a leaf side by side
        self.norms = (self.vectors**2).sum(axis=1)
        self.verified = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query id, id and distance of the k nearest in the block, ties to the smaller id.

        Each round takes the next leaves of every query that is still open, one and then always as
        many as before; queries at one leaf go together. Distances by matrix products tell which rows
        could be among the best, and those are measured by differences.
        """
        tree, n = self.tree, len(queries)
        limit = chi_square_quantile(confidence, self.projection.shape[1])
        gaps = tree.gaps(queries @ self.projection)
        order = np.argsort(gaps, axis=1, kind="stable")
        norms = (queries**2).sum(axis=1)
        slack = 1e-9 * (norms + (self.norms.max() if len(self.norms) else 0.0))
        best_q, best_i, best_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        worst = np.full(n, np.inf)  # of the k best so far
        open_, done, step = np.arange(n), 0, 1
        while len(open_) and done < len(tree.first):
            # unvisited rows are no nearer than the next leaf's box
            open_ = open_[gaps[open_, order[open_, done]] <= limit * worst[open_] * (1 + 1e-9) + 1e-9]
            leaf = order[open_, done : done + step]
            done, step = done + leaf.shape[1], done + leaf.shape[1]
            asking, leaf = np.repeat(open_, leaf.shape[1]), leaf.ravel()
            by = np.argsort(leaf, kind="stable")
            new_q, new_r = [best_q[:0]], [best_q[:0]]
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1) if len(by) else []:
                a, b = tree.first[leaf[group[0]]], tree.last[leaf[group[0]]]
                q = asking[group]
                about = norms[q, None] + self.norms[None, a:b] - 2 * (queries[q] @ self.vectors[a:b].T)
                self.verified += about.size
                qs, rows = np.nonzero(about <= (worst[q] * (1 + 1e-9) + slack[q])[:, None])
                new_q.append(q[qs])
                new_r.append(rows + a)
            qs, rows = np.concatenate(new_q), np.concatenate(new_r)
            other = self.ids[rows] != query_ids[qs]
            qs, rows = qs[other], rows[other]
            d = np.concatenate([((self.vectors[rows[i : i + 8192]] - queries[qs[i : i + 8192]]) ** 2).sum(axis=1) for i in range(0, len(rows), 8192)] or [best_d[:0]])
            best_q, best_i, best_d = np.concatenate([best_q, qs]), np.concatenate([best_i, self.ids[rows]]), np.concatenate([best_d, d])
            keep = np.lexsort((best_i, best_d, best_q))
            best_q, best_i, best_d = best_q[keep], best_i[keep], best_d[keep]
            place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            keep = place < k
            last = place == k - 1
            worst[best_q[last]] = best_d[last]
            best_q, best_i, best_d = best_q[keep], best_i[keep], best_d[keep]
        return query_ids[best_q], best_i, np.sqrt(best_d)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, finite throughout, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS) -> DataFrame:
    """For the rows where ``queries`` holds, the k nearest other rows by Euclidean distance.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the distance in double
    precision), ties to the smaller id; fewer rows where there are fewer candidates. Rows with
    a null id, or a vector that is null, empty, zero or has a null or non-finite component, take
    no part; neither do candidates of another length than the query's. Rows that repeat a
    query's id are no candidates for it and, as queries, count once each vector's best. Other
    columns take no part. An empty table gives an empty table.
    """
    require(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(at(vectors, id_col).cast("long").alias("id"), at(vectors, vector_col).cast("array<double>").alias("v"), queries.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = scratch.save(rows.withColumn("length", F.size("v")), "rows")
    counts = rows.groupBy("length").agg(F.count("*").alias("n"), F.count_if("q").alias("n_q")).where("n_q > 0")
    counts = counts.select("length", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    # blocks are numbered through all lengths, of which a table has few
    numbered = scratch.save(counts.withColumn("before", F.sum("blocks").over(Window.orderBy("length")) - F.col("blocks")), "blocks")
    total = numbered.agg(F.sum("blocks")).first()[0] or 1
    rows = rows.join(numbered, "length")
    own = F.pmod(F.xxhash64(F.lit(SEED), "id", "v"), F.col("blocks"))
    unit = (F.col("before") + own).cast("int").alias("unit")
    asked = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (F.col("before") + b).cast("int"))).alias("unit")
    sides = rows.select(unit, F.lit(False).alias("asks"), "id", "v").unionByName(rows.where("q").select(asked, F.lit(True).alias("asks"), "id", "v"))
    sides = sides.repartitionById(int(total), F.col("unit")).sortWithinPartitions("unit", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, block = None, [], None
        for batch in batches:
            ids, v = batch.column(2).to_numpy(), batch.column(3)
            width = v.value_lengths().to_numpy()
            values, starts = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(width)])
            units, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(units) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
                if a == b:
                    continue
                if units[a] != unit:
                    unit, waiting, block = units[a], [], None
                mine = values[starts[a] : starts[b]].reshape(b - a, -1)
                if not asks[a]:
                    waiting.append((ids[a:b], mine.copy()))
                    continue
                if block is None and waiting:
                    # for vectors of one length the projection is the same in every block
                    projection = np.random.default_rng([SEED, mine.shape[1]]).standard_normal((mine.shape[1], dimensions))
                    block = Block(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]), projection)
                    waiting = []
                for i in range(0, b - a if block else 0, BATCH_QUERIES):
                    found = block.search(ids[a:b][i : i + BATCH_QUERIES], mine[i : i + BATCH_QUERIES], k, confidence)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    found = sides.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
