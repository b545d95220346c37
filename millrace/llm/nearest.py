"""Exact top-k search by inner product with KD-trees per shard (operator 1)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, stored

TREE_SCHEMA = "dim int, ids array<long>, points array<long>, begins array<int>, ends array<int>, lefts array<int>, lows array<long>, highs array<long>"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of every component; a vector that is null or holds a null, NaN or infinity is left out, as is a null id."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class Tree:
    """Points in leaf order, and nodes from the root down, each with its range of points, its box and its children."""

    def __init__(self, dim, ids, points, begins, ends, lefts, lows, highs):
        self.ids, self.points = np.asarray(ids, np.int64), np.asarray(points, np.int64).reshape(len(ids), dim)
        self.begins, self.ends, self.lefts = (np.asarray(x, np.int64) for x in (begins, ends, lefts))
        self.lows, self.highs = (np.asarray(x, np.int64).reshape(len(self.begins), dim) for x in (lows, highs))
        self.least = np.array([self.ids[a:b].min() for a, b in zip(self.begins, self.ends, strict=True)], np.int64)

    @staticmethod
    def built(ids: np.ndarray, points: np.ndarray, leaf: int) -> dict:
        """Split at the median of the widest side of each tight box, by count, so that equal points halve too."""
        order = np.arange(len(ids))
        begins, ends, lefts, lows, highs = [0], [len(ids)], [-1], [], []
        k = 0
        while k < len(begins):
            a, b = begins[k], ends[k]
            own = points[order[a:b]]
            lows.append(own.min(0))
            highs.append(own.max(0))
            if b - a > leaf and points.shape[1]:
                side = int((highs[-1] - lows[-1]).argmax())
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], half)]
                lefts[k] = len(begins)
                begins += [a, a + half]
                ends += [a + half, b]
                lefts += [-1, -1]
            k += 1
        flat = lambda x: np.concatenate(x).astype(np.int64)
        return {"dim": points.shape[1], "ids": ids[order], "points": points[order].ravel(), "begins": begins, "ends": ends, "lefts": lefts, "lows": flat(lows), "highs": flat(highs)}


SHARD_BYTES = 16 << 20


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, points) of at most `most` rows of one dimension; a task never holds more than SHARD_BYTES of points beyond a row."""
    held: dict[int, tuple[list, list]] = {}
    size = 0

    def taken(dim: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal size
        ids, points = held.pop(dim)
        size -= 8 * dim * len(ids)
        return np.array(ids, np.int64), np.concatenate(points).reshape(len(ids), dim)

    for b in batches:
        v, ids = b.column("v"), b.column("vec_id").to_pylist()
        at, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, x, y in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = held.setdefault(y - x, ([], []))
            own[0].append(i)
            own[1].append(flat[x:y])
            size += 8 * (y - x)
            if len(own[0]) >= most:
                yield taken(y - x)
            if size >= SHARD_BYTES:
                for dim in list(held):
                    yield taken(dim)
    for dim in list(held):
        yield taken(dim)


def rows_of(columns: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v if c == "dim" else np.asarray(v)], k) for (c, v), k in zip(columns.items(), kinds, strict=True)], list(columns))


def build(vectors: DataFrame, shard: int = 16_384, leaf: int = 128) -> DataFrame:
    """KD-trees over the quantised vectors, a row for each shard of one dimension, of at most `shard` rows and about SHARD_BYTES, built where the rows are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in gathered(batches, shard):
            yield rows_of(Tree.built(ids, points, leaf), [pa.int32(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.int64())] * 2])

    bounded_batches(vectors.sparkSession)
    return vectors.mapInArrow(run, TREE_SCHEMA)


def blocks(queries: DataFrame, block: int) -> DataFrame:
    """dim, ids and points: a row for each block of at most `block` queries of one dimension and about SHARD_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in gathered(batches, block):
            yield rows_of({"dim": points.shape[1], "ids": ids, "points": points.ravel()}, [pa.int32(), *[pa.list_(pa.int64())] * 2])

    return queries.mapInArrow(run, "dim int, ids array<long>, points array<long>")


class Best:
    """The k best (score, id) pairs of one query so far: higher scores, then smaller ids; a pair counts once."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def bar(self) -> tuple[float, int]:
        """What a pair must reach: the k-th score and its id."""
        return (self.heap[0][0], -self.heap[0][1]) if len(self.heap) == self.k else (-np.inf, 0)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        bar = self.bar()[0]
        at = np.flatnonzero(scores >= bar)
        if len(at) > self.k:
            at = at[np.lexsort((ids[at], -scores[at]))]
            fresh = np.concatenate([[True], (ids[at][1:] != ids[at][:-1]) | (scores[at][1:] != scores[at][:-1])])
            at = at[fresh][: self.k]
        for s, i in zip(scores[at].tolist(), ids[at].tolist(), strict=True):
            pair = (s, -i)
            if pair in self.heap:
                continue
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, pair)
            elif pair > self.heap[0]:
                heapq.heapreplace(self.heap, pair)


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where all sums stay below 2**53, else by whole numbers (kept in a long's range)."""
    most = float(np.abs(points).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(points.shape[-1], 1)
    if most < 2**53:
        return (points.astype(np.float64) @ query.astype(np.float64).T).astype(np.int64)
    exact = points.astype(object) @ query.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def descend(tree: Tree, query: np.ndarray, own: int, upper: np.ndarray, best: Best) -> None:
    """Best-first: nodes by the bound of their box, until none can reach the k-th pair."""
    queue = [(-int(upper[0]), 0)]
    while queue:
        bound, node = heapq.heappop(queue)
        bar, last = best.bar()
        if -bound < bar:
            return
        if -bound == bar and tree.least[node] > last:
            continue
        if tree.lefts[node] >= 0:
            for child in (int(tree.lefts[node]), int(tree.lefts[node]) + 1):
                if upper[child] >= bar:
                    heapq.heappush(queue, (-int(upper[child]), child))
            continue
        a, b = tree.begins[node], tree.ends[node]
        ids = tree.ids[a:b]
        scores = products(tree.points[a:b], query)
        other = ids != own
        best.offer(scores[other], ids[other])


def searched(trees: list[Tree], ids: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    """query_id, vec_id, score: the k best of these trees for each query of a block, the k-th pair carried from tree to tree."""
    best = [Best(k) for _ in ids]
    own = ids.tolist()
    for tree in trees:
        for at in range(0, len(vectors), 1024):
            q = vectors[at : at + 1024]
            # A box's bound: each component at the side that gives more.
            upper = products(tree.highs, np.maximum(q, 0)) + products(tree.lows, np.minimum(q, 0))
            for j in range(len(q)):
                descend(tree, q[j], own[at + j], upper[:, j], best[at + j])
    found = [(own[n], -i, s) for n, b in enumerate(best) for s, i in b.heap]
    columns = list(zip(*found, strict=True)) if found else [(), (), ()]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def search(trees: DataFrame, queries: DataFrame, k: int, groups: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each of `groups` groups of trees for each query.

    The trees are shuffled once, by their column part; the blocks of queries are repeated for each group.
    In its partition a group's trees come first and are held, then its blocks of queries stream past them.
    """
    names = ["dim", "ids", "points", "begins", "ends", "lefts", "lows", "highs"]
    lacking = [F.lit(None).cast(trees.schema[c].dataType).alias(c) for c in names[3:]]
    a = trees.select("part", F.lit(0).alias("asks"), *names)
    b = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(1).alias("asks"), *names[:3], *lacking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                now, dim = batch.column("part")[row].as_py(), batch.column("dim")[row].as_py()
                if now != part:
                    part, held = now, {}
                columns = [batch.column(c)[row].values for c in names[1:]]
                if batch.column("asks")[row].as_py() == 0:
                    held.setdefault(dim, []).append(Tree(dim, *(c.to_numpy(zero_copy_only=False).copy() for c in columns)))
                elif dim in held:
                    ids, points = (c.to_numpy(zero_copy_only=False) for c in columns[:2])
                    yield searched(held[dim], ids, points.reshape(len(ids), dim), k)

    return a.union(b).repartitionById(groups, "part").sortWithinPartitions("part", "asks").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 16_384, span: int = 4) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products over all vectors but its own id.

    vectors, queries: vec_id and embedding. Ties go to the smaller vec_id. The trees are written once and dealt to
    groups of `span` on average (fewer while there are not enough for all cores); queries stay in Spark, in blocks of
    `block` rows, which meet every group; each group returns k rows for a query. Neither trees nor queries pass
    through the driver. Vectors that are null or hold a null or a number that isn't finite take no part, nor do null
    ids; vectors of different lengths are never compared; rows that repeat (id and vector) count once; of queries
    that share an id the smallest vector is taken; with fewer than k candidates all are returned; empty tables give
    no rows.
    """
    # A tree's place: the task that built it and its number there, fixed once written.
    trees = stored(build(quantised(vectors)).withColumn("place", F.monotonically_increasing_id()), "trees")
    task, nth = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    n, most = trees.agg(F.count("*"), F.coalesce(F.max(nth) + 1, F.lit(1))).first()
    groups = max(1, -(-n // span), min(n, vectors.sparkSession.sparkContext.defaultParallelism))
    asked = stored(blocks(quantised(queries).groupBy("vec_id").agg(F.min("v").alias("v")), block), "queries")
    dealt = trees.withColumn("part", F.pmod(task * most + nth, F.lit(groups)).cast("int"))
    found = search(dealt, asked, k, groups).repartition("query_id").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
