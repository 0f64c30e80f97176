"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to shards by a hash of their id, about ``shard_rows`` each. A
shard's tree splits its vectors, level by level, at the median distance from a
vantage point, down to leaves of ``leaf`` vectors; it's stored as one row of
arrays. Queries go in blocks of ``block`` to every shard: the trees stay where
they are, one row each, and the blocks are copied to them, so a shard's tree is
unpacked once and searched with one block after the other. In a tree, a side is passed over, for each
query of the block on its own, if the triangle inequality puts all its vectors
beyond the k-th distance so far; ``relax`` multiplies that bound: 1 (the
default) keeps the search exact, above 1 prunes more and may miss some.
The k best of each shard and query are merged by query.

Distances are Euclidean, in double precision on the original vectors, summed
in the order of the components. Ties go to the smaller id.

Defined results: null, empty or zero vectors, and those that hold null, NaN or
infinity, take no part, nor do null ids; a query meets vectors of its own
length only; a query with fewer than k candidates gets
all; an empty table gives no rows. A candidate that repeats is found once per
row; a query that repeats, with its id and vector, is asked once. Different
vectors under one query id have a list each. Columns not asked for are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import stored

SHARD_ROWS = 8192
LEAF = 128
BLOCK = 512
#: Components of vectors that are subtracted at a time.
_NUMBERS = 1 << 20
#: The id of a place that is free.
_FREE = np.iinfo(np.int64).max


def distances(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each row's distance from q, summed from the first component on."""
    d = rows - q
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


class Best:
    """The k nearest so far of each query of a block, the nearest first, ties by id; places still free are infinitely far."""

    def __init__(self, queries: int, k: int) -> None:
        self.far = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), _FREE)

    @property
    def limit(self) -> np.ndarray:
        return self.far[:, -1]

    def take(self, query: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        """Candidates: the query of each, ascending, its distance and id."""
        some, first, many = np.unique(query, return_index=True, return_counts=True)
        k, wide = self.far.shape[1], int(many.max())
        place = np.arange(len(query)) - np.repeat(first, many)
        all_far, all_ids = np.full((len(some), k + wide), np.inf), np.full((len(some), k + wide), _FREE)
        all_far[:, :k], all_ids[:, :k] = self.far[some], self.ids[some]
        row = np.repeat(np.arange(len(some)), many)
        all_far[row, k + place], all_ids[row, k + place] = far, ids
        order = np.lexsort((all_ids, all_far))[:, :k]
        self.far[some], self.ids[some] = np.take_along_axis(all_far, order, 1), np.take_along_axis(all_ids, order, 1)


class Tree:
    """Nodes in arrays; ``inner[i] < 0`` marks a leaf, which holds rows low[i] to high[i]."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        nodes: list[list] = []
        place = np.arange(len(ids))
        work = [(0, len(ids), -1, 0)]
        while work:
            low, high, parent, side = work.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][3 + side] = me
            nodes.append([low, high, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
            if high - low <= leaf:
                continue
            own = place[low:high]
            # the vantage point: of a few rows, the one whose distances vary the most
            some = own[:: max(1, len(own) // 5)][:5]
            v = max(some, key=lambda r: (distances(self.vectors[own[:: max(1, len(own) // 64)]], self.vectors[r]).var(), -r))
            d = distances(self.vectors[own], self.vectors[v])
            by = np.argsort(d, kind="stable")
            half = len(by) // 2
            place[low:high] = own[by]
            nodes[me][2] = v
            nodes[me][5:] = [d[by[0]], d[by[half - 1]], d[by[half]], d[by[-1]]]
            work += [(low, low + half, me, 0), (low + half, high, me, 1)]
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        self.ids, self.vectors = self.ids[place], self.vectors[place]
        self.nodes = [(a, b, int(back[v]) if v >= 0 else -1, i, o, *m) for a, b, v, i, o, *m in nodes]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, relax: float = 1.0) -> Best:
        """The k nearest of each row of q but those of its id in ``own``; a side's bound is ``relax`` times the triangle inequality's."""
        best = Best(len(q), k)
        squares = (self.vectors**2).sum(1)
        q_squares = (q**2).sum(1)
        work = [(0, np.arange(len(q)), np.zeros(len(q)))] if len(self.ids) else []
        while work:
            me, active, bound = work.pop()
            active = active[bound <= best.limit[active]]
            if not len(active):
                continue
            low, high, v, inner, outer, a, b, c, d = self.nodes[me]
            if inner < 0:
                # a product tells, but for rounding, which pairs can be near enough; their distances are then taken exactly
                rough = squares[low:high] + q_squares[active, None] - 2 * (q[active] @ self.vectors[low:high].T)
                slack = 1e-9 * (squares[low:high] + q_squares[active, None])
                near = ~(rough - slack > best.limit[active, None] ** 2 * (1 + 1e-12)) & (self.ids[low:high] != own[active, None])
                of, at = np.nonzero(near)
                if len(of):
                    step = max(1, _NUMBERS // q.shape[1])
                    far = [distances(self.vectors[low + at[x : x + step]], q[active[of[x : x + step]]]) for x in range(0, len(of), step)]
                    best.take(active[of], np.concatenate(far), self.ids[low + at])
                continue
            at = distances(q[active], self.vectors[v])
            slack = 1e-9 * (1 + at)
            sides = [(child, relax * (np.maximum(np.maximum(near - at, at - far), 0.0) - slack)) for child, near, far in ((inner, a, b), (outer, c, d))]
            # the side that more of them are nearer to is searched first
            if (sides[0][1] <= sides[1][1]).sum() * 2 >= len(active):
                sides.reverse()
            work += [(child, active, own_bound) for child, own_bound in sides]
        return best


def _usable(vector: Column) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """One row per shard: its tree, in bytes."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))

    def plant(_: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lists = table.column("v").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        flat, starts = np.asarray(lists.flatten()), np.cumsum(sizes) - sizes
        trees = {}
        for size in sorted(set(sizes.tolist())):
            at = np.flatnonzero(sizes == size)
            trees[size] = Tree(ids[at], flat[starts[at][:, None] + np.arange(size)], leaf)
        return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([pickle.dumps(trees)], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(plant, "shard int, tree binary")


def search(index: DataFrame, queries: DataFrame, k: int = 10, relax: float = 1.0, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Each query's k nearest in the index but itself: query_id, rank, vec_id, score (distance)."""
    asked = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v"))).distinct()
    shards, blocks = (index.agg(F.max("shard")).first()[0] or 0) + 1, max(1, -(-queries.count() // block))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("asked"))
    # a tree's row comes before the blocks that were copied to it; with few trees, each goes to several tasks that share its blocks
    tasks = max(1, 2 * index.sparkSession.sparkContext.defaultParallelism // shards) if blocks > 1 else 1
    copies = min(tasks, blocks)
    trees = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(-1).alias("block"), "tree", F.lit(None).cast("array<struct<id:bigint,v:array<double>>>").alias("asked"))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod("block", F.lit(copies)).alias("copy"), "block", F.lit(None).cast("binary").alias("tree"), "asked")
    dealt = trees.unionByName(sent).repartitionById(shards * copies, F.col("shard") * copies + F.col("copy")).sortWithinPartitions("shard", "copy", "block")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                if (tree := batch.column("tree")[i].as_py()) is not None:
                    trees = pickle.loads(tree)
                    continue
                ids, vectors = batch.column("asked")[i].values.flatten()
                ids = ids.to_numpy()
                sizes = np.asarray(vectors.value_lengths())
                flat, starts = np.asarray(vectors.flatten()), np.cumsum(sizes) - sizes
                for size in sorted(set(sizes.tolist()) & set(trees)):
                    at = np.flatnonzero(sizes == size)
                    best = trees[size].search(flat[starts[at][:, None] + np.arange(size)], ids[at], k, relax)
                    row, place = np.nonzero(np.isfinite(best.far) | (best.ids != _FREE))
                    columns = [pa.array(ids[at[row]]), pa.array(at[row].astype(np.int32)), pa.array(best.ids[row, place]), pa.array(best.far[row, place])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(row), batch.column("block")[i].as_py(), np.int32))], names=["query_id", "place", "vec_id", "score", "block"])

    found = dealt.select("block", "tree", "asked").mapInArrow(look, "query_id bigint, place int, vec_id bigint, score double, block int")
    best = Window.partitionBy("query_id", "block", "place").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, relax: float = 1.0) -> DataFrame:
    """``search`` over a freshly stored index of ``vectors``."""
    return search(stored(build_index(vectors), "trees"), queries, k, relax)
