"""Exact top-k inner-product search: a ball tree per shard, searched branch and bound.

Vectors are dealt to shards of bounded size by a hash of their row, and each shard's task builds
a ball tree. A query's bound on a ball is its product with the centre plus its length times the
radius; nodes are opened from the largest bound down and skipped when they cannot reach the
query's current k-th score. Shards are searched in rounds, few first: after each round the k-th
score that a query has over all shards so far is where every shard of the next round starts.

Queries are packed into blocks of bounded size. A task meets a group of blocks with a group of
shards; groups are dealt to tasks as rows, so neither vectors nor queries go through the driver.

Vectors that are null, empty or that hold null or non-finite parts take no part; neither do null
ids. Vectors of another length have no product with a query and are not its candidates. Ties go
to the smaller id; rows with the query's own id are not its candidates, other repeated rows count
one by one. Fewer than k candidates give fewer rows, none gives none. An id asks once, with its
smallest vector if it has several. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import drop_tables, materialize, parts_for

#: Bytes of vectors in a shard and in a block of queries, and how many of them at most meet in one task.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 2 << 20
GROUP = 16
LEAF_ROWS = 64


@dataclass
class BallTree:
    """Rows in leaf order; node i has rows[lo[i]:hi[i]], and children i's in ``kids`` (0: leaf)."""

    ids: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    kids: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def build_tree(ids: np.ndarray, rows: np.ndarray) -> BallTree:
    """Split at the median along the line between two far points until a node is a leaf."""
    order = np.arange(len(ids))
    nodes: list[list[int]] = [[0, len(ids), 0]]
    at = 0
    while at < len(nodes):
        lo, hi, _ = nodes[at]
        part = rows[order[lo:hi]]
        if hi - lo > LEAF_ROWS:
            far = part[np.argmax(((part - part[0]) ** 2).sum(axis=1))]
            other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
            if (far != other).any():
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argsort(part @ (far - other), kind="stable")]
                nodes[at][2] = len(nodes)
                nodes += [[lo, lo + mid, 0], [lo + mid, hi, 0]]
        at += 1
    rows, ids = rows[order], ids[order]
    lo, hi, kids = np.array(nodes, np.int64).T
    centres = np.array([rows[a:b].mean(axis=0) for a, b in zip(lo, hi, strict=True)])
    radii = np.array([np.sqrt(((rows[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(lo, hi, centres, strict=True)])
    return BallTree(ids, rows, lo, hi, kids, centres, radii)


def search_tree(tree: BallTree, own: int, query: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
    """The k best (score, id) of the tree that reach ``floor``, nodes opened by falling bound."""
    bounds = tree.centres @ query + np.sqrt(query @ query) * tree.radii
    bounds += 1e-6 * (1 + np.abs(bounds))  # rounding may not prune a tie
    best: list[tuple[float, int]] = []  # a heap of (score, -id): the worst first
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < floor:
            break
        kid = tree.kids[node]
        if kid:
            heapq.heappush(heap, (-bounds[kid], kid))
            heapq.heappush(heap, (-bounds[kid + 1], kid + 1))
            continue
        lo, hi = tree.lo[node], tree.hi[node]
        scores = tree.rows[lo:hi] @ query
        for i in np.flatnonzero(scores >= floor).tolist():
            found = float(scores[i]), -int(tree.ids[lo + i])
            if -found[1] == own:
                continue
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
        if len(best) == k:
            floor = max(floor, best[0][0])
    return [(s, -i) for s, i in best]


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and floor(256 x) of each valid vector, as doubles."""
    part = F.col("embedding")
    valid = F.col("vec_id").isNotNull() & part.isNotNull() & (F.size(part) > 0)
    sound = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(valid).filter(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_shards(vecs: DataFrame, n: int) -> DataFrame:
    """dim, shard, tree: one ball tree for each length of vectors in each of n shards."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == dim))
                held.setdefault(dim, []).append((some.column(0).to_numpy(), matrix(some.column(1))))
        for dim, parts in held.items():
            tree = build_tree(*map(np.concatenate, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    # sorted, so that a task that runs again builds the same tree
    return vecs.repartition(n, F.xxhash64("vec_id", "v")).sortWithinPartitions("vec_id").mapInArrow(build, "dim int, shard int, tree binary")


def query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """dim, block, ids, rows, floors: queries(query_id, v, dim, floor) packed by length into blocks of n or fewer tasks' shares."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows, floors = map(np.concatenate, zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([rows.tobytes()], pa.binary()), "floors": pa.array([floors.tobytes()], pa.binary())})

        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == dim))
                held.setdefault(dim, []).append((some.column(0).to_numpy(), matrix(some.column(1)), some.column(3).to_numpy()))
                if sum(len(x[0]) for x in held[dim]) * dim * 8 >= BLOCK_BYTES:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return queries.select("query_id", "v", "dim", "floor").repartition(n, "query_id").mapInArrow(pack, "dim int, block int, ids binary, rows binary, floors binary")


FOUND = "query_id long, vec_id long, score double"


def search_round(shards: DataFrame, blocks: DataFrame, k: int, n_shards: int, n_blocks: int) -> DataFrame:
    """The k best of each group of shards for each query of the blocks, those that reach the query's floor."""
    shard_groups, block_groups = parts_for(n_shards, min(GROUP, max(1, n_shards // 64))), parts_for(n_blocks, min(GROUP, max(1, n_blocks // 8)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = shards.withColumn("sg", F.col("shard") % shard_groups).withColumn("bg", every(block_groups))
    right = blocks.withColumn("bg", F.col("block") % block_groups).withColumn("sg", every(shard_groups))

    def run(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        trees = [pickle.loads(t) for t in own.column("tree").to_pylist()]
        out: list[tuple[int, int, float]] = []
        dim = key[0].as_py()
        for ids, rows, floors in zip(*(asked.column(c).to_pylist() for c in ("ids", "rows", "floors")), strict=True):
            ids, rows, floors = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.float64).reshape(-1, dim), np.frombuffer(floors, np.float64)
            for q, row, floor in zip(ids.tolist(), rows, floors.tolist(), strict=True):
                best: list[tuple[float, int]] = []
                for tree in trees:  # what one shard finds is where the next starts
                    best = heapq.nsmallest(k, [*best, *search_tree(tree, q, row, k, floor)], key=lambda x: (-x[0], x[1]))
                    if len(best) == k:
                        floor = max(floor, best[-1][0])
                out += [(q, v, s) for s, v in best]
        q, v, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    on = ["dim", "sg", "bg"]
    parts = shard_groups * block_groups
    return left.repartition(parts, *on).groupBy(*on).cogroup(right.repartition(parts, *on).groupBy(*on)).applyInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; Spark keeps k of a query per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def rounds_of(n: int) -> list[tuple[int, int]]:
    """Ranges of shards: one, about an eighth, the rest."""
    cuts = sorted({0, min(1, n), min(-(-n // 8), n), n})
    return list(zip(cuts, cuts[1:], strict=False))


def top_k(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Per query (ids divisible by ``every``): query_id, rank, vec_id, score of its k best other rows."""
    spark = table.sparkSession
    vecs = vectors(table).withColumn("dim", F.size("v"))
    asked = (F.pmod("vec_id", F.lit(every)) == 0).alias("asked")
    size, queries_size = vecs.select("dim", asked).agg(F.sum("dim"), F.sum(F.when(F.col("asked"), F.col("dim")))).first()
    n_shards, n_blocks = parts_for((size or 0) * 8, SHARD_BYTES, 1), parts_for((queries_size or 0) * 8, BLOCK_BYTES, 1)
    shards = materialize(build_shards(vecs.select("vec_id", "v", "dim"), n_shards), "ball-trees")
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1  # as many as there were tasks
    queries = materialize(vecs.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "top-queries")
    best = spark.createDataFrame([], FOUND + ", rank int")
    for first, last in rounds_of(n_shards):
        floors = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        ready = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = search_round(shards.filter(F.col("shard").between(first, last - 1)), query_blocks(ready, n_blocks), k, last - first, n_blocks)
        before = best
        best = materialize(best_of(best.select("query_id", "vec_id", "score").unionByName(found), k), "top-best")
        drop_tables(spark, before)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
