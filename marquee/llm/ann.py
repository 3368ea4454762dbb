"""Nearest neighbours by largest inner product: hierarchical k-means tree, best bin first (operator 1).

1. Equal vectors are one row with the 21 smallest ids of their copies: no more of them can be among 20 neighbours
   of anything. So copies cost nothing, however many there are, and none is lost.
2. A tree is fitted on a bounded sample (``sample_size``): k-means with ``BRANCHES`` centres at every node, down to
   about 2 * sqrt(rows) leaves. Vectors get one more component that makes all lengths equal, so the largest inner
   product is the smallest distance. Every row goes to one leaf.
3. A query walks the tree with a priority queue of centres by distance and takes leaves in the order they come out.
   How many it visits is calibrated: for ``CALIBRATION`` queries the exact neighbours are found by comparing with
   all rows in blocks, and the visits are widened until ``TARGET`` of them lie in visited leaves.
4. Queries meet the rows of their leaves in blocks of bounded size of either side; a block returns the best of each
   query, and these are merged. Scores are inner products of the original vectors in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
those of another number of components than most have. A row with the query's own id is no candidate. Repeated rows
count once. With fewer candidates than wanted, all are returned. An empty table gives an empty result. Other
columns are not carried along.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import batches, settle

NEAREST = 20
EVERY = 20
BRANCHES = 16
ROUNDS = 8
CALIBRATION = 200
TARGET = 0.97
BLOCK = 2048
LEAST_SAMPLE, MOST_SAMPLE = 20_000, 200_000


def sample_size(rows: int) -> int:
    """How many vectors the tree is fitted on; never over ``MOST_SAMPLE``."""
    return int(min(MOST_SAMPLE, max(LEAST_SAMPLE, 40 * math.sqrt(rows))))


@dataclass
class Node:
    centres: np.ndarray
    children: list  # of Node or leaf numbers


@dataclass
class Tree:
    root: Node | int
    leaves: int
    length: float  # that all vectors are brought to by the added component
    visits: int = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.length**2 - (x * x).sum(axis=1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, down the nearest centres."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)), self.lifted(x))]
        while todo:
            node, at, rows = todo.pop()
            if not isinstance(node, Node):
                out[at] = node
                continue
            near = _distances(rows, node.centres).argmin(axis=1)
            for i in np.unique(near):
                mine = near == i
                todo.append((node.children[i], at[mine], rows[mine]))
        return out

    def walk(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first."""
        scale = self.length / max(np.linalg.norm(query), 1e-300)
        lifted = np.append(query * scale, 0.0)[None]
        heap, found, tick = [(0.0, 0, self.root)], [], 0
        while heap and len(found) < visits:
            _, _, node = heapq.heappop(heap)
            if not isinstance(node, Node):
                found.append(int(node))
                continue
            for d, child in zip(_distances(lifted, node.centres)[0].tolist(), node.children, strict=True):
                tick += 1
                heapq.heappush(heap, (d, tick, child))
        return found


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, less the part that is the same for all centres."""
    return (centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T)


def grow(sample: np.ndarray, leaves: int, length: float) -> Tree:
    tree = Tree(0, 1, length)
    if not len(sample):
        return tree
    shuffle = np.random.default_rng(11)
    most = max(1, len(sample) // max(1, leaves))
    count = 0

    def build(x: np.ndarray) -> Node | int:
        nonlocal count
        if len(x) <= most * 1.5 or len(x) < 4:
            count += 1
            return count - 1
        k = int(min(BRANCHES, max(2, round(len(x) / most))))
        centres = x[shuffle.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = _distances(x, centres).argmin(axis=1)
            for i in np.unique(near):
                centres[i] = x[near == i].mean(axis=0)
        near = _distances(x, centres).argmin(axis=1)
        used = np.unique(near)
        if len(used) < 2:
            count += 1
            return count - 1
        return Node(centres[used], [build(x[near == i]) for i in used])

    tree.root = build(tree.lifted(sample))
    tree.leaves = count
    return tree


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, k1, k2): the rows that take part; equal vectors have equal keys."""
    v = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # also turns -0.0 into 0.0
    good = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    return good.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))


def classes(rows: DataFrame) -> DataFrame:
    """(k1, k2, v, ids): one row per different vector, with the smallest ids that have it."""
    place = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= NEAREST + 1)
    return few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def best_of(queries: np.ndarray, rows: np.ndarray, first_ids: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: row numbers and scores of its best rows, ties to the smaller id."""
    rough = queries @ rows.T
    keep = min(len(rows), most + 11)
    out = []
    for i, q in enumerate(queries):
        at = np.argpartition(-rough[i], keep - 1)[:keep] if keep < len(rows) else np.arange(len(rows))
        # all rows level with the last one kept
        if keep < len(rows):
            at = np.flatnonzero(rough[i] >= rough[i][at].min() - 1e-12)
        score = (rows[at] * q).sum(axis=1)
        order = np.lexsort((first_ids[at], -score))[:most]
        out.append((at[order], score[order]))
    return out


def placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Adds ``leaf``."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            leaf = shared.value.assign(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["k1", "k2", "v", "ids", "leaf"])

    return rows.select("k1", "k2", "v", "ids").mapInArrow(work, "k1 long, k2 long, v array<double>, ids array<long>, leaf int")


def exact_leaves(placed_rows: DataFrame, queries: np.ndarray) -> list[list[int]]:
    """The leaves of the nearest rows of a few queries, by comparing them with every row, block by block."""
    shared = placed_rows.sparkSession.sparkContext.broadcast(queries)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            x, leaf = _matrix(batch.column(0)), batch.column(1).to_numpy()
            found = best_of(shared.value, x, np.arange(len(x)), NEAREST + 1)
            sizes = [len(at) for at, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(sizes)), sizes)),
                    pa.array(np.concatenate([s for _, s in found])),
                    pa.array(leaf[np.concatenate([at for at, _ in found])]),
                ],
                ["q", "score", "leaf"],
            )

    near = placed_rows.select("v", "leaf").mapInArrow(work, "q long, score double, leaf int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    out: list[list[int]] = [[] for _ in queries]
    for r in near.withColumn("_n", place).filter(F.col("_n") <= NEAREST + 1).collect():  # queries * 21 rows
        out[r["q"]].append(r["leaf"])
    return out


def calibrated(tree: Tree, queries: np.ndarray, leaves: list[list[int]], target: float = TARGET) -> int:
    """The fewest visits at which ``target`` of the exact neighbours lie in visited leaves."""
    ranks = []
    for q, found in zip(queries, leaves, strict=True):
        order = {leaf: i + 1 for i, leaf in enumerate(tree.walk(q, tree.leaves))}
        ranks += [order[leaf] for leaf in found]
    if not ranks:
        return tree.leaves
    return int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)])


def build(rows: DataFrame) -> tuple[Tree, DataFrame]:
    """The calibrated tree and every class of ``rows`` (of ``classes``) with its leaf."""
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)))).first()
    picked = rows.orderBy("k1", "k2").select("v").limit(sample_size(n)).toArrow()
    sample = _matrix(picked.column(0))
    tree = grow(sample, int(min(2 * math.sqrt(n), len(sample) / 20)), longest or 0.0)
    indexed = settle(placed(rows, tree))
    some = sample[:: max(1, len(sample) // CALIBRATION)][:CALIBRATION]
    if len(some):
        tree.visits = calibrated(tree, some, exact_leaves(indexed, some))
    return tree, indexed


def visited(queries: DataFrame, tree: Tree) -> DataFrame:
    """(k1, k2, v, leaves): each query with the leaves it visits."""
    shared = queries.sparkSession.sparkContext.broadcast(tree)

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            found = [shared.value.walk(q, shared.value.visits) for q in _matrix(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], ["k1", "k2", "v", "leaves"])

    return queries.select("k1", "k2", "v").mapInArrow(work, "k1 long, k2 long, v array<double>, leaves array<int>")


def search(rows: DataFrame, queries: DataFrame, tree: Tree) -> DataFrame:
    """(k1, k2, score, vec_id): the NEAREST + 1 best rows of each query class, by leaf and block."""
    walks = settle(visited(queries, tree))
    ends = walks.select(F.explode("leaves").alias("leaf"))
    n_rows = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # as many as leaves
    n_queries = {r["leaf"]: r["count"] for r in ends.groupBy("leaf").count().collect()}
    shape = [(leaf, -(-n // BLOCK), -(-n_queries[leaf] // BLOCK)) for leaf, n in n_rows.items() if leaf in n_queries]
    spark = rows.sparkSession
    blocks = F.broadcast(spark.createDataFrame(shape, "leaf int, row_blocks int, query_blocks int"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        rows.join(blocks, "leaf")
        .withColumn("rb", F.pmod("k1", F.col("row_blocks")).cast("int"))
        .withColumn("qb", every("query_blocks"))
        .select("leaf", "rb", "qb", "v", "ids")
    )
    right = (
        walks.withColumn("leaf", F.explode("leaves"))
        .join(blocks, "leaf")
        .withColumn("qb", F.pmod("k1", F.col("query_blocks")).cast("int"))
        .withColumn("rb", every("row_blocks"))
        .select("leaf", "rb", "qb", "k1", "k2", "v")
    )
    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def compare(key: tuple, mine: pa.Table, asked: pa.Table) -> pa.Table:
        if not mine.num_rows or not asked.num_rows:
            return out.empty_table()
        ids = mine.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]]
        found = best_of(_matrix(asked.column("v")), _matrix(mine.column("v")), first, NEAREST + 1)
        sizes = [len(at) for at, _ in found]
        at = np.concatenate([a for a, _ in found])
        k1, k2 = (np.repeat(asked.column(k).to_numpy(), sizes) for k in ("k1", "k2"))
        return pa.Table.from_arrays([pa.array(k1), pa.array(k2), pa.array(np.concatenate([s for _, s in found])), ids.take(pa.array(at))], schema=out)

    keys = ["leaf", "rb", "qb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "k1 long, k2 long, score double, ids array<long>")
    each = near.select("k1", "k2", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("_place", place).filter(F.col("_place") <= NEAREST + 1).drop("_place")


def nearest(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``."""
    rows = usable(embeddings)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))
    distinct = settle(classes(rows))
    tree, indexed = build(distinct)
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2", "v")
    queries = asked.groupBy("k1", "k2").agg(F.first("v").alias("v"))
    found = search(indexed, queries, tree)
    own = asked.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    order = Window.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "vec_id")
    return (
        own.join(found, ["k1", "k2"])
        .filter("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= NEAREST)
        .select("query_id", "rank", "vec_id", "score")
    )
