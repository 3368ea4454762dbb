"""Hard negatives of anchors, by inner product, with bounds from segment means and deviations.

A vector is cut into 1, 4, 16, ... segments of neighbouring components, and the mean and deviation of each segment are
stored with it. The inner product of two segments of length n lies within n * (product of the means +- product of the
deviations), so the sums over a level's segments bound the score of a pair, and finer levels bound it more tightly.
Pairs whose bounds cannot reach what is wanted are left out level by level; the others are scored exactly.

Anchors are a stated query set. They are taken in blocks of bounded size, and each block passes over all vectors where
these lie: nothing is shuffled but the best few of each task. A first pass finds an anchor's positives (best rows of
its label), a second one the best rows of other labels whose score lies between ``floor`` times and once the
positive's. A task keeps the best so far, whose last score raises what a bound has to reach.

Defined results: rows with null id, null label, null vector or a component that is null or not finite take no part;
vectors of another length than the anchor's are no partners of it. A repeated id is a row of its own, as anchor too.
Vectors of no components score 0. Scores are exact whole numbers; beyond +-2**56 they count as +-2**56. An anchor
without positives, and a positive without negatives, has no rows. An empty table gives none. Other columns are not
read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import batches, settle

#: Components of the anchors of one block (32 MB), and most anchors of one.
BLOCK_VALUES, BLOCK_ROWS = 4_000_000, 1024
#: Vectors that are compared with a block of anchors at once.
CHUNK = 1024
#: Beyond this share of pairs, bounds and scores are computed for all pairs of a chunk at once.
DENSE = 0.1
#: Whole numbers of this size and below are exact in double precision.
EXACT, MOST = 2.0**53, 2**56
NONE = -(2**62)

STORED = "vec_id long, label long, dim int, vector binary, summary binary"


def segments(dim: int) -> list[np.ndarray]:
    """The first components of the segments, per level."""
    counts = [1]
    while counts[-1] * 4 <= dim // 2:
        counts.append(counts[-1] * 4)
    return [np.arange(n) * dim // n for n in counts] if dim else []


def summaries(vectors: np.ndarray) -> list[np.ndarray]:
    """Per level the means, then the deviations, of the segments, both times the root of the length."""
    dim = vectors.shape[1]
    levels = []
    for starts in segments(dim):
        lengths = np.diff([*starts, dim])
        mean = np.add.reduceat(vectors, starts, axis=1) / lengths
        apart = vectors - np.repeat(mean, lengths, axis=1)
        deviation = np.sqrt(np.add.reduceat(apart * apart, starts, axis=1))
        levels.append(np.hstack([mean * np.sqrt(lengths), deviation]))
    return levels


def stored(rows: DataFrame, vec_id: Column, label: Column, vector: Column, scale: float) -> DataFrame:
    """Rows that take part, with whole-number vectors floor(scale * x), their summaries and a row number ``rid``."""
    given = rows.select(
        vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector")
    ).filter("vec_id is not null and label is not null and vector is not null")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    if given.rdd.getNumPartitions() < tasks:  # few files that cannot be split
        given = given.repartition(tasks)

    def summed(frames):
        for batch in batches(frames):
            column = batch.column("vector")
            dims = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
            ends = np.cumsum(dims)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            sound = bad[ends] == bad[ends - dims]
            with np.errstate(over="ignore"):
                values = np.floor(values * scale)
            ids, labels = batch.column("vec_id"), batch.column("label")
            for dim in np.unique(dims[sound]):
                at = np.flatnonzero(sound & (dims == dim))
                vectors = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                with np.errstate(all="ignore"):
                    summary = np.hstack([*summaries(vectors), np.zeros((len(at), 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at)),
                        labels.take(pa.array(at)),
                        pa.array(np.full(len(at), dim, np.int32)),
                        pa.array([v.tobytes() for v in vectors], pa.binary()),
                        pa.array([s.tobytes() for s in summary], pa.binary()),
                    ],
                    names=["vec_id", "label", "dim", "vector", "summary"],
                )

    return settle(given.mapInArrow(summed, STORED)).withColumn("rid", F.monotonically_increasing_id())


@dataclass
class Vectors:
    """Rows of one length as arrays."""

    rid: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    values: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def read(cls, batch, dim: int) -> Vectors:
        def matrix(name: str, width: int) -> np.ndarray:
            column = batch.column(name)
            return np.frombuffer(b"".join(column.to_pylist())).reshape(batch.num_rows, width)

        widths = [2 * len(starts) for starts in segments(dim)]
        summary = matrix("summary", sum(widths))
        cuts = np.cumsum([0, *widths])
        numbers = (batch.column(name).to_numpy() for name in ("rid", "vec_id", "label"))
        return cls(*numbers, matrix("vector", dim), [summary[:, a:b] for a, b in zip(cuts, cuts[1:])])

    def norms(self) -> np.ndarray:
        if not self.levels:
            return np.zeros(len(self.rid))
        return np.sqrt((self.levels[0] ** 2).sum(axis=1))


def _scores(a: np.ndarray, b: np.ndarray, paired: bool) -> np.ndarray:
    """Exact inner products: of all rows, or ``paired`` row by row."""
    with np.errstate(all="ignore"):
        found = np.einsum("ij,ij->i", a, b) if paired else a @ b.T
        if a.size and b.size and not np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
            left, right = ([[int(v) for v in row] for row in m] for m in (a, b))
            pairs = zip(left, right) if paired else ((x, y) for x in left for y in right)
            whole = [max(-MOST, min(MOST, sum(map(int.__mul__, x, y)))) for x, y in pairs]
            return np.array(whole, np.int64).reshape(found.shape)
    return found.astype(np.int64)


def close_pairs(anchors: Vectors, rows: Vectors, same_label: bool, low: np.ndarray, high: np.ndarray):
    """(anchor, row, score) of all pairs of equal or of different labels with low <= score <= high of the anchor.

    Pairs go from level to level until their bounds show that they lie outside.
    """
    alive = (anchors.label[:, None] == rows.label) == same_label
    alive &= anchors.rid[:, None] != rows.rid
    slack = 1e-9 * anchors.norms()[:, None] * rows.norms() + 1
    with np.errstate(all="ignore"):
        for ours, theirs in zip(anchors.levels, rows.levels):
            half = ours.shape[1] // 2
            if alive.mean() > DENSE:
                mean = ours[:, :half] @ theirs[:, :half].T
                apart = ours[:, half:] @ theirs[:, half:].T + slack
                alive &= ~((mean + apart < low[:, None]) | (mean - apart > high[:, None]))
            else:
                i, j = np.nonzero(alive)
                mean = np.einsum("ps,ps->p", ours[i, :half], theirs[j, :half])
                apart = np.einsum("ps,ps->p", ours[i, half:], theirs[j, half:]) + slack[i, j]
                alive[i, j] = ~((mean + apart < low[i]) | (mean - apart > high[i]))
    i, j = np.nonzero(alive)
    if alive.mean() > DENSE:
        score = _scores(anchors.values, rows.values, False)[i, j]
    else:
        score = _scores(anchors.values[i], rows.values[j], True)
    kept = (score >= low[i]) & (score <= high[i])
    return i[kept], j[kept], score[kept]


class Best:
    """The ``k`` best (score, then smaller id) of each of a number of groups."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.vec_id = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(groups, NONE, np.int64)  # score that has to be reached

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        kept = score >= self.last[group]
        group, score, vec_id = (
            np.concatenate([old, new[kept]])
            for old, new in ((self.group, group), (self.score, score), (self.vec_id, vec_id))
        )
        order = np.lexsort((vec_id, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        best = place < self.k
        self.group, self.score, self.vec_id = group[best], score[order][best], vec_id[order][best]
        full = place == self.k - 1
        self.last[group[full]] = score[order][full]


def _chunks(batch):
    """Pieces of a batch, each of one vector length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        for first in range(0, len(at), CHUNK):
            yield int(dim), batch.take(pa.array(at[first : first + CHUNK]))


def _by_dim(table: pa.Table) -> dict[int, Vectors]:
    dims = set(table.column("dim").to_pylist())
    parts = {dim: table.filter(pa.compute.equal(table.column("dim"), dim)).combine_chunks() for dim in dims}
    return {dim: Vectors.read(part, dim) for dim, part in parts.items()}


def _best_rows(frames, anchors: dict[int, Vectors], same_label: bool, ranges: dict | None, k: int):
    """The task's best rows of each group; ``ranges`` has (low, high) scores of an anchor's groups, all if None."""
    found = {}
    for batch in batches(frames):
        for dim, piece in _chunks(batch):
            if dim not in anchors:
                continue
            ours, rows = anchors[dim], Vectors.read(piece, dim)
            low, high = ranges[dim] if ranges else (np.full((len(ours.rid), 1), NONE), np.full((len(ours.rid), 1), -NONE))
            groups = low.shape[1]
            best = found.setdefault(dim, Best(low.size, k))
            need = np.maximum(low, best.last.reshape(low.shape))
            i, j, score = close_pairs(ours, rows, same_label, need.min(axis=1), high.max(axis=1))
            for g in range(groups):
                inside = (score >= low[i, g]) & (score <= high[i, g])
                best.add(i[inside] * groups + g, score[inside], rows.vec_id[j[inside]])
    for dim, best in found.items():
        groups = ranges[dim][0].shape[1] if ranges else 1
        rid = anchors[dim].rid[best.group // groups]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (rid, best.group % groups, best.vec_id, best.score)],
            names=["anchor_rid", "place", "vec_id", "score"],
        )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best of all tasks; ``rank`` from 1."""
    order = Window.partitionBy("anchor_rid", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``stored`` rows.

    Per anchor the best ``positives`` rows of its label, and for each of them the best ``negatives`` rows of other
    labels with percent * positive_score <= 100 * negative_score <= 100 * positive_score.
    """
    schema = "anchor_rid long, place long, vec_id long, score long"
    anchors = rows.filter(is_anchor)
    many, widest = anchors.agg(F.count("*"), F.max("dim")).first()
    size = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, widest or 1)))
    blocks = max(1, math.ceil(many / size))
    answers = None
    for number in range(blocks):
        block = _by_dim(anchors.filter(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == number).toArrow())
        near = rows.mapInArrow(lambda frames, block=block: _best_rows(frames, block, True, None, positives), schema)
        near = settle(_ranked(near, positives))
        ranges = _ranges(block, near.toArrow(), positives, percent)
        far = rows.mapInArrow(
            lambda frames, block=block, ranges=ranges: _best_rows(frames, block, False, ranges, negatives), schema
        )
        place = (F.col("rank") - 1).cast("long").alias("place")
        named = near.select(
            "anchor_rid", place, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ).join(anchors.select(F.col("rid").alias("anchor_rid"), F.col("vec_id").alias("anchor_id")), "anchor_rid")
        answer = _ranked(far, negatives).join(named, ["anchor_rid", "place"])
        answers = answer if answers is None else answers.union(answer)
    return answers.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def _ranges(block: dict[int, Vectors], near: pa.Table, positives: int, percent: int) -> dict:
    """Per length, the lowest and highest score of a negative for each anchor and positive; none where none is."""
    rid, rank, score = (near.column(name).to_numpy() for name in ("anchor_rid", "rank", "score"))
    ranges = {}
    for dim, anchors in block.items():
        low = np.full((len(anchors.rid), positives), -NONE, np.int64)
        high = np.full((len(anchors.rid), positives), NONE, np.int64)
        order = np.argsort(anchors.rid)
        at = np.searchsorted(anchors.rid, rid, sorter=order)
        ours = (at < len(order)) & (anchors.rid[order[np.minimum(at, len(order) - 1)]] == rid)
        i, place, s = order[at[ours]], rank[ours] - 1, score[ours]
        low[i, place] = -(-percent * s // 100)
        high[i, place] = s
        ranges[dim] = (low, high)
    return ranges
