"""A manifest of a dataset as ternary Merkle trees, with an inclusion witness for every row.

Leaves of one group (a source) are appended in order. An append keeps only the open subtrees of a block of at most
``BLOCK`` leaves: a leaf starts with an empty witness that belongs to its subtree, and whenever a run of siblings is
complete, the witness of every leaf below is extended by the siblings of its subtree and the run becomes one larger
subtree. Blocks are aligned (``BLOCK`` is a power of the arity), so blocks are appended by different tasks, each as a
stream of rows, and their roots are nodes of the next level, appended in blocks in the same way until one root of a
group is left. The roots of all groups are the leaves of a last tree. On the way down, each block's witness extends
those of its nodes. What is stored per level is one row per node with the witness inside its block.

Only digests are shuffled. Places come from a range sort, with counts per range added up, so one group may hold any
share of the rows; every later key is one block. Rows are settled between levels, so lost executors cost one step.

Defined results: null values hash as ``-``; null groups come first and are one group; rows without order come first;
rows of equal order are placed by leaf hash, and equal rows, in whatever order, get the same set of witnesses. The
witness of a lone leaf in a lone group is empty. An empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import null_safe, settle

ARITY = 3
LEVELS = 7
#: Leaves that one append works on; also the most rows of any key of a join.
BLOCK = ARITY**LEVELS


def leaf_hash(*values: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, ``:`` and text; ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def joined_hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Frontier:
    """The open subtrees of one block of leaves, with a witness per leaf that grows with each completed run.

    A step of a witness is a byte (place of the subtree in its run * 4 + size of the run) and the digests of the
    other subtrees of the run.
    """

    def __init__(self, levels: int):
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, subtree: tuple[bytes, int, int]) -> None:
        self.open[level].append(subtree)
        if len(self.open[level]) == ARITY and level < len(self.open) - 1:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [subtree[0] for subtree in run]
        for place, (_, first, end) in enumerate(run):
            step = bytes([place * 4 + len(run)]) + b"".join(digests[:place] + digests[place + 1 :])
            for leaf in range(first, end):
                self.witnesses[leaf] += step
        self._add(level + 1, (joined_hash(digests), run[0][1], run[-1][2]))

    def close(self) -> bytes:
        """Complete the runs that are still open, smallest first; the root."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        return self.open[-1][0][0]


def steps(witness: bytes):
    """(place, siblings) of a witness, from the leaf upwards."""
    at = 0
    while at < len(witness):
        place, size = divmod(witness[at], 4)
        end = at + 1 + 32 * (size - 1)
        yield place, [witness[i : i + 32] for i in range(at + 1, end, 32)]
        at = end


def folded(leaf: bytes, witness: bytes) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for place, siblings in steps(witness):
        leaf = joined_hash([*siblings[:place], leaf, *siblings[place:]])
    return leaf


@F.pandas_udf(T.StringType())
def proof_hash(witness: pd.Series) -> pd.Series:
    """The digest of all siblings of a witness, left to right, level by level."""
    return witness.map(lambda w: joined_hash([d for _, siblings in steps(w) for d in siblings]).hex())


@F.pandas_udf(T.StringType())
def folded_root(leaf: pd.Series, witness: pd.Series) -> pd.Series:
    return pd.Series([folded(a, w).hex() for a, w in zip(leaf, witness)], dtype=object)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` (settled) with ``pos``, the place from 0 within the group, and ``size``, the group's rows.

    Ranges of (group, order) are sorted apart; a row's place is its place in the range plus the counts of the
    group's earlier ranges. Equal rows may be split between ranges.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [group, *order, "_tie"]
    at = settle(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"))
    at = at.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    pieces = at.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        group, "_range", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("size"),
    )
    placed = at.join(pieces, [group, "_range"])
    return placed.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_at", "_range", "_first", "_before"
    )


def _height(size: int) -> int:
    """Levels of a block in a tree of ``size`` nodes."""
    levels = 0
    while ARITY**levels < min(size, BLOCK):
        levels += 1
    return levels


def _append(batches):
    """Rows sorted by (tree, block, pos) with ``witness`` and ``block_root``; a batch leaves once its blocks are closed."""
    waiting: deque = deque()  # (batch, witnesses, roots), rows of the open block still without
    key = front = None
    owed: list = []  # (lists of a batch, rows of the open block in it)

    def close():
        root, at = front.close(), 0
        for (witnesses, roots), rows in owed:
            witnesses.extend(bytes(w) for w in front.witnesses[at : at + rows])
            roots.extend([root] * rows)
            at += rows
        owed.clear()

    def ready():
        while waiting and len(waiting[0][1]) == waiting[0][0].num_rows:
            batch, witnesses, roots = waiting.popleft()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(witnesses, pa.binary()), pa.array(roots, pa.binary())],
                names=[*batch.schema.names, "witness", "block_root"],
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = ([], [])
        waiting.append((batch, *lists))
        columns = (batch.column(name).to_pylist() for name in ("tree", "block", "size", "hash"))
        for tree, block, size, digest in zip(*columns):
            if key != (tree, block):
                if front is not None:
                    close()
                key, front = (tree, block), Frontier(_height(size))
            if not owed or owed[-1][0] is not lists:
                owed.append([lists, 0])
            owed[-1][1] += 1
            front.append(digest)
        yield from ready()
    if front is not None:
        close()
    yield from ready()


def _appended(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos, size, hash, row) with block, witness within it and block_root."""
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    dealt = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    added = [T.StructField("witness", T.BinaryType()), T.StructField("block_root", T.BinaryType())]
    return dealt.mapInArrow(_append, T.StructType([*dealt.schema.fields, *added]))


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The settled levels of the trees of ``nodes``, and (tree, pos, hash) of their roots."""
    levels = []
    while True:
        level = settle(_appended(nodes))
        levels.append(level)
        nodes = level.filter(F.col("pos") % BLOCK == 0).select(
            "tree",
            F.col("block").alias("pos"),
            F.ceil(F.col("size") / BLOCK).cast("long").alias("size"),
            F.col("block_root").alias("hash"),
            F.lit(None).cast("binary").alias("row"),
        )
        if (nodes.agg(F.max("size")).first()[0] or 1) == 1:
            return levels, nodes.select("tree", "pos", "hash")


def _extended(levels: list[DataFrame], above: DataFrame, *carried: str) -> DataFrame:
    """The lowest level's nodes with whole witnesses: ``above`` has (tree, pos, witness) of the roots and ``carried``.

    A key of these joins is one block, so it has at most ``BLOCK`` rows.
    """
    for level in reversed(levels):
        upper = above.select("tree", F.col("pos").alias("block"), F.col("witness").alias("_above"), *carried)
        above = level.join(upper, ["tree", "block"]).withColumn("witness", F.concat("witness", "_above"))
        above = above.select("tree", "pos", "hash", "row", "witness", *carried)
    return above


def manifest(docs: DataFrame, group: Column, order: Column, leaf: Column, row: Column) -> DataFrame:
    """(leaf, row, subroot, root, witness) per row of ``docs``; ``row`` is any small value to carry along.

    Rows of a ``group`` ascend by ``order``. Digests are binary; ``steps`` explains a witness.
    """
    keyed = docs.select(group.cast("string").alias("tree"), order.alias("order"), leaf.alias("hash"), row.alias("row"))
    keyed = settle(keyed.withColumn("tree", null_safe("tree")))
    levels, roots = _grown(numbered(keyed, "tree", ["order", "hash"]).drop("order"))

    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    tops = numbered(settle(tops), "tree", ["name"])
    top_levels, top = _grown(tops.select("tree", "pos", "size", "hash", F.col("name").cast("binary").alias("row")))
    top = top.select("tree", "pos", F.lit(b"").alias("witness"), F.col("hash").alias("root"))
    groups = _extended(top_levels, top, "root").select(
        F.col("row").cast("string").alias("tree"),
        F.lit(0).cast("long").alias("pos"),
        F.col("hash").alias("subroot"),
        "witness",
        "root",
    )
    found = _extended(levels, groups, "subroot", "root")
    return found.select(F.col("hash").alias("leaf"), "row", "subroot", "root", "witness")
