"""Best-fit packing by bin completion (operator 4).

1. Texts become token ids; an end id is added. Documents longer than a sequence are cut, from the end, into whole
   sequences, so that only the first piece may be shorter. One narrow row per piece goes on.
2. The pieces are counted by length. That histogram has as many rows as a sequence has tokens, whatever the corpus,
   and it is all that the plan is made from.
3. The plan (``complete``): around the largest length still there, enumerate the undominated fillings of the rest
   of the sequence and branch over them, best fit first, each as often as the counts allow, then less often. A branch
   ends when its waste exceeds what the best plan so far leaves. Best fit decreasing is the first incumbent. The search
   is whole: if it ends before its ``steps`` are used up, or meets the bound, the plan is ``proven`` the best.
4. Each piece finds its number among the pieces of its length and, by it, its place in the plan. Numbers are given
   within buckets of a length, whose sizes are summed up first; a length with many pieces has many buckets.

Defined results: null and empty texts have one piece with the end id alone. Repeated rows are packed as often as
they occur. Added tokens in a text get their own ids, as ``Tokenizer.encode`` has it. An empty table gives an empty
result; other columns are not carried along.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import batches, settle

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
PIECES_PER_BUCKET = 20_000

# ---- token ids

#: How byte-level vocabularies split a text into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies are written in: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _plain_encoder(definition: dict) -> Callable[[str], np.ndarray] | None:
    """A fast encoder of texts without added tokens for a plain byte-level vocabulary; None for any other.

    Such a vocabulary numbers its words in the order in which they are merged, so merging by number gives the same ids.
    """
    model, words = definition["model"], definition["pre_tokenizer"] or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(o) for o in options) or definition["normalizer"]:
        return None
    if words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
        return None
    byte_of = _byte_of()
    added = {t["content"] for t in definition["added_tokens"]}
    ranks = {bytes(map(byte_of.get, w)): i for w, i in model["vocab"].items() if w not in added}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(model["merges"]))):
        return None
    if sorted(ranks.values()) != list(range(len(ranks))) or any(len(w) > 1 for w, i in ranks.items() if i < 256):
        return None
    from tiktoken import Encoding

    fast = Encoding("plain", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda text: fast.encode_to_numpy(text, disallowed_special=())


class Encoder:
    """Token ids of a text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.plain = _plain_encoder(json.loads(tokenizer.to_str())) or self.whole

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A text with an added token in it takes the tokenizer's own way."""
        encode = self.whole if any(t in text for t in self.added) else self.plain
        return np.asarray(encode(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that its cache serves all tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    short = length % capacity or min(length, capacity)
    return [(0, short)] + [(s, capacity) for s in range(short, length, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    end = END.to_bytes(4, "little")

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches(frames):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tool.ids(text or "") + end
                    for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the plan, from counts by length


@dataclass
class Plan:
    """Fillings with the number of sequences that get each; ``sequences`` in all; ``proven`` if none needs fewer."""

    fillings: list[tuple[tuple[int, ...], int]]
    proven: bool = False

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def _most(filling: tuple[int, ...], counts: np.ndarray) -> int:
    return min(counts[s] // n for s, n in Counter(filling).items())


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit decreasing on counts: the largest piece, then again and again the largest that still fits."""
    counts, fillings = counts.copy(), []
    for size in range(capacity, 0, -1):
        while counts[size]:
            filling, room, use = [size], capacity - size, Counter([size])
            while room:
                nxt = _largest(counts, min(room, size), use)
                if not nxt:
                    break
                filling.append(nxt)
                use[nxt] += 1
                room -= nxt
            n = _most(tuple(filling), counts)
            for s, k in use.items():
                counts[s] -= n * k
            fillings.append((tuple(filling), int(n)))
    return Plan(fillings)


def _largest(counts: np.ndarray, most: int, used: Counter) -> int:
    """The largest size up to ``most`` of which more are left than ``used``."""
    sizes = np.flatnonzero(counts[1 : most + 1]) + 1
    for s in sizes[::-1]:
        if counts[s] > used[int(s)]:
            return int(s)
    return 0


class Steps:
    """What is left of the steps that a search may take."""

    def __init__(self, most: int):
        self.left = most

    def take(self, cost: int = 1) -> bool:
        self.left -= cost
        return self.left >= 0


def _dominated(filling: list[int], room: int, free: list[int]) -> bool:
    """Whether one of the ``free`` pieces (ascending) could take the place of up to two pieces and what is unused.

    Every such filling can do without: the piece could be exchanged for those it replaces in any plan.
    """
    single = [(s, s + room) for s in set(filling)] + [(0, room)]
    pairs = [(a + b - 1, a + b + room) for i, a in enumerate(filling) for b in filling[:i]]
    places = ((low, bisect_right(free, high)) for low, high in single + pairs)
    return any(at and free[at - 1] > low for low, at in places)


def fillings(left: list[int], first: int, capacity: int, steps: Steps) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill up a sequence that holds ``first``, lazily, the largest pieces first.

    ``left`` has the counts without ``first``. The pieces of a filling never ascend, so each comes once.
    """
    sizes = [s for s in range(1, min(first, capacity - first) + 1) if left[s]]

    def extend(room: int, filling: list[int]) -> Iterator[tuple[int, ...]]:
        if not steps.take(1 + len(filling)):
            return
        tried = False
        largest = min(room, filling[-1]) if filling else room
        for at in range(bisect_right(sizes, largest) - 1, -1, -1):
            if filling.count(sizes[at]) < left[sizes[at]]:
                tried = True
                yield from extend(room - sizes[at], [*filling, sizes[at]])
                if steps.left < 0:
                    return
        if not tried and steps.take(len(filling) ** 2 + len(sizes) // 16):
            free = [s for s in sizes if left[s] > filling.count(s)]
            if not _dominated(filling, room, free):
                yield tuple(filling)

    return extend(capacity - first, [])


def complete(counts: np.ndarray, capacity: int = CAPACITY, steps: int = 200_000) -> Plan:
    """Bin completion, depth first; ``steps`` bounds the search. The incumbent is a whole plan at any time."""
    counts = [int(n) for n in counts] + [0] * (capacity + 1 - len(counts))
    tokens = sum(s * n for s, n in enumerate(counts))
    best, bound, budget = best_fit(np.array(counts), capacity), -(-tokens // capacity), Steps(steps)

    def choices(left: list[int]) -> Iterator[tuple[list[int], tuple[int, ...], int]]:
        """What can become of the sequences with the largest piece: (counts then left, filling, times)."""
        first = max(s for s, n in enumerate(left) if n)
        others = [n - (s == first) for s, n in enumerate(left)]
        for rest in fillings(others, first, capacity, budget):
            use = Counter((first, *rest))
            for times in range(min(left[s] // n for s, n in use.items()), 0, -1):
                if not budget.take(1 + capacity // 64):
                    return
                yield [n - times * use.get(s, 0) for s, n in enumerate(left)], (first, *rest), times

    stack = [(choices(counts), 0, None)] if tokens else []  # choices, waste so far, plan as a linked list
    while stack and best.sequences > bound and budget.left > 0:
        options, waste, plan = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
            continue
        left, filling, times = option
        waste += times * (capacity - sum(filling))
        # All plans waste sequences * capacity - tokens; a better one needs one sequence less than the incumbent.
        if waste > (best.sequences - 1) * capacity - tokens:
            continue
        plan = (plan, (filling, times))
        if any(left):
            stack.append((choices(left), waste, plan))
            continue
        found = []
        while plan:
            plan, step = plan
            found.append(step)
        best = Plan(found[::-1])  # within the waste allowed, so a sequence less
    return Plan(best.fillings, proven=best.sequences == bound or (not stack and budget.left > 0))


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the rank from which a slot applies, its first sequence and its offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for filling, n in plan.fillings:
        offset = 0
        for size in filling:
            rows.setdefault(size, []).append((used[size], sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}


# ---- pieces to places


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_rank``: 0, 1, .. among the rows of the same length."""
    per_length = rows.groupBy("length").agg(F.count("*").alias("_n"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.ceil(F.col("_n") / PIECES_PER_BUCKET).cast("long"))
    dealt = rows.join(F.broadcast(per_length), "length").withColumn("_bucket", bucket)  # at most one row per length
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_in"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "_bucket", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_from"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        dealt.withColumn("_at", F.row_number().over(order) - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("_rank", F.col("_from") + F.col("_at"))
        .drop("_n", "_bucket", "_from", "_at")
    )


def placed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (of ``pieces``) with sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    places = slots(complete(counts, capacity))

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                start, first, at = places[int(size)]
                slot = np.searchsorted(start, rank[mine], "right") - 1
                sequence[mine] = first[slot] + rank[mine] - start[slot]
                offset[mine] = at[slot]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kept = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return ranked(rows).mapInArrow(work, f"{kept}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path(VOCABULARY))
    return placed(settle(pieces(docs, path, capacity)), capacity)
