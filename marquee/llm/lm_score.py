"""Stupid-backoff scores from n-gram tables partitioned by hash (operator 5).

S(w | u) = count(u w) / count(u) where the corpus has the n-gram, else ``BACKOFF`` times the score after a shorter
history, in the end count(w) / number of words. A document's score is the mean of log S over its words; the first word
follows a start mark. Counts are over the whole corpus, without a cutoff. Two ways to ask:

``scores(docs)`` scores a corpus by itself, in word pairs. All its pairs are in the tables, so none backs off, and a pair
seen once has count 1. ``seen_once`` tells how many words of a document end such a pair: no other text has it.
``scores(docs, own=False)`` scores every document (row) by the counts of all the others: its own counts are taken off. A
pair that no other document has backs off to the word, count(w) / number of words of the others, and ``backed_off`` tells
how many words do. A word that no other document has scores as if it had occurred once.

* texts(part, doc_id, ws): the documents, with ``part`` a hash of the whole row. Both steps that read words read the same
  shuffle of them: the first asks for counts, the second meets the answers and scores.
* asked(part, pack, kind, ws, ns): the different words and word pairs of one part of the documents (now called a pack) with
  their counts there, ``part`` a hash of the word or pair. A word or pair comes once from each pack at most, however often
  it occurs, so no part gathers a hot one.
* answers(pack, part, kind, ns): the counts in the whole corpus, in the order of the question.

Words are 64-bit hashes, pairs 64-bit hashes of both. Rows of asked and answers hold arrays: all that goes from one pack
to one part. The number of parts follows the numbers of words and rows, so part and pack have a bounded mean size; only
copies of one row, in id and text, are all in one pack, and one document is never split.

``scores_against(docs, corpus)`` scores any documents by the tables of any corpus, with n-grams of ``order`` words: joins
of exploded n-grams with the count tables, salted, and the first order that has the n-gram decides. A word that the
corpus lacks scores as if it had occurred once; ``backed_off`` counts the words whose full n-gram is unknown.

Defined results: texts without words (null, empty) have n_words 0 and a null score. Rows that differ in id or text
are scored apart; repeated rows have equal scores. A repeated row is a document of its own: without ``own``, its copies
count. An empty table gives an empty result; an empty corpus, or no other document with words, null scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import WORD
from marquee.operators.skew import salted_join

ORDER = 3
BACKOFF = 0.4
WORDS_PER_PART = 2_000_000
WIDTH = 8
START = 1

ASKED = pa.schema(
    [("part", pa.int32()), ("pack", pa.int32()), ("kind", pa.int32()), ("ws", pa.binary()), ("ns", pa.binary()), ("ends", pa.binary())]
)
ANSWERS = pa.schema([("pack", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("ns", pa.binary()), ("ends", pa.binary())])
SCORES = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("seen_once", pa.int64()), ("backed_off", pa.int64())]
)
PAIRS, WORDS = range(2)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of both words; with one given, different others never meet."""
    return u * np.uint64(0xD6E8FEB86659FD93) + (w ^ w >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, compressed; the first byte tells how many."""
    top = int(values.max(initial=0))
    width = next(n for n in (1, 2, 4, 8) if top < 1 << 8 * n)
    return bytes([width]) + pa.compress(values.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def _of_small(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[1:], n * data[0], codec="zstd", asbytes=True), f"<u{data[0]}").astype(np.int64)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict({name: [r[name] for r in rows] for name in schema.names}, schema)


def _split(part: np.ndarray) -> list[np.ndarray]:
    """The places of each part's entries, in order."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.flatnonzero(part[order][1:] != part[order][:-1]) + 1) if len(order) else []


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("long"), text)
    return docs.select(key.alias("key"), F.col("doc_id").cast("long"), text.cast("binary").alias("text"))


def _histories(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    u = np.r_[np.uint64(0), w[:-1]]
    u[first] = START
    return u


class Read(NamedTuple):
    """The words of some documents: number of words of each; document, hash and whether it is the first or last, of each word."""

    sizes: np.ndarray
    row: np.ndarray
    w: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _read(texts: pa.ChunkedArray) -> Read:
    hashes = []
    for text in texts:
        words = text.as_py().split()
        hashes.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
    sizes = np.array([len(h) for h in hashes], np.int64)
    w = np.concatenate([np.zeros(0, np.uint64), *hashes])
    ends = np.cumsum(sizes)[sizes > 0]
    first, last = np.zeros(len(w), bool), np.zeros(len(w), bool)
    first[ends - sizes[sizes > 0]] = last[ends - 1] = True
    return Read(sizes, np.repeat(np.arange(len(sizes)), sizes), w, first, last)


def _asks(parts: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def asks(key: tuple, rows: pa.Table) -> pa.Table:
        """What a pack of documents has of each pair and word."""
        read = _read(rows.column("ws"))
        words, n = np.unique(read.w, return_counts=True)
        ends = np.bincount(np.searchsorted(words, read.w[read.last]), minlength=len(words))
        pairs, n_pairs = np.unique(_pair(_histories(read.w, read.first), read.w), return_counts=True)
        out = []
        for kind, grams, counts in ((PAIRS, pairs, n_pairs), (WORDS, words, n)):
            part = _part(grams, parts)
            for at in _split(part):
                row = {"part": int(part[at[0]]), "pack": key[0].as_py(), "kind": kind, "ws": grams[at].tobytes(), "ns": _small(counts[at])}
                out.append(row | {"ends": _small(ends[at]) if kind == WORDS else b""})
        return _table(out, ASKED)

    return asks


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """The counts of a part's pairs and words, to every pack that asked."""
    out = []
    for kind in (PAIRS, WORDS):
        asked = rows.filter(pa.array(np.array(rows.column("kind")) == kind)).select(["pack", "ws", "ns", "ends"]).to_pylist()
        if not asked:
            continue
        sizes = [len(r["ws"]) // WIDTH for r in asked]
        _, at = np.unique(np.concatenate([np.frombuffer(r["ws"], "<u8") for r in asked]), return_inverse=True)
        totals = {}
        for name in ("ns", "ends") if kind == WORDS else ("ns",):
            n = np.concatenate([_of_small(r[name], size) for r, size in zip(asked, sizes, strict=True)])
            sums = np.zeros(at.max() + 1, np.int64)
            np.add.at(sums, at, n)
            totals[name] = np.split(sums[at], np.cumsum(sizes)[:-1])
        for i, r in enumerate(asked):
            row = {"pack": r["pack"], "part": key[0].as_py(), "kind": kind, "ends": b""}
            out.append(row | {name: _small(of[i]) for name, of in totals.items()})
    pa.default_memory_pool().release_unused()
    return _table(out, ANSWERS)


def _met(grams: np.ndarray, parts: int, answers: list[dict], name: str = "ns") -> np.ndarray:
    """The answered counts of the words or pairs that a pack asked for, in their order."""
    part, out = _part(grams, parts), np.zeros(len(grams), np.int64)
    found = {r["part"]: r[name] for r in answers}
    for at in _split(part):
        out[at] = _of_small(found[int(part[at[0]])], len(at))
    return out


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each value occurs, at every place of it."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


def _scored(parts: int, total: int, starts: int, own: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def scored(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        """The documents of a pack by the counts of the corpus."""
        read = _read(rows.column("ws"))
        answers = answers.select(["part", "kind", "ns", "ends"]).to_pylist()
        of_pairs, of_words = ([r for r in answers if r["kind"] == kind] for kind in (PAIRS, WORDS))
        words, wid = np.unique(read.w, return_inverse=True)
        pairs, pid = np.unique(_pair(_histories(read.w, read.first), read.w), return_inverse=True)
        pair = _met(pairs, parts, of_pairs)[pid]
        word = _met(words, parts, of_words)
        before = lambda c, at_start: np.where(read.first, at_start, np.r_[0, c[:-1]] if len(c) else c)
        history = before((word - _met(words, parts, of_words, "ends"))[wid], starts)
        once, backed = pair == 1, np.zeros(len(pair), bool)
        if own:
            value = np.log(pair) - np.log(history)
        else:
            word = word[wid]
            mine = _times(read.row * len(words) + wid)
            ends = np.zeros(len(read.sizes), np.int64)
            ends[read.row[read.last]] = wid[read.last]
            pair = pair - _times(read.row * len(pairs) + pid)
            history = history - before(mine - (ends[read.row] == wid), 1)
            backed = pair == 0
            others = np.maximum(total - read.sizes[read.row], 1)
            value = np.where(
                backed,
                math.log(BACKOFF) + np.log(np.maximum(word - mine, 1)) - np.log(others),
                np.log(np.maximum(pair, 1)) - np.log(np.maximum(history, 1)),
            )
        add = lambda c: np.bincount(read.row, c, len(read.sizes))
        known = (read.sizes > 0) & (own | (total > read.sizes))
        score = np.divide(add(value), read.sizes, out=np.zeros(len(known)), where=known)
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays(
            [
                rows.column("doc_id"),
                pa.array(read.sizes),
                pa.array(score, mask=~known),
                *(pa.array(add(c).astype(np.int64)) for c in (once, backed)),
            ],
            schema=SCORES,
        )

    return scored


def _n_words() -> Column:
    return F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long")


def scores(docs: DataFrame, own: bool = True) -> DataFrame:
    """(doc_id, n_words, score, seen_once, backed_off) of every row by the words of all rows, or without ``own`` of all others."""
    texts = _texts(docs)
    counted = texts.select(_n_words().alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count("*"))
    total, starts, rows = counted.first()
    parts = max(1, -(-(total + rows) // WORDS_PER_PART))
    packs = texts.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "doc_id", F.col("text").alias("ws"))
    asked = packs.groupBy("part").applyInArrow(_asks(parts), "part int, pack int, kind int, ws binary, ns binary, ends binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "pack int, part int, kind int, ns binary, ends binary")
    return packs.groupBy("part").cogroup(answers.groupBy("pack")).applyInArrow(
        _scored(parts, total, starts, own), "doc_id long, n_words long, score double, seen_once long, backed_off long"
    )


def _exploded(texts: DataFrame, order: int) -> DataFrame:
    """One row per word: hashes g1.. of the n-grams that it ends, and h2.. of their histories."""
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))
    padded = F.concat(F.array_repeat(F.lit(""), order - 1), words)

    def hashes(end: Column) -> Column:
        grams = [F.xxhash64(F.slice(F.col("words"), end - k + 1, F.lit(k))).alias(f"g{k}") for k in range(1, order + 1)]
        before = [F.xxhash64(F.slice(F.col("words"), end - k + 1, F.lit(k - 1))).alias(f"h{k}") for k in range(2, order + 1)]
        return F.struct(*grams, *before)

    filled = texts.select("key", padded.alias("words")).filter(F.size("words") >= order)
    return filled.select("key", F.inline(F.transform(F.sequence(F.lit(order), F.size("words")), hashes)))


def scores_against(docs: DataFrame, corpus: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, score, backed_off) of every row of ``docs`` by n-grams of up to ``order`` words of ``corpus``."""
    texts = _texts(docs)
    known = _exploded(_texts(corpus), order)
    names = [*(f"g{k}" for k in range(1, order + 1)), *(f"h{k}" for k in range(2, order + 1))]
    # Equal n-grams of a document are one row; a join deals out the rows of a frequent n-gram by document.
    rows = _exploded(texts.dropDuplicates(["key"]), order).groupBy("key", *names).agg(F.count("*").alias("n"))
    for name in names:
        rows = salted_join(rows, known.groupBy(name).agg(F.count("*").alias(f"n_{name}")), name, ["key"], "left")
    total = known.agg(F.count("*")).scalar()
    full = [F.log(F.col(f"n_g{k}") / F.col(f"n_h{k}")) + (order - k) * math.log(BACKOFF) for k in range(order, 1, -1)]
    word = F.when(total > 0, F.log(F.coalesce("n_g1", F.lit(1)) / total) + (order - 1) * math.log(BACKOFF))
    sums = rows.groupBy("key").agg(
        F.sum(F.col("n") * F.coalesce(*full, word)).alias("value"),
        F.sum(F.when(F.col(f"n_g{order}").isNull(), F.col("n")).otherwise(0)).alias("backed_off"),
    )
    return texts.select("key", "doc_id", _n_words().alias("n_words")).join(sums, "key", "left").select(
        "doc_id",
        "n_words",
        (F.col("value") / F.col("n_words")).alias("score"),
        F.coalesce("backed_off", F.lit(0)).alias("backed_off"),
    )
