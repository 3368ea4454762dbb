"""Repeated passages by seed and extend (operator 7).

Seeds: a window of 13 words has nine runs of five words; the one with the smallest hash is the window's anchor. It
depends on the window's words alone, so equal windows have equal anchors, and neighbouring windows mostly share
one. Anchors that occur in one document only are dropped at once: each task first reduces its anchors to smallest
and largest doc_id, then these are summed up.

Extension: around an anchor that several documents share, the match is extended to both sides as far as a
13-word window still has it as its anchor, and each such window is compared with those of the other documents, by
its anchor and a second 64-bit hash of all 13 words. What counts is the smallest doc_id of equal windows, so a
passage in n documents costs n rows, not pairs of documents. Windows that match one after the other make up a
maximal repeat.

Documents are not cut, and no anchor is left out. A passage in very many documents is settled for most of them where
they are read: of equal windows in one batch, only the smallest document's goes on to be compared with other batches.

Defined results: null and empty texts have no words; texts under 13 words keep all. Rows with the same doc_id are
one document for the rule (none is smaller than another). A row without doc_id is no source and keeps all its
words. Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import batches

LENGTH = 13
GRAM = 5

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _WordHashes(dict):
    """Hash by word; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = value
        return value


_WORDS = _WordHashes()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _runs(x: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hash of every ``length`` neighbouring values."""
    n = len(x) - length + 1
    out = x[:n].copy()
    for j in range(1, length):
        out *= factor
        out += x[j : n + j]
    out ^= out >> np.uint64(31)
    out *= _MIX[2]
    out ^= out >> np.uint64(29)
    return out


def window_anchors(x: np.ndarray) -> np.ndarray:
    """The anchor of every window, from word hashes (empty for fewer than LENGTH words)."""
    if len(x) < LENGTH:
        return np.zeros(0, np.uint64)
    low, width = _runs(x, GRAM, _MIX[0]), 1
    span = LENGTH - GRAM + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: width - span], low[span - width :])
    return low


def window_hashes(x: np.ndarray) -> np.ndarray:
    return _runs(x, LENGTH, _MIX[1])


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that differ in id or text have different keys; equal rows share one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), F.col("doc_id").cast("long"), text.cast("binary").alias("text")
    )


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(a): anchors in more than one document."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            found, owner = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc is not None:
                    found.append(np.unique(window_anchors(_hashes(text.as_py().split()))))
                    owner.append(np.full(len(found[-1]), doc, np.int64))
            if not found:
                continue
            a, d = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(a)] - 1 if len(a) else first
            yield pa.RecordBatch.from_arrays(
                [_longs(a[first]), pa.array(d[first]), pa.array(d[last]), pa.array(last - first + 1)], ["a", "lo", "hi", "n"]
            )

    seen = rows.select("doc_id", "text").mapInArrow(work, "a long, lo long, hi long")
    sums = seen.groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return sums.filter("lo < hi").select("a")


def anchors_of(rows: DataFrame) -> DataFrame:
    """(row, a): the distinct anchors of every row."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            found = [np.unique(window_anchors(_hashes(t.as_py().split()))) for t in batch.column(1)]
            sizes = [len(f) for f in found]
            if sum(sizes):
                owner = np.repeat(batch.column(0).to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(owner), _longs(np.concatenate(found))], ["row", "a"])

    return rows.filter("doc_id is not null").select("row", "text").mapInArrow(work, "row long, a long")


def windows(listed: DataFrame) -> DataFrame:
    """(row, doc_id, done, a, start, hs): runs of windows with a shared anchor.

    ``listed`` has row, doc_id, text and the row's shared anchors (``anchors``). Of equal windows in one batch only
    those of the smallest document are sent on; for the others the answer is known. Such a row has ``done`` set,
    the starts of these windows in ``hs``, and its own key for an anchor.
    """

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            rows, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found: list[tuple] = []
            for i, (text, shared) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x = _hashes(text.as_py().split())
                anchors = window_anchors(x)
                at = np.flatnonzero(np.isin(anchors, shared.values.to_numpy().view(np.uint64)))
                found.append((np.full(len(at), i), at, anchors[at], window_hashes(x)[at]))
            who, at, a, h = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((docs[who], h, a))
            heads = np.flatnonzero(np.r_[True, (a[order][1:] != a[order][:-1]) | (h[order][1:] != h[order][:-1])][: len(order)])
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(docs[who[order[heads]]], np.diff(np.r_[heads, len(order)]))
            open_ = docs[who] == least
            yield _run_rows(rows, docs, who[open_], at[open_], a[open_], h[open_], False)
            done = ~open_
            yield _run_rows(rows, docs, who[done], at[done], None, at[done], True)

    return listed.select("row", "doc_id", "text", "anchors").mapInArrow(
        work, "row long, doc_id long, done boolean, a long, start int, hs array<long>"
    )


def _run_rows(rows: np.ndarray, docs: np.ndarray, who: np.ndarray, at: np.ndarray, a: np.ndarray | None, h: np.ndarray, done: bool) -> pa.RecordBatch:
    """One row for each run of neighbouring windows with one anchor; for what is done, one for each document."""
    new = who[1:] != who[:-1]
    if a is not None:
        new = new | (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(np.r_[True, new][: len(who)])
    offsets = pa.array(np.r_[heads, len(who)].astype(np.int32))
    key = rows[who[heads]]
    columns = [
        pa.array(key), pa.array(docs[who[heads]]), pa.array(np.full(len(heads), done)),
        _longs(a[heads]) if a is not None else pa.array(key), pa.array(at[heads].astype(np.int32)),
        pa.ListArray.from_arrays(offsets, _longs(h)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "done", "a", "start", "hs"])


def repeated_starts(rows: DataFrame) -> DataFrame:
    """(row, starts): where a window starts that a document with a smaller doc_id has too."""
    own = anchors_of(rows).join(shared_anchors(rows), "a")
    lists = own.groupBy("row").agg(F.collect_set("a").alias("anchors"))
    runs = windows(rows.join(lists.hint("shuffle_hash"), "row")).repartition("a")
    each = runs.select("row", "doc_id", "done", "a", "start", F.posexplode("hs").alias("k", "h"))
    least = F.min("doc_id").over(Window.partitionBy("a", "h"))
    at = F.when(F.col("done"), F.col("h").cast("int")).otherwise(F.col("start") + F.col("k"))
    found = each.withColumn("least", least).filter("done or least < doc_id").select("row", at.alias("at"))
    return found.groupBy("row").agg(F.collect_set("at").alias("starts"))


def maximal(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first word, word after the last) of the maximal repeats that windows at ``starts`` cover."""
    s = np.sort(starts)
    cuts = np.flatnonzero(s[1:] > s[:-1] + LENGTH) + 1
    return [(int(p[0]), int(p[-1]) + LENGTH) for p in np.split(s, cuts) if len(p)]


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, repeats, kept) of every row: maximal repeats as word positions, and the kept text."""
    rows = _keyed(docs)
    marked = rows.join(repeated_starts(rows).hint("shuffle_hash"), "row", "left")

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], [], [], []]
                for doc, text, starts in zip(*batch.slice(at, 256).columns, strict=True):
                    words, n = text.as_py().split(), 0
                    total = len(words)
                    spans = maximal(np.array(starts.as_py() or [], np.int64))
                    for first, past in reversed(spans):
                        n += past - first
                        del words[first:past]
                    values = doc.as_py(), total, n, [{"first": a, "past": b} for a, b in spans], b" ".join(words).decode()
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
                types = [pa.int64(), pa.int64(), pa.int64(), span, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_words", "n_removed", "repeats", "kept"]
                )

    return marked.select("doc_id", "text", "starts").mapInArrow(
        work, "doc_id long, n_words long, n_removed long, repeats array<struct<first:int,past:int>>, kept string"
    )
