"""Benchmark passages in training documents, found in an FM-index of each shard.

The windows of the benchmark (ten words; a shorter item is one window) are numbered and their words make the alphabet.
Each task goes through its documents in shards of at most ``SHARD`` words. Words outside the alphabet end a run, and runs
shorter than the shortest window cannot hold one; an FM-index is built over the other runs. All windows are searched
backwards by wavelet-tree ranks, their occurrences located by sampled suffix positions, and the spans merged.

Documents stay where the scan reads them: nothing is shuffled. The windows are the stated query set; they are handed out
in blocks of at most ``BLOCK_BYTES``, one pass over the documents per block, in the same stage. A long text is worked on in
pieces and shards that overlap by the longest window less a word.

Defined results: null text has no words; an item without id or words takes no part, an id that repeats is one item
with the windows of all its rows; repeated documents get equal rows. Without items nothing is hit. Other columns are
not read, except those the caller puts into ``row``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import batches
from marquee.llm.fm_index import FmIndex

WINDOW = 10
#: Words of one shard, and bytes of text that are split into words at once.
SHARD, PIECE = 2**20, 2**22
#: Benchmark windows handed out at once.
BLOCK_BYTES = 64 * 1024 * 1024
#: Occurrences located at once.
LOCATED = 2**20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of UTF-8: A-Z to lower case, other ASCII than letters and digits to space.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def windows(benchmark: DataFrame, item_id: Column, text: Column, window: int = WINDOW) -> DataFrame:
    """(item, words): the distinct windows of every item."""
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    words = F.filter(F.split(lowered, _APART), lambda w: w != "")
    items = benchmark.select(item_id.cast("string").alias("item"), words.alias("words"))
    items = items.filter("item is not null and size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda at: F.slice("words", at, window))
    return items.select("item", F.explode(cut).alias("words")).distinct()


@dataclass(frozen=True)
class Phrases:
    """A block of windows: words by number, windows as rows of numbers, and the items of each window."""

    numbers: dict[bytes, int]
    words: np.ndarray
    lengths: np.ndarray
    first_item: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Phrases:
        holders: dict[tuple, list[str]] = {}
        for item, words in zip(rows.column("item").to_pylist(), rows.column("words").to_pylist()):
            holders.setdefault(tuple(words), []).append(item)
        numbers: dict[bytes, int] = {}
        lengths = np.array([len(words) for words in holders], np.int64)
        table = np.zeros((len(holders), int(lengths.max(initial=0))), np.int64)
        for i, words in enumerate(holders):
            for j, word in enumerate(words):
                table[i, j] = numbers.setdefault(word.encode(), len(numbers) + 1)
        first = np.cumsum([0, *map(len, holders.values())])
        items = np.array([item for found in holders.values() for item in found], dtype=object)
        return cls(numbers, table, lengths, first, items)


def _numbered(text: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, 0 for words outside the alphabet."""
    found, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # to the end of a word
            end = next((e for e in range(end, len(text)) if text[e] < 128 and _LOWER[text[e]] == 32), len(text))
        words = text[at:end].translate(_LOWER).split()
        found.append(np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _shards(texts: list[bytes | None], phrases: Phrases, n_words: np.ndarray):
    """Lists of (document, first word, numbers of words), each a shard; sets the documents' numbers of words."""
    shard, size = [], 0
    overlap = phrases.words.shape[1] - 1
    for document, text in enumerate(texts):
        numbers = _numbered(text or b"", phrases.numbers)
        n_words[document] = len(numbers)
        for first in range(0, max(len(numbers) - overlap, 1), SHARD):
            part = numbers[first : first + SHARD + overlap]
            if size and size + len(part) > SHARD:
                yield shard
                shard, size = [], 0
            shard.append((document, first, part))
            size += len(part)
    if shard:
        yield shard


def _occurrences(shard: list, phrases: Phrases):
    """(document, first word, window) of all windows in a shard, in arrays of bounded size."""
    end = np.zeros(1, np.int64)
    symbols = np.concatenate([a for _, _, part in shard for a in (part, end)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], symbols != 0, [0]])))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= phrases.lengths.min()
    starts, lengths = starts[long], stops[long] - starts[long] + 1  # with the end that follows
    if not len(starts):
        return
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    index = FmIndex(symbols[at], len(phrases.numbers) + 1)
    low, high = index.search(phrases.words, phrases.lengths)
    hits = np.flatnonzero(high > low)
    first = np.cumsum([0, *[len(part) + 1 for _, _, part in shard]])[:-1]
    document, word = (np.array([part[i] for part in shard]) for i in (0, 1))
    counts = high[hits] - low[hits]
    upto = np.cumsum(counts)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, LOCATED):
        number = np.arange(begin, min(begin + LOCATED, upto[-1]))
        hit = np.searchsorted(upto, number, side="right")
        rows = low[hits[hit]] + number - (upto[hit] - counts[hit])
        position = at[index.locate(rows)]
        part = np.searchsorted(first, position, side="right") - 1
        yield document[part], word[part] + position - first[part], hits[hit]


def merged(document: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans by document and start; those that touch or overlap made one."""
    order = np.lexsort((end, start, document))
    document, start, end = document[order], start[order], end[order]
    stride = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(document * stride + end)
    new = np.concatenate([[True], document[1:] * stride + start[1:] > reach[:-1]]) if len(start) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1 if len(start) else np.zeros(0, np.int64)
    return document[new], start[new], reach[last] - document[new] * stride


def _found(texts: list[bytes | None], phrases: Phrases, n_words: np.ndarray):
    """Merged spans (document, start, end), and (document, item) pairs, each once."""
    spans = [np.zeros((3, 0), np.int64)]
    pairs = [np.zeros(0, np.int64)]
    windows_ = len(phrases.lengths)
    for shard in _shards(texts, phrases, n_words):
        for document, word, window in _occurrences(shard, phrases):
            spans.append(np.stack(merged(document, word, word + phrases.lengths[window])))
            pairs.append(np.unique(document * windows_ + window))
    document, window = np.divmod(np.unique(np.concatenate(pairs)), windows_)
    counts = phrases.first_item[window + 1] - phrases.first_item[window]
    at = np.repeat(phrases.first_item[window] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return merged(*np.concatenate(spans, axis=1)), (np.repeat(document, counts), phrases.items[at])


def _scan(frames, phrases: Phrases):
    """Rows with what this block of windows adds to ``spans`` and ``items``."""
    for batch in batches(frames):
        n_words = np.zeros(batch.num_rows, np.int64)
        (document, start, end), (holder, item) = _found(batch.column("text").to_pylist(), phrases, n_words)
        spans, items = (batch.column(name).to_pylist() for name in ("spans", "items"))
        if any(spans):
            old = np.array([(d, *span) for d, found in enumerate(spans) for span in found], np.int64).reshape(-1, 3)
            new = np.stack([document, start, end], axis=1)
            document, start, end = merged(*np.concatenate([old, new]).T)
        bounds = np.searchsorted(document, np.arange(batch.num_rows + 1))
        both = np.stack([start, end], axis=1)
        found: dict[int, set] = {}
        for d, i in zip(holder.tolist(), item):
            found.setdefault(d, set(items[d])).add(i)
        for d, all_items in found.items():
            items[d] = sorted(all_items)
        added = [
            pa.array(n_words),
            pa.array([both[a:b].tolist() for a, b in zip(bounds, bounds[1:])], pa.list_(pa.list_(pa.int64()))),
            pa.array(items, pa.list_(pa.string())),
        ]
        kept = [name for name in batch.schema.names if name not in ("n_words", "spans", "items")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), *added], names=[*kept, "n_words", "spans", "items"]
        )


def scanned(docs: DataFrame, text: Column, row: Column, found: DataFrame) -> DataFrame:
    """(row, n_words, spans, items) of every document, for the ``windows`` in ``found``.

    ``spans`` are arrays [first word, word after the last] to be removed, in order and apart; ``items`` the sorted ids
    of the items with occurring windows. ``row`` is carried along.
    """
    size = found.agg(F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length("item") + 64)).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    rows = docs.select(
        row.alias("row"),
        text.cast("string").cast("binary").alias("text"),
        F.lit(None).cast("long").alias("n_words"),
        F.array().cast("array<array<bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = T.StructType([*rows.schema.fields[:2], *_ADDED])
    for number in range(blocks):
        part = F.pmod(F.xxhash64("item", F.array_join("words", " ")), F.lit(blocks)) == number
        phrases = Phrases.of(found.filter(part).toArrow())
        rows = rows.mapInArrow(lambda frames, phrases=phrases: _scan(frames, phrases), schema)
    if not blocks:
        words = F.filter(F.split(F.translate(text, _UPPER, _UPPER.lower()), _APART), lambda w: w != "")
        rows = docs.select(row.alias("row"), F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n_words"), *(
            F.array().cast(f.dataType).alias(f.name) for f in _ADDED[1:]
        ))
    return rows.select("row", "n_words", "spans", "items")


def n_hit() -> Column:
    """The number of words in ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + F.get(s, 1) - F.get(s, 0))
