"""Texts looked up at every position of titles, inside Arrow batches.

A position is followed character by character for as long as some wanted text begins so. What it reads is hashed on the
way, so a step is one multiplication and one look into a table of bits for all positions at once. Where a wanted text may
end, its characters are compared. Each task keeps only the best titles of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Characters of titles worked on at once.
CHUNK = 1 << 20
#: Characters of the best ranked titles of a chunk that are worked on first, and how much larger the following slices are.
FIRST_SLICE, GROWTH = 1 << 14, 4
#: Substrings of which a task holds the best titles, and lengths worked on between two looks at their number.
MOST_HELD, LENGTHS_AT_ONCE = 1 << 20, 4
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _bits_for(count: int) -> int:
    return max(10, int(count).bit_length() + 3)


def _slot(mixed: np.ndarray, bits: int) -> np.ndarray:
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class _Level:
    """What is wanted after ``length`` characters: which beginnings go on, and the texts that end."""

    begin_bits: int
    begins: np.ndarray
    end_bits: int
    starts: np.ndarray
    mixed: np.ndarray
    points: np.ndarray
    first: int

    def goes_on(self, mixed: np.ndarray) -> np.ndarray:
        return self.begins[_slot(mixed, self.begin_bits)]

    def ends(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of texts that end here, and the places of those texts."""
        if not len(self.mixed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = _slot(mixed, self.end_bits)
        at, end = self.starts[slot], self.starts[slot + 1]
        open_, found, places = np.flatnonzero(at < end), [], []
        while len(open_):
            equal = self.mixed[at[open_]] == mixed[open_]
            found.append(open_[equal])
            places.append(at[open_[equal]])
            open_ = open_[~equal]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return (np.concatenate(found), np.concatenate(places)) if found else (open_, open_)


@dataclass(frozen=True)
class Wanted:
    """Distinct texts by length, each with a number."""

    base: np.uint64
    levels: list[_Level]
    size: int

    @classmethod
    def of(cls, texts: list[str]) -> Wanted:
        for base in _BASES:
            built = cls._built([t for t in set(texts) if t], np.uint64(base))
            if built is not None:
                return built
        raise ValueError("different texts have equal hashes")

    @classmethod
    def _built(cls, texts: list[str], base: np.uint64) -> Wanted | None:
        texts = sorted(texts, key=len, reverse=True)
        sizes = np.array([len(t) for t in texts], np.int64)
        points, begin = _code_points(texts), np.cumsum(sizes) - sizes
        hashes, levels, first = np.zeros(len(texts), np.uint64), [], 0
        for length in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -length, "right"))  # the longest come first
            hashes = hashes[:n] * base + points[begin[:n] + length - 1] + np.uint64(1)
            mixed = hashes * _MIX
            distinct = np.unique(mixed)
            begin_bits = _bits_for(len(distinct))
            begins = np.zeros(1 << begin_bits, bool)
            begins[_slot(distinct, begin_bits)] = True
            here = np.flatnonzero(sizes[:n] == length)
            here = here[np.argsort(mixed[here])]
            ends = mixed[here]
            if (ends[1:] == ends[:-1]).any():
                return None
            end_bits = _bits_for(len(here))
            starts = np.searchsorted(_slot(ends, end_bits), np.arange((1 << end_bits) + 1)).astype(np.int32)
            matrix = points[begin[here][:, None] + np.arange(length)]
            levels.append(_Level(begin_bits, begins, end_bits, starts, ends, matrix, first))
            first += len(here)
        return cls(base, levels, first)

    def texts(self, numbers: np.ndarray) -> list[str]:
        firsts = np.array([level.first for level in self.levels], np.int64)
        at = np.searchsorted(firsts, numbers, "right") - 1
        out = np.empty(len(numbers), object)
        for number in np.unique(at):
            level, rows = self.levels[number], np.flatnonzero(at == number)
            whole, size = level.points[numbers[rows] - level.first].tobytes().decode("utf-32-le", "surrogatepass"), number + 1
            out[rows] = [whole[i * size : (i + 1) * size] for i in range(len(rows))]
        return out.tolist()


@dataclass
class _Titles:
    """Titles as arrays. ``kind`` is 0 for a rank of null, 2 for one that is not a number, else 1."""

    movie_id: np.ndarray
    unnamed: np.ndarray
    kind: np.ndarray
    rank: np.ndarray

    def take(self, at) -> _Titles:
        return _Titles(self.movie_id[at], self.unnamed[at], self.kind[at], self.rank[at])

    def order(self, *first: np.ndarray) -> np.ndarray:
        """By the arrays of ``first``, the best rank, and ``movie_id``, nulls last and first."""
        best = ~self.rank if self.rank.dtype == np.int64 else -self.rank
        return np.lexsort((self.movie_id, ~self.unnamed, best, -self.kind, *reversed(first)))

    def new(self) -> np.ndarray:
        """Which of the titles, in their order, are not the one before."""
        out = np.ones(len(self.rank), bool)
        if len(out):
            out[1:] = False
            for values in (self.movie_id, self.unnamed, self.kind, self.rank):
                out[1:] |= values[1:] != values[:-1]
        return out

    def worth(self) -> np.ndarray:
        """Never more for a worse rank."""
        return np.where(self.kind == 1, self.rank.astype(np.float64), np.where(self.kind == 0, -np.inf, np.inf))

    @classmethod
    def joined(cls, parts: list[_Titles]) -> _Titles:
        return cls(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("movie_id", "unnamed", "kind", "rank")))

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Titles:
        ids, rank = batch.column("movie_id"), batch.column("rank")
        values = rank.fill_null(0).to_numpy(zero_copy_only=False)
        values = values.astype(np.float64 if values.dtype.kind == "f" else np.int64)
        unlike = np.isnan(values) if values.dtype == np.float64 else np.zeros(len(values), bool)
        kind = np.where(rank.is_null().to_numpy(zero_copy_only=False), 0, np.where(unlike, 2, 1)).astype(np.int8)
        return cls(
            ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            ids.is_null().to_numpy(zero_copy_only=False),
            kind,
            np.where(unlike, 0, values),
        )


def _places(group: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal ``group``, from 0."""
    at = np.arange(len(group))
    begins = np.ones(len(group), bool)
    begins[1:] = group[1:] != group[:-1]
    return at - np.maximum.accumulate(np.where(begins, at, 0))


class _Best:
    """The ``top_k`` best titles found so far of every wanted text."""

    def __init__(self, size: int, top_k: int):
        self.top_k = top_k
        self.number, self.titles = np.zeros(0, np.int32), None
        self.waiting: list[tuple[np.ndarray, _Titles]] = []
        #: What a title must be worth to come in: that of the last place, where all places are taken.
        self.floor = np.full(size, -np.inf)

    def add(self, number: np.ndarray, titles: _Titles) -> None:
        self.waiting.append((number, titles))
        if sum(len(n) for n, _ in self.waiting) > max(200_000, 2 * len(self.number)):
            self.merge()

    def merge(self) -> None:
        held = [] if self.titles is None else [(self.number, self.titles)]
        parts = held + self.waiting
        self.waiting = []
        if not parts:
            return
        number, titles = np.concatenate([n for n, _ in parts]), _Titles.joined([t for _, t in parts])
        order = titles.order(number)
        number, titles = number[order], titles.take(order)
        new = titles.new()
        new[1:] |= number[1:] != number[:-1]
        number, titles = number[new], titles.take(new)
        place = _places(number)
        kept = place < self.top_k
        self.number, self.titles, place = number[kept], titles.take(kept), place[kept]
        last = place == self.top_k - 1
        self.floor[self.number[last]] = self.titles.worth()[last]


def _search(wanted: Wanted, points, room, row, worth, best: _Best, full: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number, row) of wanted texts at the positions given; texts that are ``full`` or whose floor is higher are left out."""
    at, hashes = np.arange(len(room)), np.zeros(len(room), np.uint64)
    for length, level in enumerate(wanted.levels, 1):
        if length > 1:
            kept = room[at] >= length
            at, hashes = at[kept], hashes[kept]
        hashes = hashes * wanted.base + points[at + length - 1] + np.uint64(1)
        mixed = hashes * _MIX
        kept = level.goes_on(mixed)
        at, hashes, mixed = at[kept], hashes[kept], mixed[kept]
        if not len(at):
            return
        hit, place = level.ends(mixed)
        number, where = place + level.first, at[hit]
        open_ = (full[number] < best.top_k) & (worth[row[where]] >= best.floor[number])
        place, number, where = place[open_], number[open_], where[open_]
        same = np.ones(len(where), bool)
        for i in range(length):
            same &= points[where + i] == level.points[place, i]
        yield number[same], row[where[same]]


def occurrences(wanted: Wanted, points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number, position) of wanted texts that begin at the positions ``at``, which end well before ``points`` do."""
    hashes = np.zeros(len(at), np.uint64)
    for length, level in enumerate(wanted.levels, 1):
        hashes = hashes * wanted.base + points[at + length - 1] + np.uint64(1)
        mixed = hashes * _MIX
        kept = level.goes_on(mixed)
        at, hashes, mixed = at[kept], hashes[kept], mixed[kept]
        if not len(at):
            return
        hit, place = level.ends(mixed)
        where, same = at[hit], np.ones(len(hit), bool)
        for i in range(length):
            same &= points[where + i] == level.points[place, i]
        yield place[same] + level.first, where[same]


def _chunks(frames: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[list[str], _Titles]]:
    """Texts and titles of about ``CHUNK`` characters; a longer text is cut into pieces that overlap."""
    texts, rows, size = [], [], 0
    for batch in frames:
        titles, begin, taken = _Titles.of(batch) if batch.num_rows else None, 0, []
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py()
            for start in range(0, max(1, len(text) - overlap), CHUNK):
                piece = text if len(text) <= CHUNK else text[start : start + CHUNK + overlap]
                texts.append(piece)
                taken.append(i)
                size += len(piece)
                if size >= CHUNK:
                    yield texts, _Titles.joined([*rows, titles.take(taken)])
                    texts, rows, size, taken = [], [], 0, []
        if taken:
            rows.append(titles.take(taken))
    if texts:
        yield texts, _Titles.joined(rows)


def _search_chunk(wanted: Wanted, texts: list[str], titles: _Titles, best: _Best) -> None:
    order = titles.order()
    texts, titles = [texts[i] for i in order], titles.take(order)
    title = np.cumsum(titles.new()) - 1  # pieces of one title count once
    first_row = np.flatnonzero(titles.new())
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    points, worth = _code_points(texts), titles.worth()
    full = np.zeros(wanted.size, np.int32)
    begin, width = 0, FIRST_SLICE
    while begin < len(texts):
        offset = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, offset + width, "right")))
        row = np.repeat(np.arange(begin, end), sizes[begin:end])
        room = ends[row] - offset - np.arange(len(row))
        found = [(n, title[r]) for n, r in _search(wanted, points[offset:], room, row, worth, best, full)]
        if found:
            number, which = (np.concatenate(c) for c in zip(*found))
            pair = np.unique(number.astype(np.int64) * len(texts) + which)  # the best title first
            number, which = pair // len(texts), pair % len(texts)
            kept = _places(number) < best.top_k
            number, which = number[kept], which[kept]
            full += np.bincount(number, minlength=wanted.size).astype(np.int32)
            best.add(number.astype(np.int32), titles.take(first_row[which]))
        begin, width = end, width * GROWTH


def _postings(ngrams: pa.Array, titles: _Titles, schema: pa.Schema) -> pa.RecordBatch:
    rank = np.where(titles.kind == 2, np.nan, titles.rank) if titles.rank.dtype == np.float64 else titles.rank
    return pa.RecordBatch.from_arrays(
        [
            ngrams,
            pa.array(titles.movie_id, mask=titles.unnamed).cast(schema.field("movie_id").type),
            pa.array(rank, mask=titles.kind == 0, from_pandas=False).cast(schema.field("rank").type, safe=False),
        ],
        names=["ngram", "movie_id", "rank"],
    )


def _listed(best: _Best, texts_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``(ngram, movie_id, rank)`` of all that was found; ``texts_of`` tells the texts of numbers."""
    best.merge()
    step = 100_000
    for begin in range(0, len(best.number), step):
        part = slice(begin, begin + step)
        yield _postings(pa.array(texts_of(best.number[part]), pa.string()), best.titles.take(part), schema)


def best_titles(frames: Iterator[pa.RecordBatch], wanted: Wanted, top_k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``(ngram, movie_id, rank)``: of every wanted text the ``top_k`` best titles of this task that contain it."""
    best = _Best(wanted.size, top_k)
    for texts, titles in _chunks(frames, max(0, len(wanted.levels) - 1)):
        _search_chunk(wanted, texts, titles, best)
    yield from _listed(best, wanted.texts, schema)


# --- every substring of some lengths --------------------------------------------------------


def _substrings(points: np.ndarray, room: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the ``lengths`` (ascending): the positions with room for it, and numbers that are equal where the
    characters are. Two overlapping stretches of a power of two stand for a length between two powers."""
    numbers, stretch = np.unique(points, return_inverse=True)[1].astype(np.int64), 1
    for length in lengths:
        while stretch * 2 <= length:
            at = np.flatnonzero(room >= stretch * 2)
            doubled = np.zeros(len(points), np.int64)
            doubled[at] = np.unique(numbers[at] * len(points) + numbers[at + stretch], return_inverse=True)[1]
            numbers, stretch = doubled, stretch * 2
        at = np.flatnonzero(room >= length)
        if len(at):
            yield length, at, numbers[at] * len(points) + numbers[at + length - stretch]


def _grams_of_chunk(texts: list[str], titles: _Titles, lengths: list[int]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each length: its different substrings, and every pair of one (its place in the list) and a title (its row) that
    contains it, once. Titles are in order, the best first."""
    new = titles.new()
    title, first_row = np.cumsum(new) - 1, np.flatnonzero(new)  # pieces of one title count once
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    points, room = _code_points(texts), np.cumsum(sizes)[row] - np.arange(len(row))
    for length, at, gram in _substrings(points, room, lengths):
        _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
        pair = np.unique(gram * len(texts) + title[row[at]])
        whole = points[at[first][:, None] + np.arange(length)].tobytes().decode("utf-32-le", "surrogatepass")
        listed = [whole[i : i + length] for i in range(0, len(whole), length)]
        yield listed, pair // len(texts), first_row[pair % len(texts)]


def _ordered_chunks(frames: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[list[str], _Titles]]:
    for texts, titles in _chunks(frames, overlap):
        order = titles.order()
        yield [texts[i] for i in order], titles.take(order)


def substrings_of_titles(frames: Iterator[pa.RecordBatch], lengths: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``(ngram, movie_id, rank)``: every substring of these lengths of every title once; a title is one row of at most
    ``CHUNK`` characters."""
    step = 100_000
    for texts, titles in _ordered_chunks(frames, 0):
        for listed, gram, which in _grams_of_chunk(texts, titles, lengths):
            ngrams = pa.array(listed, pa.string())
            for begin in range(0, len(gram), step):
                part = slice(begin, begin + step)
                yield _postings(ngrams.take(pa.array(gram[part])), titles.take(which[part]), schema)


def _count_chunk(texts: list[str], titles: _Titles, lengths: list[int], names: dict[str, int], best: _Best) -> None:
    worth = titles.worth()
    for listed, gram, which in _grams_of_chunk(texts, titles, lengths):
        kept = _places(gram) < best.top_k
        gram, which = gram[kept], which[kept]
        number = np.fromiter((names.setdefault(text, len(names)) for text in listed), np.int32, len(listed))[gram]
        best.floor = np.concatenate([best.floor, np.full(len(names) - len(best.floor), -np.inf)])
        open_ = worth[which] >= best.floor[number]
        best.add(number[open_], titles.take(which[open_]))


def best_of_substrings(frames: Iterator[pa.RecordBatch], lengths: list[int], top_k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``(ngram, movie_id, rank)``: of every substring of these lengths the ``top_k`` best titles of this task.

    What is held is bounded: from ``MOST_HELD`` substrings (or their characters in eights) on it is sent on, and the
    task begins anew.
    """

    def sent() -> Iterator[pa.RecordBatch]:
        texts = list(names)
        return _listed(best, lambda numbers: [texts[i] for i in numbers], schema)

    names, best = {}, _Best(0, top_k)
    for texts, titles in _ordered_chunks(frames, lengths[-1] - 1):
        for some in (lengths[i : i + LENGTHS_AT_ONCE] for i in range(0, len(lengths), LENGTHS_AT_ONCE)):
            _count_chunk(texts, titles, some, names, best)
            if len(names) * max(8, some[-1]) >= MOST_HELD * 8:
                yield from sent()
                names, best = {}, _Best(0, top_k)
    yield from sent()
