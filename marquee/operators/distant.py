"""Search with up to two edits, by parts that must occur unchanged.

A text of n characters has about (55 n)^2 / 2 variants of two edits: too many to look each up. But of three parts of a
text, two edits leave one as it is. So the places where a part occurs in a title are found by an equi-join of hashed
substrings, and there what stands before and after is compared with the rest of the text, with at most two edits in all.

Only letters that an edit can bring in (space and a-z) may differ: every other character of a title stands as three of a
kind, so that none can be edited into a text. A text that has such a character itself, or is too short to be cut, is
searched for by its variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.constants import EDIT_ALPHABET, SEARCH_RESULTS
from marquee.functions.text import stem
from marquee.operators import probe, search
from marquee.operators.index import PIECE_STARTS, stemmed_titles

EDITS = 2
#: Shorter texts have parts that occur nearly everywhere.
SHORTEST = 8
_FOREIGN = "\x01"
#: Positions, or places where parts occur, worked on at once.
POSITIONS = 1 << 18


def divisible(text: Column) -> Column:
    """Whether a normalised text is searched for by its parts."""
    return (F.length(text) >= SHORTEST) & (F.translate(text, EDIT_ALPHABET, "") == "")


def parts_of_texts(texts: DataFrame) -> DataFrame:
    """``(text, part, left, right)``: each third of a text with what is before and after it."""
    third = F.floor(F.length("text") / 3).cast("int")
    cuts = [(F.lit(0), third), (third, third), (third * 2, F.length("text") - third * 2)]
    text = F.col("text")
    parts = [
        F.struct(
            F.substring(text, start + 1, size).alias("part"),
            F.substring(text, F.lit(1), start).alias("left"),
            F.substring(text, start + size + 1, F.length(text)).alias("right"),
        )
        for start, size in cuts
    ]
    return texts.select("text", F.inline(F.array(*parts)))


def _surroundings(titles: DataFrame, reach: int) -> DataFrame:
    """``(movie_id, rank, before, rest)`` for every position of a title: up to ``reach`` characters on either side."""
    text = F.regexp_replace("text", f"[^{EDIT_ALPHABET}]", _FOREIGN * (EDITS + 1))
    edge = F.lit(_FOREIGN * reach)
    padded = titles.select("movie_id", "rank", F.concat(edge, text).alias("text"), F.length(text).alias("size"))
    offsets = F.sequence(F.lit(0), F.floor((F.col("size") - 1) / PIECE_STARTS).cast("int"))
    cut = F.transform(
        offsets,
        lambda w: F.struct(
            F.least(F.lit(PIECE_STARTS), F.col("size") - w * PIECE_STARTS).alias("starts"),
            F.substring(F.col("text"), w * PIECE_STARTS + 1, F.lit(PIECE_STARTS + 2 * reach)).alias("piece"),
        ),
    )
    pieces = padded.select("movie_id", "rank", F.inline(cut))
    at = pieces.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("starts"))))
    before = F.substring("piece", F.col("at"), F.lit(reach))
    rest = F.substring("piece", F.col("at") + reach, F.lit(reach))
    return at.select("movie_id", "rank", before.alias("before"), rest.alias("rest"))


def _fewest_edits(wanted: str, taken) -> Column:
    """The least number of edits between a text and one of its size or up to two more or less; null beyond two."""
    tries = []
    for more in range(-EDITS, EDITS + 1):
        size = F.greatest(F.length(wanted) + more, F.lit(0))
        tries.append(F.levenshtein(F.col(wanted), taken(size), EDITS))
    return F.array_min(F.filter(F.array(*tries), lambda n: n >= 0))


def _joined(texts: DataFrame, catalog: DataFrame, size: search.BatchSize) -> DataFrame:
    """``(text, movie_id, rank, visit)`` of all places where a part occurs, by a join."""
    reach = size.longest + EDITS
    parts = parts_of_texts(texts)
    lengths = sorted({piece for n in size.lengths for piece in (n // 3, n - 2 * (n // 3))})
    around = _surroundings(stemmed_titles(catalog), reach)
    begun = around.withColumn(
        "begun", F.explode(F.array_distinct(F.array(*[F.substring("rest", F.lit(1), F.lit(n)) for n in lengths])))
    )
    met = begun.join(parts, F.col("begun") == F.col("part"))
    before = _fewest_edits("left", lambda n: F.substring(F.col("before"), F.lit(reach + 1) - n, n))
    after = _fewest_edits("right", lambda n: F.substring(F.col("rest"), F.length("part") + 1, n))
    return met.withColumn("visit", before).filter("visit is not null").withColumn("visit", F.col("visit") + after)


@dataclass(frozen=True)
class _Parts:
    """The parts of texts, with the rows of ``parts_of_texts`` that each begins, and both sides, outward, as code points."""

    wanted: probe.Wanted
    begin: np.ndarray
    rows: np.ndarray
    text: pa.Array
    size: np.ndarray
    sides: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, parts: pa.Table) -> _Parts:
        text, part, left, right = (parts.column(name).to_pylist() for name in ("text", "part", "left", "right"))
        wanted = probe.Wanted.of(part)
        numbers = {p: i for i, p in enumerate(wanted.texts(np.arange(wanted.size)))}
        number = np.array([numbers[p] for p in part], np.int64)
        begin = np.searchsorted(np.sort(number), np.arange(wanted.size + 1))
        sides = [_matrix([t[::-1] for t in left]), _matrix(right)]
        return cls(wanted, begin, np.argsort(number, kind="stable"), pa.array(text), np.array([len(p) for p in part]), sides)


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one row each, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    width = int(sizes.max(initial=0))
    padded = "".join(t.ljust(width, _FOREIGN) for t in texts)
    return np.frombuffer(padded.encode("utf-32-le"), np.uint32).reshape(len(texts), width), sizes


def _edits(side: np.ndarray, points: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The fewest edits between each row of ``side`` and what stands from ``at`` on in direction ``step``; above
    ``EDITS``, some number above it. Only cells so near the diagonal count."""
    many, width = np.int8(EDITS + 1), 2 * EDITS + 1
    row = [np.full(len(at), k - EDITS if k >= EDITS else many, np.int8) for k in range(width)]
    for i in range(1, side.shape[1] + 1):
        following = []
        for k in range(width):
            j = i + k - EDITS  # characters of the title
            cell = np.full(len(at), many, np.int8)
            if j >= 1:
                cell = np.minimum(cell, row[k] + (points[at + (j - 1) * step] != side[:, i - 1]))
            if k + 1 < width:
                cell = np.minimum(cell, row[k + 1] + np.int8(1))
            if k and j >= 1:
                cell = np.minimum(cell, following[k - 1] + np.int8(1))
            following.append(cell)
        row = following
    return np.minimum.reduce(row)


def _side_edits(known: _Parts, which: int, points: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    matrix, sizes = known.sides[which]
    out = np.zeros(len(row), np.int8)
    for size in np.unique(sizes[row]):
        some = np.flatnonzero(sizes[row] == size)
        out[some] = _edits(matrix[row[some], :size], points, at[some], 1 if which else -1)
    return out


def _matches(known: _Parts, points: np.ndarray, positions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``known``, position, edits) of all places with at most ``EDITS``."""
    for begin in range(0, len(positions), POSITIONS):
        for number, where in probe.occurrences(known.wanted, points, positions[begin : begin + POSITIONS]):
            n = known.begin[number + 1] - known.begin[number]
            first = np.repeat(known.begin[number] - (np.cumsum(n) - n), n)
            row, at = known.rows[first + np.arange(len(first))], np.repeat(where, n)
            for part in range(0, len(row), POSITIONS):
                r, a = row[part : part + POSITIONS], at[part : part + POSITIONS]
                before = _side_edits(known, 0, points, r, a - 1)
                kept = before <= EDITS
                r, a, before = r[kept], a[kept], before[kept]
                edits = before + _side_edits(known, 1, points, r, a + known.size[r])
                kept = edits <= EDITS
                yield r[kept], a[kept], edits[kept]


def _probed(texts: DataFrame, catalog: DataFrame, longest: int) -> DataFrame:
    """``(text, movie_id, rank, visit)`` of all places where a part occurs and its text does with at most ``EDITS``.

    The texts are few enough to broadcast. Titles are followed in arrays: there is no row for a position.
    """
    reach = longest + EDITS
    known = catalog.sparkSession.sparkContext.broadcast(_Parts.of(parts_of_texts(texts).toArrow()))
    foreign = F.regexp_replace("text", f"[^{EDIT_ALPHABET}]", _FOREIGN * (EDITS + 1))
    titles = stemmed_titles(catalog).withColumn("text", foreign)
    fields = titles.select("movie_id", "rank").schema.fields
    text, visit = T.StructField("text", T.StringType()), T.StructField("visit", T.LongType())
    schema = T.StructType([text, *(T.StructField(f.name, f.dataType) for f in fields), visit])

    def search_titles(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            edge = _FOREIGN * reach
            listed = batch.column("text").to_pylist()
            sizes = np.array([len(t) + reach for t in listed], np.int64)
            joined = edge + "".join(t + edge for t in listed)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            positions = np.flatnonzero(points != ord(_FOREIGN))
            ends = reach + np.cumsum(sizes)
            for row, at, edits in _matches(known.value, points, positions):
                title = pa.array(np.searchsorted(ends, at, "right"))
                yield pa.RecordBatch.from_arrays(
                    [
                        known.value.text.take(pa.array(row)), batch.column("movie_id").take(title), batch.column("rank").take(title),
                        pa.array(edits.astype(np.int64)),
                    ],
                    names=schema.names,
                )

    return titles.mapInArrow(search_titles, schema)


def hits(texts: DataFrame, catalog: DataFrame, size: search.BatchSize, max_res: int) -> DataFrame:
    """``(text, movie_id, rank, visit)`` of ``divisible`` texts; ``visit`` is the number of edits.

    Of each text the ``max_res`` best titles are kept, and as many that contain the text as it is.
    """
    if size.texts * 3 * (size.longest * 8 + 200) <= search.BROADCAST_BYTES:
        found = _probed(texts, catalog, size.longest)
    else:
        found = _joined(texts, catalog, size)
    best = Window.partitionBy("text", "exact").orderBy(F.desc("rank"), "movie_id")
    kept = (
        found.filter(F.col("visit") <= EDITS)
        .select("text", "movie_id", "rank", "visit", (F.col("visit") == 0).alias("exact"))
        .withColumn("place", F.dense_rank().over(best))
        .filter(F.col("place") <= max_res)
    )
    return kept.groupBy("text", "movie_id", "rank").agg(F.min("visit").cast("long").alias("visit"))


def search_two_edits(
    requests: DataFrame, catalog: DataFrame, max_res: int = SEARCH_RESULTS, gate: bool = True
) -> DataFrame:
    """As ``search.search`` with ``max_dist=2`` and ``eviction="best"``."""
    by_parts = divisible(stem(F.col("input")))
    others, size = search.candidates(requests.filter(~by_parts), catalog, max_res, EDITS)
    texts = search.request_texts(requests.filter(by_parts))
    divided = search.batch_size(texts.withColumn("dist", F.lit(0)))
    found = others
    if divided.texts:
        found = hits(texts, catalog, divided, max_res).unionByName(others)
    fits = search.BatchSize(
        size.texts + divided.texts, max(size.longest, divided.longest), size.lengths + divided.lengths, 0.0
    )
    return search.discovered(requests, found, fits, catalog, max_res, "best", gate)
