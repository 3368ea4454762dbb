"""Substring postings: which titles contain a given n-gram, best ranked first.

A full index of a title has about L*L/2 entries, so three narrower forms carry the searches:
only wanted lengths, only wanted n-grams, and only the ``top_k`` best titles of each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marquee.functions.text import stem, substring_lengths, substrings
from marquee.operators import probe

#: Start positions handled by one row; a very long title is worked on in many such pieces.
PIECE_STARTS = 128
#: Characters of a title whose different n-grams are found in one row.
LONG_TITLE = 1 << 16


def stemmed_titles(catalog: DataFrame) -> DataFrame:
    stemmed = catalog.select("movie_id", "rank", stem(F.col("title")).alias("text"))
    return stemmed.filter(F.col("text") != "")


def title_starts(titles: DataFrame, longest: int) -> DataFrame:
    """One row per start position: ``rest`` has the next ``longest`` characters.

    Titles are first cut into pieces that overlap by ``longest`` characters. Positions in a text
    are counted from its left end, so short pieces keep the work linear in the title's length.
    """
    offsets = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_STARTS).cast("int"))
    cut = F.transform(
        offsets,
        lambda w: F.substring(F.col("text"), w * PIECE_STARTS + 1, F.lit(PIECE_STARTS + longest - 1)),
    )
    pieces = titles.select("movie_id", "rank", F.explode(cut).alias("piece"))
    starts = F.sequence(F.lit(1), F.least(F.lit(PIECE_STARTS), F.length("piece")))
    return pieces.withColumn("start", F.explode(starts)).select(
        "movie_id", "rank", F.substring("piece", F.col("start"), F.lit(longest)).alias("rest")
    )


def _beginnings(rest: str, lengths: list[int]) -> Column:
    return F.explode(F.array(*[F.substring(rest, F.lit(1), F.lit(n)) for n in lengths]))


def build_postings(
    catalog: DataFrame, lengths: list[int] | None = None, top_k: int | None = None
) -> DataFrame:
    """Postings ``(ngram, movie_id, rank)``, each pair once; optionally cut to ``top_k`` per n-gram.

    Without ``lengths`` every substring of every title is produced.
    """
    titles = stemmed_titles(catalog)
    if lengths is None:
        # A title has far more substrings than characters, so titles are spread before any is made.
        titles = titles.repartition(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sized = titles.withColumn("size", F.explode(substring_lengths(F.col("text"))))
        ngram = F.explode(substrings(F.col("text"), F.col("size"))).alias("ngram")
        found = sized.select(ngram, "movie_id", "rank")
        return found if top_k is None else keep_best(found, top_k)

    wanted = sorted({int(n) for n in lengths})
    return _distinct_postings(titles, wanted) if top_k is None else _best_postings(titles, wanted, top_k)


def _distinct_postings(titles: DataFrame, wanted: list[int]) -> DataFrame:
    """Titles move, not their n-grams: a row that has all of a title finds the different ones by itself.

    Only those of a very long title, or of one that has several texts, are shuffled.
    """
    titles = titles.withColumn("text", F.make_valid_utf8("text"))
    ends = titles.groupBy("movie_id", "rank").agg(F.min("text").alias("text"), F.max("text").alias("last"))
    in_one_row = (F.col("text") == F.col("last")) & (F.length("text") <= LONG_TITLE)
    schema, arrow = _posting_schema(titles)

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return probe.substrings_of_titles(frames, wanted, arrow)

    rows = ends.filter(in_one_row).select("movie_id", "rank", "text").mapInArrow(search, schema)
    other = ends.filter(~in_one_row).select(F.col("movie_id").alias("_id"), F.col("rank").alias("_rank"))
    same = F.col("movie_id").eqNullSafe(F.col("_id")) & F.col("rank").eqNullSafe(F.col("_rank"))
    starts = title_starts(titles.join(other, same, "left_semi"), wanted[-1])
    cut = starts.withColumn("ngram", _beginnings("rest", wanted)).filter(F.length("ngram").isin(wanted))
    return rows.unionByName(cut.select("ngram", "movie_id", "rank").distinct())


def _best_postings(titles: DataFrame, wanted: list[int], top_k: int) -> DataFrame:
    """Each task sends on the best titles it has of an n-gram, and neither sorts nor shuffles the others."""
    titles = titles.withColumn("text", F.make_valid_utf8("text"))
    schema, arrow = _posting_schema(titles)

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return probe.best_of_substrings(frames, wanted, top_k, arrow)

    return keep_best(titles.mapInArrow(search, schema), top_k)


def _posting_schema(titles: DataFrame) -> tuple[T.StructType, pa.Schema]:
    fields = [T.StructField("ngram", T.StringType()), *titles.select("movie_id", "rank").schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    return schema, to_arrow_schema(schema)


def keep_best(postings: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` best titles of each n-gram.

    A dense rank allows the same pair to come from several places of one title; Spark applies
    the limit before the shuffle, so a frequent n-gram sends only a few rows per task.
    """
    order = Window.partitionBy("ngram").orderBy(F.desc("rank"), "movie_id")
    return (
        postings.withColumn("_place", F.dense_rank().over(order))
        .filter(F.col("_place") <= top_k)
        .drop("_place")
        .dropDuplicates(["ngram", "movie_id"])
    )


def ranked_postings(postings: DataFrame) -> DataFrame:
    """Postings with ``pos``, the place of a title in its n-gram's list."""
    order = Window.partitionBy("ngram").orderBy(F.desc("rank"), "movie_id")
    return postings.withColumn("pos", F.row_number().over(order))


def probe_postings(
    catalog: DataFrame, ngrams: DataFrame, lengths: list[int], top_k: int
) -> DataFrame:
    """The ``top_k`` best postings of a set of n-grams known to be small enough to broadcast.

    No substring is shuffled: each task looks the n-grams up at the positions of its titles, and sends on only the
    ``top_k`` best titles of an n-gram, however often it occurs. None is longer than the last of ``lengths``.
    """
    longest = max(lengths)
    asked = ngrams.filter(F.length("ngram") <= longest).select("ngram").toArrow()
    known = catalog.sparkSession.sparkContext.broadcast(probe.Wanted.of(asked.column(0).to_pylist()))
    titles = stemmed_titles(catalog).withColumn("text", F.make_valid_utf8("text"))
    schema, arrow = _posting_schema(titles)

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return probe.best_titles(frames, known.value, top_k, arrow)

    return keep_best(titles.mapInArrow(search, schema), top_k)


def save_index(postings: DataFrame, path: str, groups: int = 64) -> None:
    """Store postings by n-gram length, so that a lookup reads only the lengths it needs.

    ``groups`` is the number of tasks, and files, of each length.
    """
    stored = postings.withColumn("length", F.length("ngram"))
    stored.repartition("length", F.pmod(F.xxhash64("ngram"), F.lit(groups))).write.mode(
        "overwrite"
    ).partitionBy("length").parquet(path)
