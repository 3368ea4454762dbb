"""From dump records to catalog rows, details and display text (projections only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import fields

#: Fields of a detail answer, in the order of its JSON text.
DETAIL_FIELDS = [
    "actors", "cover", "date", "director", "genre", "hours", "minutes", "misc", "nationalities",
    "pictures", "reviews_viewers", "score_viewers", "status", "synopsis", "title", "trailer",
]


def derive(dump: DataFrame) -> DataFrame:
    """Dump records (with ``movie_id``) as catalog rows: rank, cover path and cleaned lists."""
    return dump.withColumns(
        {
            "rank": fields.popularity(
                F.col("rank"), F.col("trailer"), F.col("reviews_viewers"), F.col("score_viewers")
            ),
            "local_cover": fields.local_cover(F.col("rank")),
            "date": fields.known_date(F.col("date")),
            "nationalities": fields.without_first_character(F.col("nationalities")),
            "actors": fields.without_nulls(F.col("actors")),
        }
    )


def detail(catalog: DataFrame) -> DataFrame:
    """The sixteen public fields; ``cover`` is the local one."""
    rest = [name for name in DETAIL_FIELDS if name != "cover"]
    return catalog.select("movie_id", F.col("local_cover").alias("cover"), *rest)


def display(catalog: DataFrame) -> DataFrame:
    """The texts shown for a title."""
    c = F.col
    return catalog.select(
        "movie_id",
        "title",
        fields.score_text(c("score_viewers")).alias("score"),
        fields.review_count(c("reviews_viewers")).alias("reviews"),
        fields.duration_genre_date(c("hours"), c("minutes"), c("genre"), c("date")).alias(
            "duration_genre_date"
        ),
        fields.director_date(c("director"), c("date")).alias("director_date"),
    )
