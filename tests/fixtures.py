"""Small hand-made inputs."""

from marquee.schema import CATALOG


def record(**fields):
    """A dump record with plain defaults."""
    base = {
        "status": "RELEASED", "hours": 1.0, "minutes": 30.0, "title": "A Title", "date": "day 1",
        "cover": "/c.jpg", "director": "D. One", "genre": ["X"], "nationalities": [" fr"],
        "score_press": -1.0, "reviews_press": -1.0, "score_viewers": 0.0, "reviews_viewers": 0.0,
        "pictures": [], "actors": ["A"], "synopsis": "", "misc": "<p/>", "trailer": "http:t.mp4",
        "rank": 1.0,
    }
    unknown = set(fields) - set(base)
    assert not unknown, unknown
    base.update(fields)
    return base


def dump(spark, *records):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("movie_id", T.LongType()), *CATALOG.fields])
    names = [f.name for f in CATALOG.fields]
    rows = [(i, *[r[n] for n in names]) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, schema)


def titled(spark, titles):
    """A catalog ``(movie_id, title, rank, ...)`` from ``{title: rank}`` or pairs."""
    pairs = list(titles.items()) if isinstance(titles, dict) else titles
    rows = [(i, t, r, f"/{i}.jpg", f"D{i}", f"day {i}") for i, (t, r) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "movie_id long, title string, rank int, local_cover string, director string, date string"
    )


def asked(spark, *inputs):
    return spark.createDataFrame(list(enumerate(inputs)), "query_id long, input string")
