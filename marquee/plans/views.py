"""Catalog, requests and page archive derived by Spark from the given tables.

Every line of every document is one title, so that whole texts are indexed, searched and learned
from. The other fields of a record are computed from the line and its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import stem, tokens
from marquee.schema import CATALOG
from marquee.sources.archive import listing_url


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_id(doc_id, line_no):
    """60 bits of the MD5 of document and line: no arithmetic that could overflow."""
    name = F.concat_ws(":", doc_id.cast("string"), line_no.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def lines(documents: DataFrame) -> DataFrame:
    """One row per line. The scan's own splits decide the tasks; to deal out a few unsplittable files,
    name the number of tasks in ``spark.marquee.input.partitions``."""
    parts = documents.sparkSession.conf.get("spark.marquee.input.partitions", None)
    dealt = documents.repartition(int(parts)) if parts else documents
    return dealt.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "title")
    ).withColumn("movie_id", title_id(F.col("doc_id"), F.col("line_no")))


def dump(documents: DataFrame) -> DataFrame:
    """Documents as crawled records, with ``movie_id``."""
    mark = F.col("doc_id") + F.col("line_no")
    size = F.length("title")
    untimed, unrated = mark % 5 == 0, mark % 11 == 0
    minus_one = F.lit(-1)
    record = {
        "status": F.when(untimed, F.lit("UNRELEASED")).otherwise(F.lit("RELEASED")),
        "hours": F.when(untimed, minus_one).otherwise(1 + mark % 3),
        "minutes": F.when(untimed, minus_one).otherwise(mark % 60),
        "title": F.col("title"),
        "date": F.when(mark % 13 == 0, F.lit("")).otherwise(
            F.concat(F.lit("day "), (mark % 30).cast("string"))
        ),
        "cover": F.concat(F.lit("/cover/"), F.col("movie_id").cast("string")),
        "director": F.concat(F.lit("Director "), (mark % 211).cast("string")),
        "genre": F.array(
            F.col("source"), F.when(size > 200, F.lit("long")).otherwise(F.lit("short"))
        ),
        "nationalities": F.array(F.concat(F.lit(" "), F.col("lang"))),
        "score_press": minus_one,
        "reviews_press": minus_one,
        "score_viewers": F.when(unrated, minus_one).otherwise((size % 50) / F.lit(10.0)),
        "reviews_viewers": F.when(unrated, minus_one).otherwise(size % 500),
        "pictures": F.array(F.concat(F.lit("/shot/"), F.col("movie_id").cast("string"))),
        "actors": F.array(F.col("lang"), F.lit(None), F.col("source")),
        "synopsis": F.concat(F.lit("Line "), F.col("line_no").cast("string")),
        "misc": F.concat(F.lit("<p>"), F.col("source"), F.lit("</p>")),
        "trailer": F.when(mark % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("http://t/"), F.col("movie_id").cast("string"), F.lit(".mp4"))
        ),
        "rank": (F.col("doc_id") * 7) % 1000000 + F.col("line_no"),
    }
    typed = [record[f.name].cast(f.dataType).alias(f.name) for f in CATALOG.fields]
    return lines(documents).select("movie_id", *typed)


def words_as_requests(benchmark: DataFrame, feature: str = "d") -> DataFrame:
    """One request per distinct word of the benchmark texts."""
    words = benchmark.select(F.explode(tokens(stem(F.col("text")))).alias("input")).distinct()
    return words.select(
        F.xxhash64("input").alias("query_id"), F.lit(feature).alias("feature"), "input"
    )


def lines_as_requests(texts: DataFrame, feature: str = "a") -> DataFrame:
    """One request per distinct line of a table's ``text``."""
    inputs = texts.select(F.explode(F.split("text", "\n")).alias("input")).distinct()
    return inputs.select(
        F.xxhash64("input").alias("query_id"), F.lit(feature).alias("feature"), "input"
    )


SITE = "http://films.example"


def _escaped(text):
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def _element(tag: str, attributes: str, *content):
    return F.concat(F.lit(f"<{tag} {attributes}>"), *content, F.lit(f"</{tag}>"))


def _film_path(doc_id, line_no, movie_id):
    raw = (doc_id * 7) % 1000000 + line_no
    return F.concat(F.lit("/film/"), raw.cast("string"), F.lit("_"), movie_id.cast("string"), F.lit(".html"))


def film_pages(documents: DataFrame) -> DataFrame:
    """One stored film page per line of text, with the parts some films lack left out."""
    mark = F.col("doc_id") + F.col("line_no")
    size = F.length("title")
    movie_id = F.col("movie_id").cast("string")
    empty = F.lit("")

    def unless(condition, content):
        return F.when(condition, empty).otherwise(content)

    def rating(missing, note, review):
        item = F.concat(_element("b", 'class="stareval-note"', note), review)
        return _element("div", 'class="rating-item"', unless(missing, item))

    def span(attributes, *content):
        return _element("span", attributes, *content)

    note = F.replace(((size % 50) / F.lit(10.0)).cast("string"), F.lit("."), F.lit(","))
    count = (size % 500).cast("string")
    html = F.concat(
        F.lit('<!DOCTYPE html><html><body><div class="card-movie-overview">'),
        F.lit('<img class="thumbnail-img" src="/cover/'), movie_id, F.lit('"><div class="meta-body">'),
        _element(
            "div", 'class="meta-body-item"',
            unless(mark % 13 == 0, span('class="date blue-link"', F.lit("day "), (mark % 30).cast("string"))),
            unless(mark % 5 == 0, F.concat(
                F.lit(" ("), (1 + mark % 3).cast("string"), F.lit("h "), (mark % 60).cast("string"), F.lit("min)"))),
        ),
        _element(
            "div", 'class="meta-body-item"',
            span('itemprop="director"', span('itemprop="name"', F.lit("Director "), (mark % 211).cast("string"))),
        ),
        _element(
            "div", 'class="meta-body-item"',
            span('class="blue-link"', F.col("lang")), span('class="blue-link"'),
            span('class="blue-link"', F.col("source")), span('class="blue-link more"', F.lit("more")),
        ),
        F.lit("</div></div>"),
        unless(mark % 29 == 0, _element("h1", 'class="titlebar-title titlebar-title-lg"', _escaped(F.col("title")))),
        span('itemprop="genre"', F.col("source")),
        span('itemprop="genre"', F.when(size > 200, "long").otherwise("short")),
        span('class="blue-link nationality"', F.lit(" "), F.col("lang")),
        F.lit('<div class="rating-holder">'),
        rating(mark % 7 == 0, note, span('class="stareval-review"', count)),
        rating(mark % 11 == 0, note, span('class="stareval-review"', span('itemprop="ratingCount"', count))),
        F.lit('</div><img class="shot-img" data-src="/shot/'), movie_id, F.lit('">'),
        unless(mark % 17 == 0, _element("p", 'class="synopsis-txt"', F.lit("Line "), F.col("line_no").cast("string"))),
        _element("div", 'class="ovw-synopsis-info"', F.lit("<br>"), F.col("source")),
        unless(
            mark % 3 == 0,
            F.concat(F.lit('<a class="trailer" href="/video/'), movie_id, F.lit('">film</a>')),
        ),
        F.lit("</body></html>"),
    )
    path = _film_path(F.col("doc_id"), F.col("line_no"), F.col("movie_id"))
    return lines(documents).select(F.concat(F.lit(SITE), path).alias("url"), html.alias("html"))


def trailer_pages(documents: DataFrame) -> DataFrame:
    """Pages that name the video files of a film, some of them in HD."""
    movie_id = F.col("movie_id").cast("string")
    hd = F.concat(F.lit('{"high":"\\/\\/media\\/x_hd_'), movie_id, F.lit('.mp4"}'))
    plain = F.concat(F.lit('{"low":"\\/\\/media\\/x_sd_'), movie_id, F.lit('.mp4"}'))
    odd = (F.col("doc_id") + F.col("line_no")) % 2 == 1
    html = F.concat(F.lit("<script>"), plain, F.when(odd, hd).otherwise(F.lit("")), F.lit("</script>"))
    url = F.concat(F.lit(SITE + "/video/"), movie_id)
    return lines(documents).select(url.alias("url"), html.alias("html"))


def listing_pages(documents: DataFrame) -> DataFrame:
    """One listing page per document, with a link to the film page of each of its lines."""
    line_count = F.size(F.split("text", "\n"))

    def anchor(line_no):
        path = _film_path(F.col("doc_id"), line_no, title_id(F.col("doc_id"), line_no))
        return F.concat(F.lit('<li><a class="meta-title-link" href="'), path, F.lit('">film</a></li>'))

    anchors = F.transform(F.sequence(F.lit(0), line_count - 1), anchor)
    html = F.concat(
        F.lit('<html><body><a class="nav" href="/home">home</a><ul>'),
        F.array_join(anchors, ""),
        F.lit("</ul></body></html>"),
    )
    return documents.select(listing_url(SITE, F.col("doc_id") + 1).alias("url"), html.alias("html"))


def archive(documents: DataFrame) -> DataFrame:
    return listing_pages(documents).unionByName(film_pages(documents)).unionByName(
        trailer_pages(documents)
    )
