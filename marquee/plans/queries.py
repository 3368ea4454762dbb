"""The named queries: ``(spark, folder of tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.constants import LISTING_LINK_CLASS
from marquee.functions.fields import anchor_links, first_number
from marquee.functions.page_table import values_of
from marquee.functions.text import content_words, stem, tokens
from marquee.operators import catalog, crawl, distant, evaluate, extract, predict, requests, search, sketches, stats, suffixes
from marquee.operators.index import build_postings, ranked_postings, save_index, stemmed_titles
from marquee.operators.variants import variants
from marquee.plans import views
from marquee.plans.views import SITE, table
from marquee.schema import ARCHIVE, REQUESTS, TELEMETRY
from marquee.session import scratch_path
from marquee.sources import catalog_io, values
from marquee.sources import telemetry
from marquee.sources.archive import fetch, seed_urls, store_archive
from marquee.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _documents(spark, d):
    return table(spark, d, "documents")


def _dump(spark, d):
    return views.dump(_documents(spark, d))


def _catalog(spark, d):
    return catalog.derive(_dump(spark, d))


def _words(spark, d, feature="d"):
    return views.words_as_requests(table(spark, d, "benchmark"), feature)


#: Substrings of these lengths are indexed by the named index queries. A full index of a title grows with the
#: square of its length; titles are never cut.
INDEXED_LENGTHS = [1, 2, 3, 5]


def _parts(spark, d):
    """Part names as a small catalog whose titles are indexed in full."""
    parts = table(spark, d, "part")
    return parts.select(
        F.col("p_partkey").alias("movie_id"),
        F.col("p_name").alias("title"),
        F.col("p_size").alias("rank"),
    )


def _flat(df: DataFrame, *lists: str) -> DataFrame:
    return df.withColumns({name: F.array_join(name, "|", "-") for name in lists})


# --- catalog ------------------------------------------------------------------------------


@query
def catalog_derive(spark, d):
    derived = _catalog(spark, d).select(
        "movie_id", "title", "rank", "local_cover", "date", "nationalities", "actors", "genre"
    )
    return _flat(derived, "nationalities", "actors", "genre")


@query
def catalog_detail(spark, d):
    return _flat(catalog.detail(_catalog(spark, d)), "actors", "genre", "nationalities", "pictures")


@query
def catalog_display(spark, d):
    return catalog.display(_catalog(spark, d))


@query
def catalog_round_trip(spark, d):
    """The dump written as JSON lines and read back."""
    path = scratch_path(spark, "dump")
    catalog_io.write_dump(_dump(spark, d), path)
    records, _ = catalog_io.read_dump(spark, path)
    return _flat(records.drop("movie_id"), "genre", "nationalities", "pictures", "actors")


# --- text ---------------------------------------------------------------------------------


@query
def stem_titles(spark, d):
    titles = _dump(spark, d)
    return titles.select("movie_id", stem(F.col("title")).alias("text"))


@query
def token_counts(spark, d):
    text = stem(F.col("title"))
    titles = _dump(spark, d)
    return titles.select(
        "movie_id", F.size(tokens(text)).alias("words"), F.size(content_words(text)).alias("content")
    )


@query
def content_word_counts(spark, d):
    titles = _dump(spark, d)
    words = titles.select(F.explode(content_words(stem(F.col("title")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("count"))


@query
def ngrams_distinct(spark, d):
    """The distinct substrings of each title, of the indexed lengths, with the number of its titles."""
    postings = build_postings(_catalog(spark, d), INDEXED_LENGTHS)
    return postings.groupBy("ngram").agg(F.count("*").alias("titles"), F.max("rank").alias("best"))


@query
def ngrams_ranked(spark, d):
    """The six best titles of every substring of the indexed lengths."""
    return ranked_postings(build_postings(_catalog(spark, d), INDEXED_LENGTHS, top_k=6))


@query
def ngrams_of_parts(spark, d):
    """Every substring of every part name, of any length, with all its part names in order."""
    return ranked_postings(build_postings(_parts(spark, d)))


# --- search -------------------------------------------------------------------------------

_ANSWER = ["input", "pos", "movie_id", "rank", "title", "local_cover", "director", "date"]


@query
def search_exact(spark, d):
    return search.search(_words(spark, d), _catalog(spark, d), max_dist=0).select(*_ANSWER)


@query
def search_detail(spark, d):
    found = search.search_detail(_words(spark, d, "f"), _catalog(spark, d)).drop("query_id")
    return _flat(found, "actors", "genre", "nationalities", "pictures")


@query
def fuzzy_variants(spark, d):
    return variants(search.request_texts(_words(spark, d)), 1)


@query
def search_fuzzy(spark, d):
    return search.search(_words(spark, d), _catalog(spark, d), gate=False).select(*_ANSWER)


@query
def search_discover(spark, d):
    return search.search(_words(spark, d), _catalog(spark, d)).select(*_ANSWER)


@query
def search_fuzzy_reference(spark, d):
    found = search.search(
        _words(spark, d), _catalog(spark, d), eviction="reference", gate=False
    )
    return found.select(*_ANSWER)


@query
def discover_reference(spark, d):
    """The gate first, then the queue that gives up its best entry: the answer a client really got."""
    found = search.search(_words(spark, d), _catalog(spark, d), eviction="reference")
    return found.select(*_ANSWER)


@query
def search_two_edits(spark, d):
    """Words of nine letters and more, with up to two edits."""
    words = _words(spark, d).filter(F.col("input").rlike("^[a-z]{9,}$"))
    return distant.search_two_edits(words, _catalog(spark, d)).select(*_ANSWER)


@query
def search_saved_index(spark, d):
    """Exact and fuzzy search of part names in a stored full index."""
    path = scratch_path(spark, "index")
    parts = _parts(spark, d).withColumns(
        {name: F.lit("") for name in ("local_cover", "director", "date")}
    )
    save_index(build_postings(parts, top_k=6), path)
    asked = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("input"))
    asked = asked.distinct().withColumn("query_id", F.xxhash64("input"))
    found = search.search(asked, parts, postings=spark.read.parquet(path))
    return found.select("input", "pos", "movie_id", "rank", "title")


# --- prediction ---------------------------------------------------------------------------


@query
def train_weights(spark, d):
    weights = predict.train_weights(_catalog(spark, d))
    return weights.withColumn("weight", F.col("weight").cast("float"))


@query
def train_probs(spark, d):
    model = predict.train(_catalog(spark, d))
    return model.select("label_kind", "word", "class", F.col("p").cast("float").alias("p"))


def _predictions(spark, d, kind):
    asked = views.lines_as_requests(table(spark, d, "conversations"))
    found = predict.predict(asked, predict.train(_catalog(spark, d)))
    return found.filter(F.col("label_kind") == kind).select(
        "input", "pos", "class", F.col("p").cast("float").alias("p"), "pct"
    )


@query
def predict_genre(spark, d):
    return _predictions(spark, d, "genre")


@query
def predict_nationality(spark, d):
    return _predictions(spark, d, "nationality")


@query
def accuracy(spark, d):
    dump = _dump(spark, d)
    found = evaluate.evaluate(dump, predict.train(catalog.derive(dump)))
    return found.withColumn("rate", F.round("rate", 9))


# --- statistics ---------------------------------------------------------------------------


@query
def value_counts(spark, d):
    genres = _dump(spark, d).select(F.explode("genre").alias("value"))
    return stats.value_counts(genres, "value")


@query
def status_counts(spark, d):
    return stats.value_counts(_dump(spark, d), "status")


@query
def top_n_others(spark, d):
    sources = table(spark, d, "documents")
    return stats.top_and_others(stats.value_counts(sources, "source"), 10)


@query
def top_titles(spark, d):
    return stats.top_and_others(stats.value_counts(_dump(spark, d), "title"), 10)


@query
def ngram_length_hist(spark, d):
    """Distinct substrings of every length of every title, whole."""
    return suffixes.ngram_lengths(stemmed_titles(_catalog(spark, d)))


@query
def catalog_counts(spark, d):
    """How many titles, and how many distinct substrings of any length."""
    titles = _catalog(spark, d)
    return stats.catalog_counts(titles, suffixes.ngram_lengths(stemmed_titles(titles)))


@query
def partition_rows(spark, d):
    """The total of the rows counted per partition."""
    counted = stats.partition_rows(table(spark, d, "orders"), 16, "o_orderkey")
    return counted.agg(F.sum("rows").alias("rows"), F.count("*").alias("partitions"))


@query
def observed_rows(spark, d):
    """Titles written in 16 partitions: rows counted on the way before and after the move, and rows found in the files."""
    path = scratch_path(spark, "spread")
    before, after = stats.write_spread(_dump(spark, d).select("movie_id", "title"), 16, "movie_id", path)
    written = spark.read.parquet(path).agg(F.count("*").alias("rows_written"))
    return written.select(
        F.lit(before).cast("long").alias("rows_before"),
        F.lit(sum(after)).cast("long").alias("rows_after"),
        "rows_written",
        F.lit(len(after)).alias("partitions"),
    )


def _title_words(spark, d):
    return _dump(spark, d).select("movie_id", F.explode(tokens(stem(F.col("title")))).alias("word"))


def _stored_sketches(spark, words):
    """The words' sketches in eight parts; half of the parts are written first, then the others and one of them again."""
    path = scratch_path(spark, "sketches")
    parts = sketches.sketch_parts(words, "word", F.pmod("movie_id", F.lit(8)).cast("int"))
    sketches.store_parts(parts.filter("part < 4"), path)
    sketches.store_parts(parts.filter("part >= 3"), path)
    return sketches.stored_parts(spark, path)


@query
def sketched_distinct(spark, d):
    """How many different words titles have, whether that is in the bounds of the stored sketches, and whether these
    together tell what one sketch of all words does."""
    words = _title_words(spark, d)
    stored = _stored_sketches(spark, words)
    parts = sketches.distinct_estimate(stored)
    whole = sketches.distinct_estimate(sketches.sketch_parts(words, "word", F.lit(0)))
    exact = words.agg(F.count_distinct("word").alias("exact")).scalar()
    return parts.select(
        exact.alias("exact"),
        stored.agg(F.sum("rows")).scalar().alias("words"),
        exact.between(F.col("low"), F.col("high")).alias("in_bounds"),
        (F.col("estimate") == whole.select("estimate").scalar()).alias("as_whole"),
    )


@query
def heavy_words(spark, d):
    """Words that make up more than one in 500 of all words of titles, found by the stored sketches and counted exactly."""
    words = _title_words(spark, d)
    return sketches.heavy_values(words, "word", _stored_sketches(spark, words), 1 / 500)


@query
def values_round_trip(spark, d):
    """Customer segments written one per line, read and counted."""
    path = scratch_path(spark, "values")
    values.write_values(table(spark, d, "customer"), F.col("c_mktsegment"), path)
    return stats.value_counts(values.read_values(spark, path), "value")


# --- crawl and extraction -----------------------------------------------------------------


@query
def seed_pages(spark, d):
    """Listing pages 1..N looked up in the archive, with the number of films each lists."""
    documents = _documents(spark, d)
    seeds = seed_urls(spark, SITE, documents.count())
    fetched = fetch(seeds, views.listing_pages(documents))
    films = F.size(anchor_links(F.col("html"), LISTING_LINK_CLASS))
    return fetched.select("page_no", "url", F.coalesce(F.when(F.col("html").isNotNull(), films), F.lit(-1)).alias("films"))


@query
def page_links(spark, d):
    return crawl.page_links(table(spark, d, "pages"), css_class=None)


@query
def page_ranks(spark, d):
    return table(spark, d, "pages").select("page_id", first_number(F.col("url")).alias("rank"))


@query
def page_titles(spark, d):
    """Title, language and number of links of each raw page, by patterns alone."""
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, '<html lang="(..)"', 1).alias("lang"),
        F.size(anchor_links(html)).alias("links"),
    )


def _extracted(spark, d):
    documents = _documents(spark, d)
    return extract.extract_pages(views.film_pages(documents), views.archive(documents), SITE)


@query
def page_values(spark, d):
    """Every value of every film page, by the table function in SQL."""
    return values_of(views.film_pages(_documents(spark, d)))


@query
def page_records(spark, d):
    found = extract.records(_extracted(spark, d))
    return _flat(found, "genre", "nationalities", "pictures", "actors")


@query
def page_failures(spark, d):
    return extract.failures(_extracted(spark, d))


@query
def page_status(spark, d):
    return extract.records(_extracted(spark, d)).groupBy("status").agg(F.count("*").alias("count"))


@query
def trailer_url(spark, d):
    return extract.records(_extracted(spark, d)).select("url", "trailer")


@query
def crawl_records(spark, d):
    """Listing pages to film pages to records, every document being one listing page."""
    documents = _documents(spark, d)
    seeds = documents.select((F.col("doc_id") + 1).alias("page_no"))
    seeds = seeds.select("page_no", views.listing_url(SITE, F.col("page_no")).alias("url"))
    found = extract.records(crawl.crawl(seeds, store_archive(views.archive(documents)), SITE))
    return found.select("url", "status", "title", "trailer", "rank")


@query
def crawl_events(spark, d):
    """All events of a crawl: the store is reset, listing and film events are appended, and read back."""
    path, at = scratch_path(spark, "events"), F.lit("2024-01-01").cast("timestamp")
    documents = _documents(spark, d)
    telemetry.append_events(spark.createDataFrame([(None, "LEFT OVER")], TELEMETRY), path)
    telemetry.reset_events(spark, path)
    telemetry.append_events(crawl.listing_events(views.listing_pages(documents), at), path)
    telemetry.append_events(extract.events(_extracted(spark, d), at), path)
    return telemetry.read_events(spark, path).groupBy("tag").agg(F.count("*").alias("count"))


@query
def merged_dump(spark, d):
    """The dump merged into one in order of ids, and read back: do its files follow one another?"""
    path = scratch_path(spark, "merged")
    catalog_io.write_dump(_dump(spark, d), path, merged=True)
    records, broken = catalog_io.read_dump(spark, path)
    left = broken.select(F.lit(None).cast("long").alias("movie_id"), F.lit("").alias("file"))
    rows = records.select("movie_id", F.input_file_name().alias("file")).union(left)
    files = rows.groupBy("file").agg(
        F.count("movie_id").alias("records"),
        F.sum(F.col("movie_id") % 1000).alias("ids"),
        F.count_if(F.col("movie_id").isNull()).alias("broken"),
        F.min("movie_id").alias("first"),
        F.max("movie_id").alias("last"),
    )
    before = F.lag("last").over(Window.orderBy("file"))  # one row a file
    return files.withColumn("before", before).agg(
        F.sum("records").alias("records"),
        F.sum("ids").alias("ids"),
        F.count_if(F.col("first") < F.col("before")).alias("out_of_order"),
        F.sum("broken").alias("broken"),
    )


@query
def dump_quarantine(spark, d):
    """A dump with broken lines and records without title: what is left out, by kind."""
    path = scratch_path(spark, "broken")
    rows = _dump(spark, d).withColumn("title", F.when(F.col("movie_id") % 7 != 0, F.col("title")))
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "movie_id"]))
    broken = F.when(F.col("movie_id") % 5 == 0, F.concat(F.lit("broken "), line)).otherwise(line)
    rows.select(broken.alias("value")).write.text(path)
    records, left_out = catalog_io.read_dump(spark, path)
    kind = F.when(F.startswith("line", F.lit("broken ")), "broken").otherwise("untitled")
    return left_out.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines")).union(
        records.agg(F.count("*")).select(F.lit("kept"), "count(1)")
    )


# --- requests and streams -----------------------------------------------------------------


def _mixed_requests(spark, d):
    """Words to discover and to look up, lines to analyse and lines with an unknown feature."""
    words, spoken = table(spark, d, "benchmark"), table(spark, d, "conversations")
    parts = [
        views.words_as_requests(words, "d"),
        views.words_as_requests(words, "f"),
        views.lines_as_requests(spoken, "a"),
        views.lines_as_requests(spoken, "x"),
    ]
    mixed = parts[0]
    for part in parts[1:]:
        mixed = mixed.unionByName(part)
    return mixed.withColumn("query_id", F.xxhash64("feature", "input"))


def _library(spark, d):
    titles = _catalog(spark, d)
    return requests.Library(titles, predict.train(titles))


_LIBRARIES: dict[tuple[str, str], str] = {}


def _stored_library(spark, d):
    """Titles, their index and model, built once in a session and read back."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LIBRARIES:
        path = scratch_path(spark, "library")
        requests.build_library(_catalog(spark, d), path)
        _LIBRARIES[key] = path
    return requests.load_library(spark, _LIBRARIES[key])


@query
def search_from_index(spark, d):
    """Discover requests answered from the stored index of all titles."""
    library = _stored_library(spark, d)
    return search.search(_words(spark, d), library.catalog, postings=library.postings).select(*_ANSWER)


@query
def index_add(spark, d):
    """Exact search in a library that was built from most titles, and got the others, and all of them again."""
    titles, path = _catalog(spark, d), scratch_path(spark, "grown")
    requests.build_library(titles.filter("movie_id % 10 <> 0"), path)
    requests.build_library(titles.filter("movie_id % 10 = 0"), path)
    requests.build_library(titles, path)
    library = requests.load_library(spark, path)
    return search.search(_words(spark, d), library.catalog, max_dist=0, postings=library.postings).select(*_ANSWER)


@query
def search_stored_titles(spark, d):
    """Discover requests answered from stored titles."""
    return search.search(_words(spark, d), _stored_library(spark, d).catalog).select(*_ANSWER)


@query
def predict_stored_model(spark, d):
    """Genres predicted from a stored model."""
    asked = views.lines_as_requests(table(spark, d, "conversations"))
    found = predict.predict(asked, _stored_library(spark, d).model)
    return found.filter("label_kind = 'genre'").select(
        "input", "pos", "class", F.col("p").cast("float").alias("p"), "pct"
    )


@query
def request_dispatch(spark, d):
    answered = requests.answer(_mixed_requests(spark, d), _library(spark, d))
    return answered.select("feature", "input", "response")


@query
def discover_lines(spark, d):
    """Answers to discover requests, read back from their text form."""
    asked = _words(spark, d)
    lines = requests.parse_discover(requests.discover_responses(asked, _library(spark, d)))
    return asked.join(lines, "query_id").select("input", "pos", "title", "cover", "director_date")


@query
def telemetry_counts(spark, d):
    events = table(spark, d, "events").select("ts", F.col("event_type").alias("tag"))
    return jobs.hourly_counts(events)


@query
def stream_telemetry(spark, d):
    """The same counts from a stream of event files, one file a batch, the latest events first."""
    source, sink = scratch_path(spark, "events"), scratch_path(spark, "counts")
    events = table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tag")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events.repartitionByRange(min(4, tasks), F.desc("ts")).write.parquet(source)
    stream = jobs.file_stream(spark, source, events.schema, files_per_batch=1)
    jobs.count_stream(stream, sink, scratch_path(spark, "progress")).awaitTermination()
    return jobs.current_counts(spark, sink)


@query
def stream_requests(spark, d):
    """Requests answered from a stream of request files, in several batches, from a stored library."""
    source, sink = scratch_path(spark, "requests"), scratch_path(spark, "answers")
    _mixed_requests(spark, d).select(*REQUESTS.names).repartition(2, "query_id").write.parquet(source)
    stream = jobs.file_stream(spark, source, REQUESTS, files_per_batch=1)
    jobs.answer_stream(
        stream, _stored_library(spark, d), sink, scratch_path(spark, "progress")
    ).awaitTermination()
    return spark.read.parquet(sink).select("feature", "input", "response")


@query
def stream_extract(spark, d):
    """Film pages extracted from a stream of page files, in three batches; every third page arrives twice."""
    source, sink = scratch_path(spark, "pages"), scratch_path(spark, "records")
    documents = _documents(spark, d)
    pages = views.film_pages(documents)
    again = pages.filter(F.pmod(F.xxhash64("url"), F.lit(3)) == 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # files of a batch, so that none is read by one task
    pages.unionByName(again).repartition(3 * tasks, F.xxhash64("url", F.rand(1))).write.parquet(source)
    jobs.extract_stream(
        jobs.file_stream(spark, source, ARCHIVE, files_per_batch=tasks),
        store_archive(views.archive(documents)),
        SITE,
        sink,
        scratch_path(spark, "progress"),
    ).awaitTermination()
    return extract.records(spark.read.parquet(sink)).select("url", "status", "title", "trailer", "rank")
