"""Exact, fuzzy and detail search for batches of requests.

Requests with one normalised text are answered once. Their edit variants meet the postings in an
equi-join; no title is ever compared with a request by a nested loop.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.constants import MAX_MESSAGE_BYTES, SEARCH_DISTANCE, SEARCH_RESULTS
from marquee.functions.text import stem
from marquee.operators.catalog import detail
from marquee.operators.index import build_postings, probe_postings
from marquee.operators.skew import salted_join
from marquee.operators.variants import EDITS_PER_POSITION, variants

#: Largest estimated size of a set of variants, or of answers, that is broadcast.
BROADCAST_BYTES = 256 * 1024 * 1024
#: A larger set of variants is cut into parts, each with its own pass over the titles. Reading
#: titles again is cheaper than shuffling all their substrings, up to this many times.
MOST_PASSES = 16
_ROW_OVERHEAD = 64


class Index(Protocol):
    """A stored index of titles."""

    def lookup(self, ngrams: DataFrame, top_k: int) -> DataFrame: ...


@dataclass(frozen=True)
class BatchSize:
    """What one small aggregation tells about a batch: lengths and upper bounds of its size."""

    texts: int
    longest: int
    lengths: list[int]
    variant_bytes: float

    @property
    def passes(self) -> int:
        return max(1, math.ceil(self.variant_bytes / BROADCAST_BYTES))

    def answers_fit(self, results: int) -> bool:
        return self.texts * results * (self.longest * 4 + _ROW_OVERHEAD) <= BROADCAST_BYTES


def within_limit(requests: DataFrame) -> DataFrame:
    """Requests whose message, feature byte and text, is not too long to be answered."""
    return requests.filter(F.octet_length("input") + 1 <= MAX_MESSAGE_BYTES)


def request_texts(requests: DataFrame) -> DataFrame:
    """The distinct normalised texts of a batch."""
    texts = within_limit(requests).select(stem(F.col("input")).alias("text"))
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.filter(F.col("text") != "").distinct().repartition(tasks)


def batch_size(texts: DataFrame) -> BatchSize:
    """The size of a batch of ``(text, dist)``."""
    size = F.length("text")
    walks = F.pow(size * EDITS_PER_POSITION + 1, F.col("dist"))
    per_text = walks * (F.octet_length("text") + _ROW_OVERHEAD)
    row = texts.agg(
        F.count("*").alias("texts"),
        F.collect_set(F.struct(size.alias("n"), "dist")).alias("lengths"),  # a few per message length
        F.sum(per_text).alias("bytes"),
    ).first()
    near = {n + d for n, dist in row["lengths"] for d in range(-dist, dist + 1)}
    lengths = sorted(n for n in near if n > 0)
    return BatchSize(row["texts"], max(lengths, default=0), lengths, row["bytes"] or 0.0)


def candidates(
    requests: DataFrame,
    catalog: DataFrame,
    max_res: int = SEARCH_RESULTS,
    max_dist: int = SEARCH_DISTANCE,
    postings: DataFrame | Index | None = None,
    exact: DataFrame | None = None,
) -> tuple[DataFrame, BatchSize]:
    """``(text, movie_id, rank, visit)``: for each text the best titles of each of its variants.

    The ``max_res`` best titles of each variant are enough for every form of answer, so a text
    never has more than ``max_res`` rows per variant, however frequent the variant is.
    ``exact`` are further requests, looked up as they are (visit 0) in the same pass.
    """
    texts = request_texts(requests)
    sized, wanted = texts.withColumn("dist", F.lit(max_dist)), variants(texts, max_dist)
    if exact is not None:
        plain = request_texts(exact)
        sized = sized.unionByName(plain.withColumn("dist", F.lit(0)))
        both = wanted.unionByName(variants(plain, 0))
        wanted = both.groupBy("text", "ngram").agg(F.min("visit").alias("visit"))
    size = batch_size(sized)
    if not size.lengths:
        found = catalog.filter(F.lit(False)).select(F.lit("").alias("ngram"), "movie_id", "rank")
    elif postings is not None and not isinstance(postings, DataFrame):
        found = postings.lookup(wanted.select("ngram").distinct(), max_res)
    elif postings is not None:
        found = postings.filter(F.length("ngram").isin(size.lengths))
        if "length" in postings.columns:
            found = postings.filter(F.col("length").isin(size.lengths))
        found = found.select("ngram", "movie_id", "rank")
    elif size.passes <= MOST_PASSES:
        found = _probe_in_passes(catalog, wanted.select("ngram").distinct(), size, max_res)
    else:
        found = build_postings(catalog, size.lengths, top_k=max_res)
    hits = (
        wanted.join(found, "ngram")
        .groupBy("text", "movie_id", "rank")
        .agg(F.min("visit").alias("visit"))
    )
    return hits, size


def _probe_in_passes(
    catalog: DataFrame, ngrams: DataFrame, size: BatchSize, max_res: int
) -> DataFrame:
    part = F.pmod(F.xxhash64("ngram"), F.lit(size.passes))
    found = None
    for number in range(size.passes):
        some = ngrams if size.passes == 1 else ngrams.filter(part == number)
        postings = probe_postings(catalog, some, size.lengths, max_res)
        found = postings if found is None else found.unionByName(postings)
    return found


def _best(hits: DataFrame, max_res: int) -> DataFrame:
    order = Window.partitionBy("text").orderBy(F.desc("rank"), "movie_id")
    return hits.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= max_res)


def _as_evicted(hits: DataFrame, max_res: int) -> DataFrame:
    """Answers of a bounded queue that gives up its best entry when a better one arrives.

    The first ``max_res`` titles enter; if a later one beats them all, the result is those
    without their best, plus the best title overall (the first visited, if several are equal).
    """
    text = Window.partitionBy("text")
    order = text.orderBy("visit", F.desc("rank"), "movie_id")
    by_rank = text.orderBy(F.desc("rank"), "visit", "movie_id")
    entered = F.col("_order") <= max_res
    best_entered = F.max(F.when(entered, F.col("rank"))).over(text)
    first_places = text.orderBy(F.when(entered, 0).otherwise(1), F.desc("rank"), "movie_id")
    marked = hits.withColumns(
        {"_order": F.row_number().over(order), "_by_rank": F.row_number().over(by_rank)}
    ).withColumns(
        {
            "_beaten": F.max("rank").over(text) > best_entered,
            "_entered_place": F.row_number().over(first_places),
        }
    )
    kept = marked.filter(
        F.when(
            F.col("_beaten"),
            (entered & (F.col("_entered_place") > 1)) | (F.col("_by_rank") == 1),
        ).otherwise(entered)
    )
    return _best(kept.select("text", "movie_id", "rank", "visit"), max_res)


def _exact_if_enough(hits: DataFrame, max_res: int) -> DataFrame:
    """Texts with ``max_res`` exact hits keep only those; the others keep their fuzzy hits too."""
    exact = F.col("visit") == 0
    n_exact = F.sum(F.when(exact, 1).otherwise(0)).over(Window.partitionBy("text"))
    return hits.withColumn("_exact", n_exact).filter((F.col("_exact") < max_res) | exact)


def rank_answers(
    hits: DataFrame, max_res: int = SEARCH_RESULTS, eviction: str = "best", gate: bool = True
) -> DataFrame:
    """``(text, pos, movie_id, rank)`` from candidates."""
    if gate:
        hits = _exact_if_enough(hits, max_res)
    if eviction == "best":
        ranked = _best(hits, max_res)
    elif eviction == "reference":
        ranked = _as_evicted(hits, max_res)
    else:
        raise ValueError(f"unknown eviction: {eviction}")
    return ranked.select("text", "pos", "movie_id", "rank")


def attach(answers: DataFrame, titles: DataFrame, fits: bool) -> DataFrame:
    """Catalog columns of the answered titles.

    A bounded set of answers is broadcast to the catalog scan. A larger one may name one title
    very often, so it is salted against the few titles it needs.
    """
    if fits:
        return titles.join(F.broadcast(answers), "movie_id")
    needed = titles.join(answers.select("movie_id").distinct(), "movie_id", "left_semi")
    return salted_join(answers, needed, "movie_id", ["text", "pos"])


def to_requests(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of each text, given to every request that asked it."""
    asked = within_limit(requests).withColumn("text", stem(F.col("input")))
    return salted_join(asked, answers, "text", ["query_id"]).drop("text")


def search(
    requests: DataFrame,
    catalog: DataFrame,
    max_res: int = SEARCH_RESULTS,
    max_dist: int = SEARCH_DISTANCE,
    eviction: str = "best",
    gate: bool = True,
    postings: DataFrame | Index | None = None,
) -> DataFrame:
    """The best titles of each request ``(query_id, input)``.

    ``max_dist=0`` is the exact search. With ``gate``, a request with ``max_res`` exact hits gets
    only those. ``postings`` is a saved index holding at least ``max_res`` titles per n-gram.
    Returns ``(query_id, input, pos, movie_id, rank, title, local_cover, director, date)``.
    """
    hits, size = candidates(requests, catalog, max_res, max_dist, postings)
    return discovered(requests, hits, size, catalog, max_res, eviction, gate and max_dist > 0)


def discovered(
    requests: DataFrame,
    hits: DataFrame,
    size: BatchSize,
    catalog: DataFrame,
    max_res: int = SEARCH_RESULTS,
    eviction: str = "best",
    gate: bool = True,
) -> DataFrame:
    """The answers of ``search`` from the candidates of a batch that has these requests."""
    answers = rank_answers(hits, max_res, eviction, gate)
    titles = catalog.select("movie_id", "title", "local_cover", "director", "date")
    found = attach(answers, titles, size.answers_fit(max_res))
    return to_requests(requests.select("query_id", "input"), found)


def search_detail(
    requests: DataFrame, catalog: DataFrame, postings: DataFrame | Index | None = None
) -> DataFrame:
    """All public fields of the best title that contains the text of a request."""
    hits, size = candidates(requests, catalog, 1, 0, postings)
    return detailed(requests, hits, size, catalog)


def detailed(requests: DataFrame, hits: DataFrame, size: BatchSize, catalog: DataFrame) -> DataFrame:
    """The answers of ``search_detail`` from the candidates of a batch that has these requests."""
    answers = _best(hits.filter("visit = 0"), 1).select("text", "movie_id", "pos")
    found = attach(answers, detail(catalog), size.answers_fit(1)).drop("pos")
    return to_requests(requests.select("query_id", "input"), found)
