"""Substrings of some lengths: what a task passes on, against plain sets of them."""

import random

import pyarrow as pa
import pytest

from marquee.operators import index, probe
from marquee.plans import queries
from tests.fixtures import titled


def plain(rows, lengths):
    """{ngram: {(movie_id, rank)}}"""
    found = {}
    for movie_id, rank, text in rows:
        for n in lengths:
            for i in range(len(text) - n + 1):
                found.setdefault(text[i : i + n], set()).add((movie_id, rank))
    return found


def best(titles, top_k):
    return sorted(titles, key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))[:top_k]


@pytest.mark.parametrize("held, chunk", [(1 << 20, 1 << 20), (40, 60)])
def test_the_best_titles_of_every_substring(monkeypatch, held, chunk):
    """Also where titles are cut into pieces, and where a task sends on what it holds and begins anew."""
    monkeypatch.setattr(probe, "CHUNK", chunk)
    monkeypatch.setattr(probe, "MOST_HELD", held)
    rng = random.Random(chunk)
    rows = [(i // 2, rng.choice([None, *range(9)]), "".join(rng.choices("ab é😀\0", k=rng.randint(0, 90)))) for i in range(150)]
    schema = pa.schema([("movie_id", pa.int64()), ("rank", pa.int32()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + 70]], schema) for i in (0, 70, 140)]
    lengths = [1, 2, 3, 5, 8, 13]
    got = {}
    for b in probe.best_of_substrings(iter(batches), lengths, 4, schema):
        for r in b.to_pylist():
            got.setdefault(r["ngram"], set()).add((r["movie_id"], r["rank"]))
    wanted = plain(rows, lengths)
    assert set(got) == set(wanted)
    for ngram, titles in wanted.items():
        assert set(best(titles, 4)) <= got[ngram] <= titles
        assert len(got[ngram]) <= 4 or held < 1 << 20


@pytest.mark.parametrize("long_title", [1 << 16, 20])
def test_postings_of_repeated_and_long_titles(spark, monkeypatch, long_title):
    monkeypatch.setattr(index, "LONG_TITLE", long_title)
    monkeypatch.setattr(index, "PIECE_STARTS", 16)
    rng = random.Random(5)
    rows = [(i // 2, i % 3 or None, "".join(rng.choices("abé😀", k=rng.randint(1, 60)))) for i in range(60)]
    rows += rows[:9] + [(None, None, "abab"), (None, None, "baba")]
    catalog = spark.createDataFrame(rows, "movie_id long, rank int, title string")
    got = [tuple(r) for r in index.build_postings(catalog, [5, 1, 2]).collect()]
    wanted = plain(rows, [1, 2, 5])
    assert len(got) == len(set(got))
    assert set(got) == {(ngram, *title) for ngram, titles in wanted.items() for title in titles}


def test_postings_of_titles_are_not_shuffled(spark, tmp_path):
    """Titles move, and counts of n-grams: no row for a position is moved or sorted."""
    rows = [(i, " ".join(["the same words in all of them"] * 20), "en", "web", 600) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    distinct = queries.ngrams_distinct(spark, str(tmp_path))
    plan = distinct._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # n-grams of a title come different from its one row
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Aggregate") == 1 and "Window" not in above
    assert {r.titles for r in distinct.collect()} == {200}


def test_a_task_passes_on_few_titles_of_a_frequent_substring(spark):
    titles = titled(spark, [("all the same", i) for i in range(3000)]).coalesce(1)
    found = index._best_postings(index.stemmed_titles(titles), [1, 2], 6)
    assert found.count() == 6 * len(plain([(0, 0, "all the same")], [1, 2]))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
