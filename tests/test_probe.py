import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.operators import distant, index, probe, search
from tests.fixtures import titled


def brute(rows, wanted, top_k):
    found = set()
    for text in wanted:
        hits = {(-rank if rank is not None else float("inf"), movie_id, rank) for movie_id, rank, title in rows if text in title}
        found |= {(text, movie_id, rank) for _, movie_id, rank in sorted(hits, key=lambda h: h[:2])[:top_k]}
    return found


@pytest.mark.parametrize("chunk", [1 << 20, 60])
def test_best_titles_of_every_text(monkeypatch, chunk):
    """Also where a title is cut into pieces, holds characters of any size, or has no rank."""
    monkeypatch.setattr(probe, "CHUNK", chunk)
    monkeypatch.setattr(probe, "FIRST_SLICE", 16)
    rng = random.Random(chunk)
    rows = [(i, rng.choice([None, *range(9)]), "".join(rng.choices("ab é😀", k=rng.randint(1, 150)))) for i in range(200)]
    wanted = {"".join(rng.choices("ab é😀", k=rng.randint(1, 7))) for _ in range(300)} | {rows[3][2], "absent"}
    schema = pa.schema([("movie_id", pa.int64()), ("rank", pa.int32()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + 70]], schema) for i in (0, 70, 140)]
    out = probe.best_titles(iter(batches), probe.Wanted.of(list(wanted)), 4, schema)
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, wanted, 4)


def test_a_position_of_a_title_is_no_row(spark):
    """Titles are searched whole: what a task passes on does not grow with their length."""
    titles = titled(spark, [(f"the lament of number {i}", i) for i in range(50)])
    ngrams = spark.createDataFrame([("lament",), ("number 4",), ("nowhere",)], "ngram string")
    found = index.probe_postings(titles, ngrams, [6, 7, 8], 3)
    assert {(r.ngram, r.rank) for r in found.collect()} == {
        *(("lament", i) for i in (49, 48, 47)), *(("number 4", i) for i in (49, 48, 47)),
    }
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_two_edits_are_found_in_arrays(spark, monkeypatch):
    """As by the join of positions, with titles that end inside a text and characters no edit brings in; no row a position."""
    monkeypatch.setattr(distant, "POSITIONS", 50)
    rng = random.Random(3)
    rows = [("".join(rng.choices("abc é", k=rng.randint(1, 60))), rng.randint(0, 9)) for _ in range(150)]
    catalog = titled(spark, rows).repartition(3)
    texts = spark.createDataFrame([("".join(rng.choices("abc ", k=8 + i % 4)),) for i in range(40)], "text string").distinct()
    size = search.batch_size(texts.withColumn("dist", F.lit(0)))
    found = distant._probed(texts, catalog, size.longest)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r) for r in found.collect()}
    joined = distant._joined(texts, catalog, size).filter("visit <= 2").select("text", "movie_id", "rank", "visit")
    assert got == {tuple(r) for r in joined.collect()} and {r[3] for r in got} >= {1, 2}
