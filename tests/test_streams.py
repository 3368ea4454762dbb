"""Streams of several batches, in any order, and ids that do not depend on how files are split."""

import datetime
import json
import random

from pyspark.sql import functions as F

from marquee.operators.requests import build_library, load_library
from marquee.plans import views
from marquee.schema import REQUESTS
from marquee.sources import catalog_io
from marquee.sources.archive import fetch
from marquee.streaming import jobs
from tests.fixtures import titled


def test_late_events_count(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=7 * i), f"T{i % 3}") for i in range(1000)]
    for number in range(4):  # the newest events come first
        part = spark.createDataFrame(rows[250 * (3 - number) : 250 * (4 - number)], "ts timestamp, tag string")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), part.schema, files_per_batch=1)
    jobs.count_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    events = spark.createDataFrame(rows, "ts timestamp, tag string")
    got, want = jobs.current_counts(spark, str(tmp_path / "out")), jobs.hourly_counts(events)
    assert got.agg(F.sum("count")).first()[0] == 1000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_requests_from_a_stored_library(spark, tmp_path):
    catalog = titled(spark, [("alpha beta", 5), ("beta gamma", 9)]).withColumns(
        {"genre": F.array(F.lit("X")), "nationalities": F.array(F.lit("fr")), "actors": F.array(F.lit("A"))}
    )
    for name in ("status", "synopsis", "misc", "trailer"):
        catalog = catalog.withColumn(name, F.lit(""))
    for name in ("hours", "minutes", "score_viewers", "reviews_viewers"):
        catalog = catalog.withColumn(name, F.lit(1.0).cast("float"))
    catalog = catalog.withColumn("pictures", F.array(F.lit("p")))
    build_library(catalog, str(tmp_path / "library"))
    library = load_library(spark, str(tmp_path / "library"))
    for i, text in enumerate(["beta", "alpha", "gamma"]):
        asked = spark.createDataFrame([(i, "d", text)], REQUESTS)
        asked.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), REQUESTS, files_per_batch=1)
    jobs.answer_stream(stream, library, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.input: r.response.count("\n") for r in got.collect()} == {"beta": 2, "alpha": 1, "gamma": 1}
    assert got.select("batch_id").distinct().count() == 3


def test_dump_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = [json.dumps({"title": f"t{i}", "rank": i}) for i in range(400)]
    random.Random(3).shuffle(lines)
    for number, part in enumerate((lines[:1], lines[1:4], lines[4:])):
        (tmp_path / f"part-{number}.json").write_text("\n".join(part) + "\n", encoding="utf-8")
    seen = []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        records, _ = catalog_io.read_dump(spark, str(tmp_path))
        seen.append({r.title: r.movie_id for r in records.collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 400


def test_title_ids_of_large_documents_numbers(spark):
    docs = spark.createDataFrame([(2**63 - 1, "en", "s", "a\nb"), (0, "en", "s", "a")], "doc_id long, lang string, source string, text string")
    ids = [r.movie_id for r in views.lines(docs).collect()]
    assert len(set(ids)) == 3 and all(0 <= i < 2**60 for i in ids)


def test_one_version_per_url(spark):
    archive = spark.createDataFrame([("u", "one"), ("u", "two"), ("v", "x")], "url string, html string")
    urls = spark.createDataFrame([("u",), ("w",)], "url string")
    got = {r.url: r.html for r in fetch(urls, archive).collect()}
    assert set(got) == {"u", "w"} and got["w"] is None and fetch(urls, archive).count() == 2
