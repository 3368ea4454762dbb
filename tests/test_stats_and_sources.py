import datetime
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from marquee.operators import sketches, stats
from marquee.operators.index import build_postings
from marquee.operators.skew import repeat_rows, salted_join
from marquee.session import scratch_path
from marquee.sources import catalog_io, telemetry, values
from tests.fixtures import dump, record, titled


def test_counts_and_others(spark):
    lines = ["a", " a", "b", "b ", "c", "", "  ", "Autres"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    counts = stats.value_counts(df, "value")
    ordered = [tuple(r) for r in stats.ordered_counts(counts).collect()]
    assert ordered == [("a", 2), ("b", 2), ("", 1), ("Autres", 1), ("c", 1)]
    top = [tuple(r) for r in stats.top_and_others(counts, 2).collect()]
    assert sorted(top) == [("Autres", 3, True), ("a", 2, False), ("b", 2, False)]
    few = [tuple(r) for r in stats.top_and_others(counts, 9).collect()]
    assert len(few) == 6 and ("Autres", 0, True) in few


def test_index_statistics(spark):
    catalog = titled(spark, {"abab": 1, "ba": 2, "!": 3})
    postings = build_postings(catalog)
    lengths = {r.length: r["count"] for r in stats.ngram_length_histogram(postings).collect()}
    assert lengths == {1: 2, 2: 2, 3: 2, 4: 1}
    histogram = stats.ngram_length_histogram(postings)
    assert [tuple(r) for r in stats.catalog_counts(catalog, histogram).collect()] == [(3, 7)]
    assert stats.approximate_ngrams(postings).first().ngrams > 0
    counted = stats.partition_rows(spark.range(100), 5, "id").collect()
    assert sum(r.rows for r in counted) == 100 and len(counted) <= 5


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    path = str(tmp_path / "spread")
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), F.lit(1).alias("_partition_rows"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "one write")
    before, after = stats.write_spread(rows, 7, "k", path)
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs.getJobIdsForGroup("spread")) == 2  # the two sides of the move, once each
    assert before == sum(after) == 1000 and len(after) == 7
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in files) == sorted(n for n in after if n)
    assert spark.read.parquet(path).columns == ["k", "_partition_rows"]
    for nothing in (rows.limit(0), rows.filter("k < 0")):
        assert stats.write_spread(nothing, 3, "k", path) == (0, [0, 0, 0])


def _values(spark):
    """One value is a third of all; many occur once; nulls are no values."""
    rare = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("v"), "id")
    common = spark.range(12_000).select(F.concat(F.lit("c"), F.floor(F.sqrt("id") / 3)).alias("v"), "id")
    hot = spark.range(16_000).select(F.lit("hot").alias("v"), "id")
    none = spark.range(500).select(F.lit(None).cast("string").alias("v"), "id")
    return rare.union(common).union(hot).union(none)


def test_sketches_of_parts_tell_what_one_of_all_does(spark, tmp_path):
    values = _values(spark)
    path = str(tmp_path / "sketches")
    parts = sketches.sketch_parts(values, "v", (F.col("id") % 5).cast("int"))
    sketches.store_parts(parts.filter("part < 3"), path)
    sketches.store_parts(parts.filter("part >= 2"), path)  # part 2 again: replaced, not added
    stored = sketches.stored_parts(spark, path)
    whole = sketches.sketch_parts(values, "v", F.lit(0))
    assert stored.count() == 5 and sketches.united(stored).first()["rows"] == 48_000
    estimate, low, high = sketches.distinct_estimate(stored).first()
    assert sketches.distinct_estimate(whole).first()["estimate"] == estimate
    exact = Counter(r.v for r in values.collect() if r.v is not None)
    assert low <= len(exact) <= high and high - low < 0.1 * len(exact)
    listed = sketches.frequent_estimates(stored, 20).collect()
    assert listed[0].value == "hot" and all(r.low <= exact[r.value] <= r.high for r in listed)


@pytest.mark.parametrize("share", [0.001, 0.01, 0.3, 0.5])
def test_heavy_values_are_exact(spark, share):
    values = _values(spark)
    exact = Counter(r.v for r in values.collect() if r.v is not None)
    parts = sketches.sketch_parts(values, "v", F.pmod("id", F.lit(3)))
    found = {r.value: r["count"] for r in sketches.heavy_values(values, "v", parts, share).collect()}
    assert found == {v: n for v, n in exact.items() if n > share * exact.total()}


def test_sketches_of_nothing(spark):
    empty = _values(spark).filter(F.col("v").isNull())
    parts = sketches.sketch_parts(empty, "v", F.lit(0))
    assert parts.count() == 0
    assert tuple(sketches.distinct_estimate(parts).first()) == (0, 0, 0)
    assert sketches.heavy_values(empty, "v", parts, 0.1).count() == 0
    with pytest.raises(ValueError):
        sketches.heavy_values(empty, "v", parts, 1e-9)


def test_copies_and_salted_join(spark):
    df = spark.createDataFrame([("a", 25_003), ("b", 1)], "k string, n long")
    got = {r.k: r["count"] for r in repeat_rows(df, "n").groupBy("k").count().collect()}
    assert got == {"a": 25_003, "b": 1}
    hot = spark.range(1000).select("id", F.lit("k").alias("k"))
    other = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "k string, v int")
    assert salted_join(hot, other, "k", ["id"]).count() == 2000


def test_dump_round_trip(spark, tmp_path):
    records = dump(spark, record(actors=[None, "B"], synopsis="é\n\"q\""), record(title="two", genre=[]))
    path = str(tmp_path / "dump")
    catalog_io.write_dump(records, path)
    catalog_io.write_dump(records, path, merged=True)
    back, quarantine = catalog_io.read_dump(spark, path)
    rows = [tuple(r)[1:] for r in back.orderBy("movie_id").collect()]
    assert rows == [tuple(r)[1:] for r in records.orderBy("movie_id").collect()]
    assert quarantine.count() == 0
    catalog_io.dry_run(back)


def test_quarantine(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('{"title":"ok","rank":1.5}\n{"rank":2}\n{broken\n', encoding="utf-8")
    records, quarantine = catalog_io.read_dump(spark, str(path))
    assert [(r.title, r["rank"]) for r in records.collect()] == [("ok", 1.5)]
    lines = sorted(r.line for r in quarantine.collect())
    assert lines == ['{"rank":2.0}', "{broken"]
    with pytest.raises(Exception):
        catalog_io.read_dump(spark, str(path), fail_fast=True)[0].collect()


def test_values_and_events(spark, tmp_path):
    path = str(tmp_path / "values")
    values.write_values(spark.createDataFrame([("x",), (None,), ("y",)], "v string"), F.col("v"), path)
    assert sorted(r.value for r in values.read_values(spark, path).collect()) == ["x", "y"]
    log = str(tmp_path / "log")
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "MOVIES")], "ts timestamp, tag string")
    telemetry.append_events(events, log)
    telemetry.append_events(events, log)
    assert telemetry.read_events(spark, log).count() == 2
    telemetry.reset_events(spark, log)
    assert telemetry.read_events(spark, log).count() == 0


def test_scratch_path_uses_the_shared_folder(spark):
    shared = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "/shared/folder"))
    assert scratch_path(shared, "x").startswith("/shared/folder/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
