"""Work that must not fall to one task, however few files its input has."""

import glob

from marquee.operators import index
from marquee.plans import queries
from tests.fixtures import titled


def test_substrings_are_made_in_all_tasks(spark):
    titles = titled(spark, [(f"title number {i} of many", i) for i in range(40)]).coalesce(1)
    found = index.build_postings(titles)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.filter("ngram = 'many'").count() == 40


def test_a_batch_of_pages_has_many_files(spark, tmp_path, monkeypatch):
    rows = [(i, "one\ntwo\nthree", "en", "web", 13) for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    found = queries.stream_extract(spark, str(tmp_path))
    assert found.count() == found.select("url").distinct().count() == queries.page_records(spark, str(tmp_path)).count()
    assert len(glob.glob(f"{tmp_path}/pages/*.parquet")) == 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    commits = glob.glob(f"{tmp_path}/progress/commits/[0-9]*")
    assert len(commits) >= 3
