"""The registered queries against their SQL on the smallest tables, one of each family."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from marquee.plans.oracles import ORACLES
from marquee.plans.queries import QUERIES
from tools.check_queries import connect, rows_of

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize(
    "name",
    [
        "catalog_derive", "catalog_display", "token_counts", "ngrams_ranked", "search_discover",
        "search_fuzzy_reference", "search_saved_index", "train_probs", "predict_genre", "accuracy",
        "top_titles", "page_links", "page_records", "crawl_records", "request_dispatch",
        "stream_telemetry", "stream_extract", "stream_requests", "discover_reference", "seed_pages",
        "merged_dump", "dump_quarantine", "crawl_events", "catalog_counts", "ngram_length_hist", "predict_stored_model",
        "search_from_index", "index_add", "search_two_edits", "observed_rows", "sketched_distinct", "heavy_words", "page_values",
    ],
)
def test_query_equals_sql(spark, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = connect(SF).execute(oracle_sql()[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[:3] == ["input", "pos", "movie_id"]
