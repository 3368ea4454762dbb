from pyspark.sql import functions as F

from marquee.functions import fields
from marquee.functions.text import content_words, stem, tokens
from marquee.operators.index import build_postings
from marquee.operators.stats import trimmed
from tests.fixtures import titled


def values(spark, inputs, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_stem(spark):
    got = values(
        spark,
        ["L'Été  À  Paris", "  A-B (c)! ", "\t x\ty \n", "!!!", "", "É", "a   b"],
        stem,
    )
    assert got == ["lÉté À paris", "ab c", "x\ty", "", "", "É", "a   b"]


def test_words(spark):
    assert values(spark, ["a\tb  c\n", "", " "], tokens) == [["a", "b", "c"], [], []]
    assert values(spark, ["the the alpha of alpha"], content_words) == [["alpha", "alpha"]]


def test_substrings_of_whole_titles(spark):
    found = build_postings(titled(spark, {"abab": 1, "!!": 2, "": 3})).collect()
    assert sorted(r.ngram for r in found) == ["a", "ab", "aba", "abab", "b", "ba", "bab"]


def test_chosen_lengths_across_pieces(spark):
    title = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(900))
    catalog = titled(spark, {title: 1, "é" * 200: 2, "ab": 3})
    got = {(r.ngram, r.movie_id) for r in build_postings(catalog, [2, 5]).collect()}
    want = {
        (t[i : i + n], k)
        for k, t in enumerate([title, "é" * 200, "ab"])
        for n in (2, 5)
        for i in range(len(t) - n + 1)
    }
    assert got == want


def test_browser_trim(spark):
    assert values(spark, [" a ", "　b c﻿", " "], trimmed) == ["a", "b c", ""]


def test_page_values(spark):
    assert values(spark, ["http://x/film12_7.html", "none"], fields.first_number) == [12.0, -1.0]
    page = ["(1h 20min) (2h 30min)", "1h 20min"]
    assert values(spark, page, lambda c: fields.duration_part(c, 2)) == [20.0, None]
    assert values(spark, ["3,7", " 4 ", "x", None], lambda c: fields.number_or_null(c, True)) == [
        float.fromhex("0x1.d9999ap+1"), 4.0, None, None,
    ]
    assert values(spark, ["a\\/b\\nc\\\\d"], fields.stripslashes) == ["a/b\ncd"]
    trailers = [
        '"\\/\\/m\\/a_sd_1.mp4","\\/\\/m\\/a_hd_1.mp4"',
        '"\\/\\/m\\/a_sd_1.mp4"',
        "no video",
    ]
    assert values(spark, trailers, fields.trailer_file) == [
        "http://m/a_hd_1.mp4", "http://m/a_sd_1.mp4", None,
    ]


def test_links(spark):
    page = (
        '<A HREF="/n">x</A><a class="b meta-title-link" href="/a?x=1&amp;y=2">1</a>'
        "<a href='/c' class='meta-title-link'>2</a><a class=\"meta-title-linkx\" href=\"/d\">3</a>"
        '<a class="meta-title-link">4</a><abbr class="meta-title-link" href="/e">'
    )
    links = values(spark, [page], lambda c: fields.anchor_links(c, "meta-title-link"))
    assert links == [["/a?x=1&y=2", "/c"]]
    assert values(spark, [page], fields.anchor_links) == [["/n", "/a?x=1&y=2", "/c", "/d"]]
