import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.operators import distant, index, search
from marquee.operators.variants import walk_variants
from tests.fixtures import asked, titled

LETTERS = " abcdefghijklmnopqrstuvwxyz"


def walk(text, edits):
    """Edited forms of a text in visiting order, by plain recursion."""
    if not text:
        return [""]
    found = [text[0] + rest for rest in walk(text[1:], edits)]
    if edits:
        for letter in LETTERS:
            found += [letter + rest for rest in walk(text[1:], edits - 1)]
            found += [letter + rest for rest in walk(text, edits - 1)]
        found += walk(text[1:], edits - 1)
    return found


def plain_queue(text, titles, size=6):
    """The bounded queue over all variants, title by title."""
    ranked = sorted(titles, key=lambda t: (-t[2], t[0]))
    seen, queue = set(), []
    for variant in walk(text, 1):
        if not variant:
            continue
        for movie_id, title, rank in ranked:
            if variant not in title or movie_id in seen:
                continue
            seen.add(movie_id)
            if len(queue) < size:
                queue.append((rank, movie_id))
            elif max(queue)[0] < rank:
                queue.remove(max(queue))
                queue.append((rank, movie_id))
    return [movie_id for _, movie_id in sorted(queue, reverse=True)]


def answers(df):
    found = {}
    for row in df.orderBy("query_id", "pos").collect():
        found.setdefault(row.input, []).append(row.movie_id)
    return found


@pytest.mark.parametrize("text,edits", [("ab", 1), ("zoo", 1), ("é a", 1), ("ab", 2)])
def test_variants_follow_the_walk(spark, text, edits):
    texts = spark.createDataFrame([(text,)], "text string")
    rows = walk_variants(texts, edits).orderBy("visit").collect()
    got = [r.ngram for r in rows]
    want = walk(text, edits)
    assert got == want


def library(seed, count, alphabet="abc "):
    chance = random.Random(seed)
    ranks = chance.sample(range(-5000, 5000), count)
    texts = ["".join(chance.choices(alphabet, k=chance.randint(0, 14))) for _ in range(count)]
    return [(" ".join(t.split()), r) for t, r in zip(texts, ranks)]


@pytest.fixture(scope="module")
def small(spark):
    pairs = library(5, 120, "abcdefgh é")
    return pairs, titled(spark, pairs).cache()


REQUESTS = ["abc", "a", "héa", "bcdefgha", "zz", "", "...", "ab cd", "x" * 80, "A-B", "gg", "cab", "dé"]


def plain(pairs):
    return [(i, t, r) for i, (t, r) in enumerate(pairs)]


def stemmed(text):
    return "".join(c for c in text.lower() if c not in ".-")


def test_exact(spark, small):
    pairs, catalog = small
    got = answers(search.search(asked(spark, *REQUESTS), catalog, max_dist=0))
    for text in REQUESTS:
        hits = [t for t in plain(pairs) if stemmed(text) and stemmed(text) in t[1]]
        want = [t[0] for t in sorted(hits, key=lambda t: -t[2])[:6]] if len(text) < 80 else []
        assert got.get(text, []) == want, text


def fuzzy(text, pairs):
    wanted = {v for v in walk(text, 1) if v}
    hits = [t for t in plain(pairs) if any(v in t[1] for v in wanted)]
    return [t[0] for t in sorted(hits, key=lambda t: -t[2])[:6]]


def test_fuzzy_and_gate(spark, small):
    pairs, catalog = small
    requests = asked(spark, *REQUESTS)
    free = answers(search.search(requests, catalog, gate=False))
    gated = answers(search.search(requests, catalog))
    for text in REQUESTS:
        if len(text) >= 80:
            assert text not in free
            continue
        asked_for = stemmed(text)
        assert free.get(text, []) == fuzzy(asked_for, pairs), text
        exact = [t for t in plain(pairs) if asked_for and asked_for in t[1]]
        if len(exact) >= 6:
            want = [t[0] for t in sorted(exact, key=lambda t: -t[2])[:6]]
        else:
            want = fuzzy(asked_for, pairs)
        assert gated.get(text, []) == want, text


def test_reference_eviction(spark, small):
    pairs, catalog = small
    got = answers(
        search.search(asked(spark, *REQUESTS), catalog, eviction="reference", gate=False)
    )
    for text in REQUESTS:
        if len(text) < 80:
            assert got.get(text, []) == plain_queue(stemmed(text), plain(pairs)), text


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000))
def test_reference_eviction_on_random_titles(spark, seed):
    pairs = library(seed, 40, "ab")
    texts = ["ab", "ba", "aab", "b"]
    got = answers(
        search.search(asked(spark, *texts), titled(spark, pairs), eviction="reference", gate=False)
    )
    for text in texts:
        assert got.get(text, []) == plain_queue(text, plain(pairs)), (seed, text)


@pytest.mark.parametrize("limit,passes", [(60_000, 16), (1, 0)])
def test_large_batches_give_the_same(spark, small, monkeypatch, limit, passes):
    """Several passes, and full postings, instead of one broadcast set."""
    _, catalog = small
    requests = asked(spark, *REQUESTS)
    want = answers(search.search(requests, catalog))
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(search, "MOST_PASSES", passes)
    size = search.batch_size(search.request_texts(requests).withColumn("dist", F.lit(1)))
    assert size.passes > 1 and (size.passes <= passes or not passes)
    assert answers(search.search(requests, catalog)) == want


def test_saved_index_gives_the_same(spark, small, tmp_path):
    _, catalog = small
    requests = asked(spark, *REQUESTS)
    path = str(tmp_path / "index")
    index.save_index(index.build_postings(catalog, top_k=6), path)
    postings = spark.read.parquet(path)
    for options in ({"max_dist": 0}, {}, {"eviction": "reference"}):
        want = answers(search.search(requests, catalog, **options))
        assert answers(search.search(requests, catalog, postings=postings, **options)) == want


def test_equal_ranks_and_copies(spark):
    """Many copies of one title with one rank: the first ones win and none is listed twice."""
    catalog = titled(spark, [("same words here", 7)] * 300 + [("other words", 7), ("words", 9)])
    got = answers(search.search(asked(spark, "words", "same", "wordz"), catalog))
    assert got["words"] == [301, 0, 1, 2, 3, 4]
    assert got["same"] == [0, 1, 2, 3, 4, 5]
    assert got["wordz"] == got["words"]


def test_repeated_requests(spark, small):
    _, catalog = small
    rows = answers_by_id(search.search(asked(spark, *(["abc"] * 50)), catalog))
    assert len(rows) == 50 and len({tuple(v) for v in rows.values()}) == 1


def answers_by_id(df):
    found = {}
    for row in df.orderBy("query_id", "pos").collect():
        found.setdefault(row.query_id, []).append(row.movie_id)
    return found


def test_long_titles_and_long_requests(spark):
    chance = random.Random(3)
    long = "".join(chance.choices("abcdefgh", k=5000))
    catalog = titled(spark, {long: 5, "short one": 4, long[1000:1300]: 3})
    part, typo = long[1100:1170], long[1100:1120] + "z" + long[1121:1170]
    got = answers(search.search(asked(spark, part, typo), catalog))
    assert got[part] == [0, 2] and got[typo] == [0, 2]


def test_plans_have_no_nested_loop(spark, small):
    _, catalog = small
    for options in ({"max_dist": 0}, {}, {"eviction": "reference", "gate": False}):
        found = search.search(asked(spark, "abc", "de"), catalog, **options)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "WindowGroupLimit" in plan


def test_requests_of_one_beginning_cost_one_row_per_length(spark):
    """However many n-grams share their first letters, a title position meets one row per length."""
    titles = titled(spark, [(f"the lament of number {i}", i) for i in range(50)])
    crowd = [f"the lament of {a}{b}" for a in LETTERS for b in LETTERS]
    ngrams = spark.createDataFrame([(w,) for w in {*crowd, "the lament of nu"}], "ngram string")
    found = index.probe_postings(titles, ngrams, [16], 6)
    assert [r.ngram for r in found.collect()] == ["the lament of nu"] * 6

    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_gate_and_eviction_together(spark, small):
    """The answer a client really gets: exact hits alone where there are enough, else the queue's."""
    pairs, catalog = small
    got = answers(search.search(asked(spark, *REQUESTS), catalog, eviction="reference"))
    for text in REQUESTS:
        asked_for = stemmed(text)
        exact = sorted((t for t in plain(pairs) if asked_for and asked_for in t[1]), key=lambda t: (-t[2], t[0]))
        if len(text) >= 80:
            assert text not in got
        elif len(exact) < 6:
            assert got.get(text, []) == plain_queue(asked_for, plain(pairs)), text
        else:
            assert len(got[text]) == 6 and set(got[text]) <= {t[0] for t in exact}, text


def test_two_edits_by_parts_equal_the_variants(spark):
    rng = random.Random(5)
    words = ["wolverine", "seashells", "the sea wolf", "mountains"]

    def changed(word):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at], word[: at + 1]]) + rng.choice(["", "e", " ", "é", "7"]) + word[at + 1 :]
        return word

    titles = [(f"{rng.choice(['', 'x ', 'ab'])}{changed(rng.choice(words))}{rng.choice(['', ' y'])}", i % 17) for i in range(150)]
    catalog = titled(spark, titles)
    requests = asked(spark, *words, "Seashell!", "sea", "éa")
    want = search.search(requests.filter("length(input) < 10"), catalog, max_dist=2)
    got = distant.search_two_edits(requests.filter("length(input) < 10"), catalog)
    assert answers(got) == answers(want)
    assert {r.input for r in distant.search_two_edits(requests, catalog).collect()} >= {"the sea wolf", "mountains"}
