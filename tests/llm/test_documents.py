"""Whole queries of the operators on documents, pages and vectors against plain versions, and edge rows."""

import functools
import json
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import ann, html_text, lm_score, packing, quality, queries, simhash, substrings
from marquee.llm.components import components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length long, row long"
LONG = "lorem ipsum  dolor\n sit amet, " * 4000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9.0, 8, 7) for i, t in rows], SCHEMA)


def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


EDGE = [
    (10_001, None), (10_002, ""), (10_003, " \t "), (10_004, "one two"), (10_005, LONG), (10_006, LONG), (10_006, LONG),
    (10_007, "x" * 50_000), (10_008, "a b c\x1cd  e <|endoftext|> \U0001f600"), (10_009, "one  two"),
]


# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_simhash_groups(spark):
    docs = corpus(spark) + EDGE
    got = simhash.near_groups(frame(spark, docs)).collect()
    fps = [plain_fingerprint(t) for _, t in docs]
    group = plain_groups(fps)
    smallest = defaultdict(lambda: 1 << 62)
    for (i, _), f in zip(docs, fps, strict=True):
        smallest[group[f]] = min(smallest[group[f]], i)
    want = sorted((i, f, smallest[group[f]]) for (i, _), f in zip(docs, fps, strict=True))
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_anchors_meet_within_two_bits(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3)]
    fps = sorted(set(base + near))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(rows).collect()}
    want = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want}
    assert len(got) * 2 == len(want)


def test_keep_one_of_each_group(spark):
    docs = frame(spark, [*EDGE, (None, "no id"), (3, "one two")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 10_001, 10_005, 10_007, 10_008]


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + hub + path, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(500, 900), 500)}


# ---- packing


def test_packing_is_whole_and_tight(spark):
    tool = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    special = ["a b <|endoftext|> c", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n ", "<|endoftext"]
    docs = corpus(spark) + EDGE + [(9000 + i, t) for i, t in enumerate(special)]
    got = packing.pack(frame(spark, docs)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in docs:
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        times = sum(k == i for k, _ in docs)
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert len(rows) == times * len(packing.cut(len(ids), 2048))
        for r in rows:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.length == 2048 or r.piece == 0
        assert sum(r.length for r in rows) == times * len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def fewest(sizes, capacity):
    """The least number of sequences, by trying every way to fill the sequence of the largest piece."""

    @functools.cache
    def of(left):
        if not left:
            return 0
        found = set()

        def fill(i, room, rest):
            if i == len(left):
                found.add(rest)
            else:
                if left[i] <= room:
                    fill(i + 1, room - left[i], rest)
                fill(i + 1, room, (*rest, left[i]))

        fill(1, capacity - left[0], ())
        return 1 + min(of(rest) for rest in found)

    return of(tuple(sorted(sizes, reverse=True)))


def check_plan(sizes, capacity):
    plan = packing.complete(np.bincount(sizes, minlength=capacity + 1), capacity)
    used = Counter()
    for filling, n in plan.fillings:
        assert sum(filling) <= capacity
        used.update({s: n * k for s, k in Counter(filling).items()})
    assert used == Counter(sizes) and plan.proven and plan.sequences == fewest(sizes, capacity)


@pytest.mark.parametrize(
    "sizes,capacity",
    [
        ([6, 6, 5, 5, 4, 4], 12), ([7, 5, 5, 4, 4, 3, 2], 12), ([12], 12), ([], 12), ([3] * 9, 12), ([11, 8, 7, 6, 5, 4, 2, 1, 1, 3], 12),
        ([18, 15, 14, 11, 8, 8, 6, 4, 3, 3], 30), ([9, 9, 8, 8, 7, 7, 6, 6, 5, 5], 24),
    ],
)
def test_plan_is_optimal(sizes, capacity):
    check_plan(sizes, capacity)


@settings(deadline=None, max_examples=300)
@given(st.integers(5, 50).flatmap(lambda c: st.tuples(st.lists(st.integers(1, c), max_size=11), st.just(c))))
def test_plan_is_optimal_on_small_cases(case):
    check_plan(*case)


def test_plan_is_optimal_on_random_cases():
    rng = random.Random(11)
    for _ in range(400):
        capacity = rng.randint(10, 50)
        check_plan([rng.randint(1, capacity * 2 // 3) for _ in range(rng.randint(5, 12))], capacity)


def test_encoder_knows_other_kinds_of_vocabulary():
    definition = json.loads(Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).to_str())
    assert packing._plain_encoder(definition)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}):
        assert packing._plain_encoder({**definition, **change}) is None


# ---- substring dedup


def test_substring_dedup(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = corpus(spark) + EDGE + [(10_100, f"a b {passage} c"), (10_101, f"{passage}\t{passage}"), (10_102, "w1 w2"), (10_103, passage)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicated(frame(spark, docs)).collect())
    want = sorted((i, len(w), sum(g), " ".join(x for x, gone in zip(w, g, strict=True) if not gone)) for i, w, g in brute.removed(docs))
    assert got == want
    digest = {r.doc_id: r.kept_sha256 for r in queries.op7_substring_dedup(spark, SF).collect()}
    assert digest == {i: brute.sha(" ".join(x for x, gone in zip(w, g, strict=True) if not gone)) for i, w, g in brute.removed(corpus(spark))}


def test_maximal_repeats():
    assert substrings.maximal(np.array([3, 0, 1, 14, 40])) == [(0, 27), (40, 53)]
    assert substrings.maximal(np.array([], np.int64)) == []


# ---- language model


@pytest.mark.parametrize("part", [4_000_000, 3_000])
def test_backoff_scores(spark, monkeypatch, part):
    monkeypatch.setattr(lm_score, "WORDS_PER_PART", part)
    docs = [*corpus(spark), *EDGE[:5], (10_006, LONG), (10_007, "the " * 3000)]
    pair, history = Counter(), Counter()
    for _, t in docs:
        w = brute.words(t)
        for a, b in zip([None, *w], w, strict=False):
            pair[a, b] += 1
            history[a] += 1
    rows = lm_score.scores(frame(spark, docs)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        w = brute.words(dict(docs)[r.doc_id])
        assert r.n_words == len(w)
        logs = [math.log(pair[a, b] / history[a]) for a, b in zip([None, *w], w, strict=False)]
        assert r.score == (pytest.approx(sum(logs) / len(w)) if w else None)
        assert r.seen_once == sum(pair[a, b] == 1 for a, b in zip([None, *w], w, strict=False))


def test_backoff_gathers_no_hot_word_or_pair(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(lm_score, "WORDS_PER_PART", 3_000)
    largest, apply = [], GroupedData.applyInArrow

    def measured(self, *args):
        entries = self._df.groupBy("part").agg(F.sum(F.length("ws") / lm_score.WIDTH).alias("n"))
        largest.append(entries.agg(F.max("n")).first()[0])
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", measured)
    # "hot" begins a fourth of all pairs, each seen four times; "cold" ends a fourth, each seen once.
    docs = [(i, " ".join(f"hot a{(20 * i + j) % 2000} z{i}_{j} cold" for j in range(20))) for i in range(400)]
    rows = lm_score.scores(frame(spark, docs)).collect()
    assert max(largest) <= 6_000
    assert [r.score for r in rows] == pytest.approx([(20 * math.log(4 / 8000) + 20 * math.log(1 / 4)) / 80] * 400)
    assert {r.seen_once for r in rows} == {40}
    # One pair of two hot words in every one of many short documents: half of all entries.
    largest.clear()
    docs = [(i, f"hot cold w{i} hot") for i in range(10_000)]
    rows = lm_score.scores(frame(spark, docs)).collect()
    assert max(largest) <= 6_000
    assert [r.score for r in rows] == pytest.approx([math.log(1 / 10_000) / 4] * 10_000)


def plain_left_out(docs):
    """(n_words, score, seen_once, backed_off) of every row by the counts of all other rows."""
    own = [(Counter(zip([None, *w], w, strict=False)), Counter(w), Counter([None, *w][:-1])) for w in (brute.words(t) for _, t in docs)]
    pair, word, history = Counter(), Counter(), Counter()
    for counts in own:
        for total_of, of in zip((pair, word, history), counts, strict=True):
            total_of.update(of)
    total = sum(word.values())
    for pairs, words, heads in own:
        n = sum(words.values())
        value = 0.0
        for (a, b), k in pairs.items():
            if pair[a, b] > k:
                value += k * math.log((pair[a, b] - k) / (history[a] - heads[a]))
            elif total > n:
                value += k * math.log(0.4 * max(1, word[b] - words[b]) / (total - n))
        score = value / n if n and total > n else None
        yield n, score, sum(pair[g] == 1 for g in pairs), sum(k for g, k in pairs.items() if pair[g] == k)


def same_left_out(rows, docs):
    order = lambda r: (r[0], r[1], r[2] if r[2] is not None else 1)
    want = sorted(((i, *v) for (i, _), v in zip(docs, plain_left_out(docs), strict=True)), key=order)
    got = sorted(((r.doc_id, r.n_words, r.score, r.seen_once, r.backed_off) for r in rows), key=order)
    assert [(*g[:2], *g[3:]) for g in got] == [(*v[:2], *v[3:]) for v in want]
    assert [g[2] for g in got] == [v[2] if v[2] is None else pytest.approx(v[2]) for v in want]
    return got


@pytest.mark.parametrize("part", [4_000_000, 3_000])
def test_backoff_to_words_of_others(spark, monkeypatch, part):
    monkeypatch.setattr(lm_score, "WORDS_PER_PART", part)
    # New pairs of known words, words nobody else has, a copy, a row that occurs twice, a known word that only ends texts.
    docs = [*corpus(spark)[:300], *EDGE, (20_001, "one x two nobody"), (20_002, "two one one last"), (20_003, "two one one last")]
    docs += [(20_004, "a b last"), (20_005, "c last"), (20_006, "the " * 3000 + "one")]
    got = same_left_out(lm_score.scores(frame(spark, docs), own=False).collect(), docs)
    assert {g[4] for g in got if g[0] in (20_002, 20_003)} == {0}
    assert all(g[4] > 0 for g in got if g[0] in (20_001, 20_005))


def test_backoff_of_one_document_and_of_the_query(spark):
    assert [tuple(r) for r in lm_score.scores(frame(spark, [(1, "a b a b")]), own=False).collect()] == [(1, 4, None, 2, 4)]
    rows = queries.op5_backoff_scores(spark, SF).collect()
    same_left_out(rows, corpus(spark))
    assert sum(r.backed_off for r in rows) > 0


def test_backoff_gathers_no_hot_word_it_backs_off_to(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(lm_score, "WORDS_PER_PART", 3_000)
    largest, apply = [], GroupedData.applyInArrow

    def measured(self, *args):
        entries = self._df.groupBy("part").agg(F.sum(F.length("ws") / lm_score.WIDTH).alias("n"))
        largest.append(entries.agg(F.max("n")).first()[0])
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", measured)
    # Every document backs off to "cold" and "last", a fourth of all words each, one of them always at the end.
    docs = [(i, f"x{i} cold y{i} last") for i in range(10_000)]
    same_left_out(lm_score.scores(frame(spark, docs), own=False).collect(), docs)
    assert max(largest) <= 6_000
    # A heavy pair, hot in one document alone, and a heavy word that is a history all over.
    largest.clear()
    docs = [(i, " ".join(f"hot a{(20 * i + j) % 2000} z{i}_{j}" for j in range(20))) for i in range(400)] + [(400, "hot cold " * 4000)]
    same_left_out(lm_score.scores(frame(spark, docs), own=False).collect(), docs)
    assert max(largest) <= 6_000


def test_backoff_by_another_corpus(spark):
    known = [(1, "a b c a b d"), (2, "a b c"), (3, None), (3, "a b c")]
    docs = [(1, "a b c"), (2, "b c x a b e"), (3, None), (4, " "), (5, "c a"), (5, "c a"), (6, "the " * 500 + "b")]
    counts, histories, total = Counter(), Counter(), 0
    for _, t in known:
        padded = ["", "", *brute.words(t)]
        for end in range(2, len(padded)):
            total += 1
            for k in (1, 2, 3):
                counts[tuple(padded[end - k + 1 : end + 1])] += 1
                histories[k, tuple(padded[end - k + 1 : end])] += 1

    def log(gram, k):
        if k == 1:
            return math.log(max(1, counts[gram[-1:]]) / total)
        g = gram[-k:]
        return math.log(counts[g] / histories[k, g[:-1]]) if counts[g] else math.log(0.4) + log(gram, k - 1)

    want = []
    for i, t in docs:
        padded = ["", "", *brute.words(t)]
        grams = [tuple(padded[end - 2 : end + 1]) for end in range(2, len(padded))]
        score = round(sum(log(g, 3) for g in grams) / len(grams), 9) if grams else -99
        want.append((i, len(grams), score, sum(not counts[g] for g in grams)))
    found = lm_score.scores_against(frame(spark, docs), frame(spark, known)).collect()
    assert sorted((r.doc_id, r.n_words, -99 if r.score is None else round(r.score, 9), r.backed_off) for r in found) == sorted(want)
    assert {r.score for r in lm_score.scores_against(frame(spark, docs), frame(spark, known).limit(0)).collect()} == {None}


# ---- quality


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in unseen) >= 0.95 * len(unseen)


def test_quality_edges(spark):
    docs = frame(spark, [(i, f"good words here number {i}") for i in range(60)] + [(i, f"BAD!! {i}") for i in range(60, 120)] + EDGE)
    some = [(i, int(i < 60)) for i in range(120)] + [(3, None), (None, 1), (5, 1)]
    labels = spark.createDataFrame(some, "doc_id long, quality int")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids & set(range(120)) == set(range(60))
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    one = quality.train(docs, labels.filter("quality = 1"))
    assert len({r.score for r in quality.scored(docs, one).collect()}) == 1
    assert quality.accepted(docs.limit(0), labels).count() == 0


# ---- pages


def test_extraction_matches_marked_content(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = (
    "<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies for a long sentence of many words that goes on and on.</div>"
    "<div class=post><h1>Real title</h1><p>Body &amp; text with &eacute; and <b>bo</b>ld words that run on for a while."
    "<!-- gone --><aside>Buy this thing now it is great and cheap.</aside><ul><li>first item<li>second\n item</ul>"
    "<p>Another paragraph with many words, a <a href='a>b'>link</a> inside, and an end.</p><form><label>Name</label></form></div>"
    "<div id=comments><p>I liked this article a lot and have many words to say about it.</p></div><footer>by us</footer>"
)


def test_extraction_of_other_layouts_and_edges(spark):
    want = (
        "Real title Body & text with é and bold words that run on for a while. first item second item "
        "Another paragraph with many words, a link inside, and an end."
    )
    assert html_text.main_text(PAGE, html_text.fit([])) == want
    odd = [(1, "u", None), (2, "u", ""), (3, None, "<p>" * 3000 + "deep words"), (4, "u", "<script>var a='</p>'"), (5, "u", "plain & simple <"), (6, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "clash") for r in odd], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extracted(pages, html_text.train(pages)).collect()}
    assert got == {1: "", 2: "", 3: "deep words", 4: "", 5: "plain & simple <", 6: want}
    assert html_text.extracted(pages.limit(0), html_text.train(pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><body><article><p>Body words</p></article>", "Body words"),
        ('<p>one <svg class="i"/> two</p><p>three</p>', "one two three"),
        ("<p>one <svg><text>gone</text></svg> two</p>", "one two"),
        ("<p>one</p><button>go<p>two</p>", "one go two"),
        ("<p>one</p><script>two", "one"),
    ],
)
def test_skipped_elements_take_no_more_than_their_own(page, want):
    assert " ".join(b.text for b in html_text.blocks(page)) == want


# ---- nearest neighbours


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in queries.op1_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = (x * x[ids == q][0]).sum(axis=1)
        scores[ids == q] = -np.inf
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[2] for f in found] == pytest.approx([scores[ids == f[1]][0] for f in found])
        hits += len({f[1] for f in found} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (20, [0.0, -1.0]), (4, None), (5, []),
               (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (40, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, leaf int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 3, 3, 0.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 3, -1.0)]
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id long, embedding array<float>")
    near = ann.nearest(copies).filter("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in near] == [i for i in range(21) if i != 20]
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("apply", [simhash.near_groups, simhash.keep_one, packing.pack, substrings.deduplicated, lm_score.scores])
def test_empty_table(spark, apply):
    assert apply(frame(spark, EDGE).limit(0)).count() == 0


# ---- pages whose names and markup mislead


PAGES = {
    "<body class='no-sidebar'><article><p>whole article text</p></article></body>": "whole article text",
    "<main class='with-comments'><p>whole article text</p></main>": "whole article text",
    "<article id=post-legal-search-tips><p>whole article text</p></article>": "whole article text",
    "<article class=recipe-cookie><p>whole article text</p></article>": "whole article text",
    "<div class='widget'><article><p>whole article text</p></article></div>": "whole article text",
    "<article><p data-t=it's>Hello first paragraph words</p><p>second words here</p><p>don't lose third</p></article>": (
        "Hello first paragraph words second words here don't lose third"
    ),
    "<article><p>one <svg class='i'/> two</p><p>three <button>press</button> four</p></article>": "one two three four",
    "<article><p>one <button>two</p><p>three</p></article>": "one two three",
    "<article><p title='a > b'>one</p><p title=\"it's\">two</p></article>": "one two",
    "<article><p>one two three</p><div class='comments'><p>me first</p></div><div class='share'>x y</div></article>": "one two three",
    "<html><head><title>t</title><body><article><p>Body words</p></article>": "Body words",
}


@pytest.mark.parametrize("page", PAGES)
def test_the_scan_decides_not_names(page):
    assert html_text.main_text(page, html_text.fit([])) == PAGES[page]


@pytest.mark.parametrize("tag", ["<button>", "<svg>", "<select x='", "<p a=", "<svg a=\"", "</p", "<!", "=\"'"])
def test_unclosed_tags_take_linear_time(tag):
    began = time.process_time()
    html_text.blocks("<article><p>words</p>" + (tag + " x ") * 10_000)
    assert time.process_time() - began < 1.0
