"""Merkle manifest, benchmark decontamination and hard negatives against plain versions, and edge rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import contamination, merkle, negatives, queries
from marquee.llm.fm_index import FmIndex, WaveletTree, suffix_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", leaf string, tree string, witness string, row string, spans string, items string, words string, _at string"


def stored(spark, folder, name, rows, schema, clash=""):
    wide = [(*r, *["clash"] * clash.count(" string")) for r in rows]
    spark.createDataFrame(wide, schema + clash).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# --- manifest -----------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings as (before, after) per level of every leaf)."""
    nodes, path = [(x, [i]) for i, x in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for run in runs:
            for k, (_, below) in enumerate(run):
                for i in below:
                    path[i].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
        nodes = [(h(*[d for d, _ in run]), sum((b for _, b in run), [])) for run in runs]
    return nodes[0][0] if nodes else None, path


def plain_manifest(docs):
    def leaf(row, text):
        i, _, lang, source, n = row
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    groups = defaultdict(list)
    for row in docs:
        groups[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda g: g[:3])
        trees[s] = plain_tree([g[2] for g in groups[s]])
    root, upper = plain_tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for (_, _, own, row), path in zip(groups[s], trees[s][1]):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf(row, text)
            for before, after in path + above:
                fold = h(*before, fold, *after)
            proof = h(*[d for before, after in path + above for d in before + after])
            out.append((row[0], own, trees[s][0], root, proof, fold, fold == root))
    return out


def check_manifest(spark, folder, docs):
    sf = stored(spark, folder, "documents", docs, DOCS, CLASH)
    got = queries.op11_merkle_manifest(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(docs), key=str)


def test_manifest_edge_rows(spark, tmp_path):
    docs = [
        (1, "a\nb", "en", "s", 3), (2, None, None, "s", None), (None, "x\ny", "en", "s", 3), (None, "other", "en", "s", 5),
        (3, "", "", "", 0), (3, "", "", "", 0), (4, "alone\n", "de", None, 6), (-5, "é\n\U0001f600", "fr", "ä", 3),
        (6, "word\n" * 50_000, "en", "\U0001f600", 250_000), *[(7, "same\ncopy", "en", "s", 9)] * 5,
        *[(i, f"t\n{i}", "en", "t", 4) for i in range(10, 38)],
    ]
    check_manifest(spark, tmp_path, docs)


def test_manifest_of_several_blocks(spark, tmp_path):
    rows = merkle.BLOCK * 2 + 1  # the last block has one leaf
    docs = [(i * 7 % rows, f"text {i}\n", "en", "hot" if i % 100 else f"s{i % 300}", i) for i in range(rows + rows // 90)]
    check_manifest(spark, tmp_path, docs)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    check_manifest(spark, tmp_path / "one", [(2, "a\nb", "en", None, 3)])
    check_manifest(spark, tmp_path / "none", [])


@given(st.lists(st.binary(min_size=1, max_size=3), min_size=1, max_size=60))
def test_frontier_gives_the_tree_of_its_leaves(values):
    leaves = [hashlib.sha256(v).digest() for v in values]
    front = merkle.Frontier(merkle._height(len(leaves)))
    for leaf in leaves:
        front.append(leaf)
    root = front.close()
    assert root.hex() == plain_tree([leaf.hex() for leaf in leaves])[0]
    assert all(merkle.folded(leaf, bytes(w)) == root for leaf, w in zip(leaves, front.witnesses))


# --- decontamination ----------------------------------------------------------------------

LEAK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leak_words(text):
    return LEAK_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items):
    words, gone, found = leak_words(text), set(), set()
    for item, other in items:
        theirs = leak_words(other)
        if item is None or not theirs:
            continue
        size = min(10, len(theirs))
        for at in range(len(theirs) - size + 1):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == theirs[at : at + size]:
                    gone.update(range(i, i + size))
                    found.add(str(item))
    return len(words), len(gone), sorted(found)


def check_leaks(spark, folder, docs, items):
    stored(spark, folder, "benchmark", items, "item_id long, text string", CLASH)
    sf = stored(spark, folder, "documents", docs, DOCS, CLASH)
    got = queries.op12_benchmark_decontamination(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = []
    for row in docs:
        n, hit, found = plain_hits(row[1], items)
        want.append((row[0], n, hit, len(found), h(",".join(found)), hit > 0))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def leaks():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 25)))) for i in range(20)]
    items += [
        (100, "Één KURZES ding"), (101, "one"), (7, "repeated id with a text of its own in more than ten words"),
        (102, None), (None, "nobody owns this item"), (103, "... !!"), (104, items[0][1]), (9, items[9][1]),
    ]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), "en", "a", 1) for i in range(60)]
    docs += [(60 + i, f"before, {t} AFTER; {t}", "en", "a", 1) for i, (_, t) in enumerate(items) if t]
    docs += [
        (200, None, None, None, None), (201, "", "en", "a", 0), (None, "ONE,one-Één kurzes\tDing", "en", "a", 3),
        (202, "x " * 30_000 + items[3][1] + " y" * 30_000, "en", "a", 1), *[docs[65]] * 3, (203, "nobody owns this item", "en", "a", 1),
    ]
    return docs, items


def test_leaks_edge_rows(spark, tmp_path):
    check_leaks(spark, tmp_path, *leaks())


def test_leaks_with_windows_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 6000)
    check_leaks(spark, tmp_path, *leaks())


def test_leaks_of_empty_tables(spark, tmp_path):
    docs, items = leaks()
    check_leaks(spark, tmp_path / "no_items", docs, [])
    check_leaks(spark, tmp_path / "no_docs", [], items)


def test_leaks_in_small_shards_and_pieces(monkeypatch):
    monkeypatch.setattr(contamination, "SHARD", 40)
    monkeypatch.setattr(contamination, "PIECE", 50)
    monkeypatch.setattr(contamination, "LOCATED", 7)
    docs, items = leaks()
    holders = defaultdict(list)
    for item, text in items:
        words = leak_words(text)
        for at in range(max(1, len(words) - 9) if words and item is not None else 0):
            holders[tuple(words[at : at + 10])].append(str(item))
    rows = [(i, w) for w, found in holders.items() for i in set(found)]
    import pyarrow as pa

    phrases = contamination.Phrases.of(pa.table({"item": [i for i, _ in rows], "words": [list(w) for _, w in rows]}))
    texts = [row[1].encode() if row[1] is not None else None for row in docs]
    n_words = np.zeros(len(texts), np.int64)
    (document, start, end), (holder, item) = contamination._found(texts, phrases, n_words)
    hit = np.bincount(document, end - start, len(texts))
    for d, row in enumerate(docs):
        n, gone, found = plain_hits(row[1], items)
        assert (n_words[d], hit[d], sorted(set(item[holder == d]))) == (n, gone, found)


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_finds_every_occurrence(runs, phrases):
    symbols = np.array([s for run in runs for s in (*run, 0)], np.int64)
    index = FmIndex(symbols, 5)
    lengths = np.array([len(p) for p in phrases])
    table = np.zeros((len(phrases), lengths.max()), np.int64)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = p
    low, high = index.search(table, lengths)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(symbols)) if list(symbols[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b))) == want


@given(st.lists(st.integers(0, 6), min_size=1, max_size=40))
def test_tree_ranks_and_order(values):
    symbols = np.array(values)
    tree = WaveletTree(symbols, 7)
    for c, at in itertools.product(range(7), range(len(values) + 1)):
        assert tree.rank(np.array([c]), np.array([at]))[0] == values[:at].count(c)
    found, before = tree.access(np.arange(len(values)))
    assert list(found) == values and list(before) == [values[:i].count(v) for i, v in enumerate(values)]
    runs = np.append(symbols, 0)
    ends = np.cumsum(runs == 0)
    suffixes = [[(0, ends[j]) if runs[j] == 0 else (1, runs[j]) for j in range(i, len(runs))] for i in range(len(runs))]
    assert list(suffix_order(runs)) == sorted(range(len(runs)), key=suffixes.__getitem__)


# --- negatives ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows):
    kept = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in e], label))
    out = []
    for a, (i, e, label) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted(
            (-max(-(2**56), min(2**56, sum(map(int.__mul__, e, f)))), j, other == label)
            for b, (j, f, other) in enumerate(kept)
            if a != b and len(e) == len(f)
        )
        for minus, j, _ in [s for s in scored if s[2]][:5]:
            near = [s for s in scored if not s[2] and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:5]
            out += [(i, j, rank, n, -minus, -s) for rank, (s, n, _) in enumerate(near, 1)]
    return out


def check_negatives(spark, folder, rows):
    sf = stored(spark, folder, "embeddings", rows, VECTORS, CLASH)
    got = queries.op13_hard_negatives(spark, sf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24) * 0.4).astype(np.float32).tolist(), i % 4) for i in range(420)]
    copies = [(1000 + i, rows[0][1], i % 3) for i in range(140)]
    return rows + copies


def test_negatives_edge_rows(spark, tmp_path):
    sound = vectors()
    one = sound[0][1]
    odd = [
        (500, None, 1), (600, one, None), (None, one, 1), (601, [*one[:-1], math.nan], 1), (602, [*one[:-1], math.inf], 1),
        (603, [*one[:-1], None], 1), (700, [], 1), (701, [], 2), (702, [], 1), (800, [0.5, 0.5], 3), (801, [0.5, 0.25], 3), (802, [0.4, 0.5], 2),
        (200, sound[7][1], 1), (300, sound[300][1], sound[300][2]), (900, [0.0] * 24, 2), (910, [0.0] * 24, 2),
        (1100, [3e12, 1.0, -2e11], 4), (1101, [3e12, 2.0, 7.0], 4), (1102, [2.9e12, -4.0, 5.0], 5), (1103, [2.8e12, 9.0, 1.0], 6),
        (1200, [3e38, 0.0, 0.0], 8), (1201, [3e38, 1.0, 0.0], 8), (1202, [1e38, 0.0, 2.0], 7),
    ]
    assert len(check_negatives(spark, tmp_path, sound + odd)) > 50


def test_negatives_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 2)
    assert check_negatives(spark, tmp_path, vectors())


def test_negatives_of_empty_tables(spark, tmp_path):
    assert check_negatives(spark, tmp_path / "none", []) == []
    assert check_negatives(spark, tmp_path / "no_anchor", [(1, [1.0], 1), (2, [1.0], 2)]) == []


@pytest.mark.parametrize("dim", [0, 1, 2, 8, 9, 64, 100])
def test_bounds_hold_at_every_level(dim):
    rng = np.random.default_rng(dim)
    a, b = np.floor(rng.normal(size=(5, dim)) * 100), np.floor(rng.normal(size=(7, dim)) * 100)
    exact, apart = a @ b.T, None
    for ours, theirs in zip(negatives.summaries(a), negatives.summaries(b)):
        half = ours.shape[1] // 2
        mean, width = ours[:, :half] @ theirs[:, :half].T, ours[:, half:] @ theirs[:, half:].T
        assert (np.abs(exact - mean) <= width + 1e-6).all()
        assert apart is None or width.sum() <= apart.sum() + 1e-6
        apart = width
