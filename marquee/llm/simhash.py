"""SimHash near-duplicates found at the anchors of a covering code (operator 10).

The fingerprint of a text takes the majority, bit by bit, of the 64-bit hashes of its three-word shingles. Two
fingerprints are linked at two or fewer differing bits.

Anchors: the first 46 bits of a fingerprint are two blocks of 23 bits, each covered by the binary Golay code, whose
balls of radius 3 fill the space exactly once. An anchor is a pair of code words. The home anchor of a fingerprint
is the pair of code words within 3 bits of its blocks. A partner at distance 2 may have drifted by 2 bits in one
block or by 1 in each, so every fingerprint is sent to all anchors within 3 + 2 and 3 + 0, 3 + 1 and 3 + 1, or
3 + 0 and 3 + 2 bits of its blocks (61 on average): one of them is the home of any partner. At an anchor its
residents are compared with its guests, by the full 64 bits.

Copies do not multiply: equal fingerprints are one row before anchors are sought, and a fingerprint has at most
64 + 2016 others within 2 bits, so links grow with the number of different fingerprints, however large a group is.
Groups are then found by rounds of star contraction, each written to the shared checkpoint folder.

Defined results: null text counts as empty; a text without words has fingerprint 0 and is linked like any other;
one or two words are one shingle. Repeated rows, also of one doc_id, belong to one group as far as their texts do.
A null doc_id is in a group like others but never names one (the group's id is null if it has no other). Other
columns are carried along by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import batches, null_safe, settle, unused
from marquee.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 64
BLOCK, RADIUS, DISTANCE = 23, 3, 2
# Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of UTF-8 text; A-Z are taken as a-z."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - shingle].tolist()
        spans = zip(starts, ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(work, "doc_id long, fp long")


def _remainder(values: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials by the generator: the syndrome of the code."""
    left = values.astype(np.int64).copy()
    for bit in range(BLOCK - 1, 10, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


@lru_cache(1)
def _errors() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By syndrome: the error patterns of weight up to 5, and by how much each exceeds the covering radius."""
    patterns = [sum(1 << b for b in bits) for w in range(RADIUS + DISTANCE + 1) for bits in combinations(range(BLOCK), w)]
    every = np.array(patterns, np.int64)
    excess = np.maximum(0, np.bitwise_count(every).astype(np.int64) - RADIUS)
    syndrome = _remainder(every)
    order = np.argsort(syndrome, kind="stable")
    cuts = np.searchsorted(syndrome[order], np.arange(1, 1 << 11))
    return np.split(every[order], cuts), np.split(excess[order], cuts)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home anchor and all anchors (home included) of each fingerprint."""
    errors, excess = _errors()
    unsigned = fps.view(np.uint64)
    mask = np.uint64((1 << BLOCK) - 1)
    high = (unsigned >> np.uint64(BLOCK) & mask).astype(np.int64)
    low = (unsigned & mask).astype(np.int64)
    homes, every = np.empty(len(fps), np.int64), []
    for i, (h, lo, a, b) in enumerate(zip(high, low, _remainder(high), _remainder(low), strict=True)):
        pairs = (h ^ errors[a])[:, None] << BLOCK | (lo ^ errors[b])[None, :]
        drift = excess[a][:, None] + excess[b][None, :]
        every.append(pairs[drift <= DISTANCE])
        homes[i] = pairs[drift == 0][0]
    return homes, every


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column ``fp``, distinct) at DISTANCE or fewer bits."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                some = values[at : at + 4096]
                homes, every = anchors(some)
                sizes = [len(e) for e in every]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(every)),
                        pa.array(np.repeat(some, sizes)),
                        pa.array(np.concatenate(every) == np.repeat(homes, sizes)),
                    ],
                    ["anchor", "fp", "home"],
                )

    placed = fps.mapInArrow(work, "anchor long, fp long, home boolean")
    residents = placed.filter("home").select("anchor", F.col("fp").alias("a"))
    guests = placed.select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return residents.join(guests, "anchor").filter((F.col("a") < F.col("b")) & near).select("a", "b")


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = settle(fingerprinted(docs, shingle))
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp")), "a", "b")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The row of each group with the smallest doc_id; same columns.

    Of several rows with that doc_id the first by text stays. A row without doc_id cannot be named as a copy of
    another and stays.
    """
    key, place = unused(docs, "_key"), unused(docs, "_place")
    kept = near_groups(docs, shingle).filter("doc_id = component_id").select(null_safe("doc_id").alias(key)).distinct()
    keyed = docs.withColumn(key, null_safe("doc_id"))
    nameless = docs.filter("doc_id is null")
    number = F.row_number().over(Window.partitionBy(key).orderBy("text"))
    named = keyed.filter("doc_id is not null").join(kept, key, "left_semi")
    return named.withColumn(place, number).filter(F.col(place) == 1).select(*docs.columns).unionByName(nameless)
