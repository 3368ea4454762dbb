"""Mixing sources to target weights with hash thresholds (operator 9).

Each source gets a target number of words. All documents of a source are taken ``floor(target / size)`` times;
for the rest a threshold on a document's hash decides. The threshold comes from histograms: words summed by
source and hash bucket give the bucket in which the running sum passes the rest; only the rows of that bucket
are split into finer buckets, until the bucket is one hash value. Nothing is sorted but histogram rows, and a
document is then taken by comparing its own hash.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, last
in order; equal rows hash alike and are decided together; an empty table gives an empty result; other columns
are carried along, and a column named like an added one is replaced; names with a leading ``_`` are ours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import WORD, known, null_safe, settle

HASH_BITS = 60
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id, so that any engine can repeat the decision."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with its size and the two columns by which it is decided."""
    return docs.withColumns(
        {"size": word_count(F.col("text")), "_source": null_safe("source"), "_hash": hash_of(F.col("doc_id"))}
    )


def targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source: source_size and target.

    Sources by code point, null last, weigh ``weights`` in turn. Together they get ``share`` times all words, but
    none more than ``most`` times its own; what is cut off goes to the others by weight. With sources ordered by
    limit per weight the capped ones come first, so running sums give the final level without iterating.
    """
    per_source = sizes.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn(
        "weight", F.get(cycle, (F.row_number().over(by_name) - 1) % F.lit(len(weights)))
    ).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = ranked.select(
        "*",
        F.row_number().over(by_limit).alias("place"),
        (
            (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / F.sum("weight").over(rest)
        ).alias("level"),
    )
    free = F.col("level") * F.col("weight") <= F.col("limit")
    final = F.min_by(F.when(free, F.col("level")), F.when(free, F.col("place"))).over(whole)
    target = F.least(F.col("limit"), F.coalesce(final * F.col("weight"), F.col("limit")))
    return levels.select("_source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds to each source how often all are taken (``copies``) and below which hash once more (``cut``).

    The document at the boundary itself is taken when that brings the source closer to its target (``at_cut``).
    """
    state = settle(
        goals.withColumn(
            "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        ).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    found = state.select("_source", "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        rows = sizes.select(
            "_source",
            "size",
            F.shiftright("_hash", shift + LEVEL_BITS).alias("prefix"),
            F.shiftright("_hash", shift).alias("bucket"),
        )
        # The rows are summed before they meet the table of sources, whose size is not known.
        if level > 1:
            rows = rows.join(found.select("_source", "prefix"), ["_source", "prefix"], "left_semi")
        sums = rows.groupBy("_source", "prefix", "bucket").agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("_source").orderBy("bucket"))
        passed = (
            sums.withColumn("upto", running)
            .join(found.select("_source", "rest"), "_source")
            .filter(F.col("upto") > F.col("rest"))
            .groupBy("_source", "rest")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("hit"))
        )
        found = settle(
            passed.select(
                "_source",
                (F.col("rest") - F.col("hit.before")).alias("rest"),
                F.col("hit.bucket").alias("prefix"),
                F.col("hit.words").alias("words"),
            )
        )
    at_cut = F.coalesce(F.col("left") * 2 >= F.col("words"), F.lit(False))
    return state.join(
        found.select("_source", F.col("prefix").alias("cut"), F.col("rest").alias("left"), "words"), "_source", "left"
    ).select("_source", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).alias("cut"), at_cut.alias("at_cut"))


def take(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` (of ``measured``) with source_size, target, n_copies and taken."""
    renamed = state.withColumnsRenamed({c: f"_{c}" for c in ("copies", "cut", "at_cut")})
    chosen = (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & F.col("_at_cut"))
    copies = F.when(F.col("size") > 0, F.col("_copies") + F.when(chosen, 1).otherwise(0)).otherwise(0).cast("long")
    added = ["source_size", "target", "n_copies", "taken"]
    return (
        rows.drop(*added)
        .join(known(renamed, state.count()), "_source")
        .withColumn("n_copies", copies)
        .withColumn("taken", F.col("size") * F.col("n_copies"))
        .select(*[c for c in rows.columns if c not in {"_source", "_hash", *added}], *added)
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target, n_copies (0, 1 or 2) and taken."""
    sizes = settle(measured(docs).select("doc_id", "source", "size", "_source", "_hash"))
    state = settle(thresholds(sizes, targets(sizes, weights, share, most)))
    if set(docs.columns) <= {"doc_id", "source"} | {"text"}:
        return take(sizes, state)
    return take(measured(docs), state)


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, same columns with the values they had."""
    carried = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("n_copies").cast("int")))
    return mix(carried, **options).withColumn("_copy", copies).select("_row.*")
