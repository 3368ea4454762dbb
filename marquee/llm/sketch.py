"""Document fingerprints by a threshold-scaled sketch (operator 6), in Spark expressions only.

Of the hashes of a text's five-word shingles, all below a fixed fraction of the hash range are kept. The rule looks
at one hash at a time, so a union of sketches is the sketch of the union, and the share of one sketch's hashes that
another holds estimates containment even between texts of very different length.

Defined results: null text counts as empty; a text of fewer than five words has one shingle, its whole word
sequence, and an empty text has none. If no hash lies below the threshold, the smallest stands in for them, so only
a text without words has an empty sketch. The likeness of two sketches is shared / all distinct hashes, 1 for two
empty ones. Repeated rows give repeated results, an empty table an empty result; other columns are carried along, a
column named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import WORD  # noqa: F401  (the word rule that WORD_GAP complements)

SHINGLE = 5
FRACTION = 0.25
WORD_GAP = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION) -> DataFrame:
    """Adds ``out``: the sorted distinct hashes of the sketch of column ``text``.

    Words are hashed once and shingles are hashes of five word hashes. The intermediate columns are separate
    projections and used several times, so Spark computes them once per row.
    """
    limit = int(-(2**63) + fraction * 2**64)
    words, hashes, shingles = f"_words_{out}", f"_hashes_{out}", f"_shingles_{out}"
    trimmed = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), lambda w: w != "")
    step = df.withColumn(words, trimmed)
    step = step.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    last = F.size(hashes) - SHINGLE + 1
    of_five = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(last, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(F.col(hashes), i + k) for k in range(1, SHINGLE)]),
    )
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    step = step.withColumn(
        shingles, F.when(last >= 1, of_five).when(F.size(hashes) > 0, whole).otherwise(F.array().cast("array<bigint>"))
    )
    kept = F.filter(shingles, lambda h: h < limit)
    smallest = F.filter(F.array(F.array_min(shingles)), lambda h: h.isNotNull())
    return step.withColumn(out, F.array_sort(F.array_distinct(F.when(F.exists(shingles, lambda h: h < limit), kept).otherwise(smallest)))).drop(
        words, hashes, shingles
    )


def likeness(a: str, b: str) -> Column:
    """Shared hashes by all hashes."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def containment(a: str, b: str) -> Column:
    """The share of ``a`` that ``b`` holds; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(groups: DataFrame, keys: list[str], sketch: str, fraction: float = FRACTION) -> DataFrame:
    """The sketch of all texts of a group, from their sketches."""
    limit = int(-(2**63) + fraction * 2**64)
    rows = groups.select(*keys, F.explode_outer(sketch).alias("_hash")).distinct()
    low = F.array_sort(F.collect_list(F.when(F.col("_hash") < limit, F.col("_hash"))))
    one = F.filter(F.array(F.min("_hash")), lambda h: h.isNotNull())
    return rows.groupBy(*keys).agg(low.alias("_low"), one.alias("_one")).select(
        *keys, F.when(F.size("_low") > 0, F.col("_low")).otherwise(F.col("_one")).alias(sketch)
    )


def hexadecimal(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, carried: list[str], rows_per_range: int = 2000) -> DataFrame:
    """Adds ``_next_<c>`` for each carried column: its value in the next row by doc_id (after the last: the first).

    Rows are dealt to ranges of doc_id; the bounds are quantiles of the ids, hence ids that occur. The first rows of
    a range are given to the range before it as guests, so each range finds its own answers. A null doc_id comes
    first; rows of one doc_id follow each other by text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.withColumn("_order", key)
    seen = rows.agg(F.count("*").alias("n"), F.min("_order").alias("first")).first()
    ranges = max(1, min(10_000, seen["n"] // rows_per_range))
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(rows.agg(F.percentile_approx("_order", shares, 100_000)).first()[0]) - {seen["first"]})
    else:
        bounds = []
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    held = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # Binary search for the number of bounds at or below the id.
    place = F.aggregate(
        F.array(*[F.lit(s) for s in steps]) if steps else F.array().cast("array<int>"),
        F.lit(0),
        lambda at, s: F.when(F.get(F.col("_bounds"), at + s - 1) <= F.col("_order"), at + s).otherwise(at),
    )
    at_bound = F.array_contains(F.col("_bounds"), F.col("_order")) if bounds else F.lit(False)
    first = F.col("_order") == F.lit(seen["first"])
    home = F.struct(F.col("_place").alias("range"), F.lit(0).alias("guest"))
    before = F.struct((F.col("_place") - 1).alias("range"), F.lit(1).alias("guest"))
    wrapped = F.struct(F.lit(len(bounds)).alias("range"), F.lit(2).alias("guest"))
    dealt = (
        rows.withColumn("_bounds", held)
        .withColumn("_place", place)
        .withColumn("_to", F.explode(F.when(first, F.array(home, wrapped)).when(at_bound, F.array(home, before)).otherwise(F.array(home))))
        .withColumn("_range", F.col("_to.range"))
        .withColumn("_guest", F.col("_to.guest"))
        .drop("_bounds", "_place", "_to")
    )
    order = Window.partitionBy("_range").orderBy("_guest", "_order", "text")
    return (
        dealt.withColumns({f"_next_{c}": F.lead(c).over(order) for c in carried})
        .filter(F.col("_guest") == 0)
        .drop("_order", "_range", "_guest")
    )


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """``docs`` with ``sketch``."""
    return with_sketch(docs, "text", "sketch", fraction)


def edited_likeness(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprint of every text, of its edited text and how alike they are.

    Edited: the last half of the code points (rounded down) is replaced by as many from the start of the next
    document. Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    held_in_edited (containment).
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = with_sketch(base, "text", "_own", fraction)
    paired = with_next(sketched, ["text", "_own"])
    half = F.floor(F.length("text") / 2).cast("int")
    changed = paired.withColumn(
        "_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next_text"), F.lit(1), half))
    )
    both = with_sketch(changed, "_edited", "_new", fraction)
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        hexadecimal("_own").alias("fingerprint"),
        hexadecimal("_new").alias("edited_fingerprint"),
        likeness("_own", "_new").alias("near_edited"),
        likeness("_own", "_next__own").alias("near_next"),
        containment("_own", "_new").alias("held_in_edited"),
    )
