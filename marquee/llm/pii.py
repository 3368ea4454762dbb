"""Personal data by candidate spans and boosted trees (operator 8), in Spark expressions only.

1. Four strict patterns with checks (address, IP, card, phone) give the base spans; they always stay.
2. Loose patterns, up to three per kind, propose many overlapping candidates (numbers within a longer run of
   numbers, a phone number without ``+``, an address written out in words, ...).
3. Each candidate gets yes/no features of its form and its surroundings. All candidates of the corpus are summed
   to one row per combination of features: how many there are and how many are base spans. That table has at
   most 2^features rows per kind, whatever the corpus.
4. Boosted trees learn from it whether a candidate of such form and surroundings is known: a base span, or one in
   another known way of writing (``is_known``). A fifth of the documents, by hash, is kept out and calibrates a
   threshold per kind: the lowest score at which the share of known ones is ``precision``.
5. Candidates at or above the threshold are added: known ones, and what looks and stands like them, such as a card
   number that the strict pattern ran together with a number beside it.

Everything is computed inside the row of the document: no join, no shuffle of texts. Positions are code points,
end exclusive. Patterns use possessive repeats that start only at the beginning of a run (or where the last match
ended), so a long run of letters or digits costs linear time and no stack.

Defined results: null text counts as empty (no spans); repeated rows give repeated results; an empty table gives
an empty result and learns nothing (base spans only). ``redact`` keeps all columns but the text and its length;
``spans_of`` carries other columns along, a column named like an added one is replaced. Time is linear in the length
of a text however many matches it has: texts are cut into blocks, and no piece is sought from a text's beginning.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"


def _run(chars: str) -> str:
    """A whole run of ``chars``, found at its start or where the last match ended."""
    return rf"(?:(?<![{chars}])|\G)[{chars}]++"


# The contract's patterns, written so that no position is tried twice.
BASE = {
    "email": rf"{_run(LOCAL)}@[{HOST}]++(?:\.[{HOST}]++)++",
    "ip": rf"{_run('0-9')}\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider nets.
LOOSE = {
    "email": [
        rf"{_run(LOCAL)}\x20?@\x20?[{HOST}]++(?:\x20?\.\x20?[{HOST}]++)*+",
        rf"{_run(LOCAL)}\x20?[\[(]\x20?at\x20?[\])]\x20?[{HOST}]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[{HOST}]++)*+",
    ],
    "ip": [r"(?:(?<![0-9])|\G)[0-9]++(?:\x20?[.:]\x20?[0-9]++){3,7}+"],
    "card": [
        r"(?:(?<![0-9])|\G)[0-9](?:[\x20./-]{0,2}[0-9]){11,}+",
        r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
        r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])",
    ],
    "phone": [r"(?:(?<![0-9])|\G)[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){8,}+"],
}
# What a text must contain for a pattern to be worth a scan.
HINT = {
    "email": r"@|[\[(]\x20?at",
    "ip": r"[0-9]\x20?[.:]\x20?[0-9]",
    "card": r"[0-9](?:[\x20./-]{0,2}[0-9]){11}",
    "phone": r"[0-9](?:[\x20()./-]{0,2}[0-9]){8}",
}
CONTEXT = 24
CUES = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|address|adresse|host|server)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|credit)",
    "phone": r"(?i)(?:tel|phone|call|fon|fax|mobile)",
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        parts = F.split(value, r"\.")
        small = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(small, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        number = digits(value)
        return F.length(number).between(13, 19) & luhn(F.substring(number, 1, 19))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


#: Code points of the blocks that a text is cut into, so that no piece is sought from the text's beginning.
BLOCK = 1024


def blocks(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(cut: Column, start: Column, size: Column) -> Column:
    """The code points [start, start + size) of a text in ``blocks``."""
    first = F.floor(start / BLOCK).cast("int")
    number = F.floor((start + size + BLOCK - 1) / BLOCK).cast("int") - first
    return F.substring(F.array_join(F.slice(cut, first + 1, F.greatest(number, F.lit(0))), ""), start % BLOCK + 1, size)


def matches(text: str, pattern: str, hint: str) -> Column:
    """Array of (start, end, value, before, after) of the leftmost matches of ``pattern`` in column ``text``.

    Matches and the pieces between them come from two scans with the same pattern; adding up their lengths gives
    the positions. Texts without the hint are not scanned. ``_blocks`` has the text in blocks.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    sizes = F.arrays_zip(
        F.transform(hits, F.length).alias("hit"), F.transform(F.slice(pieces, F.lit(1), F.size(hits)), F.length).alias("gap")
    )
    starts = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda state, p: F.struct(
            (state["at"] + p["gap"] + p["hit"]).alias("at"),
            F.concat(state["out"], F.array(state["at"] + p["gap"])).alias("out"),
        ),
        lambda state: state["out"],
    )
    # The blocks go along with each match: as a column, they might be made anew for each.
    cut = F.array_repeat(F.col("_blocks"), F.size(hits))

    def laid_out(p: Column) -> Column:
        start, end = p["start"], p["start"] + F.length(p["hit"])
        lead = F.least(start, F.lit(CONTEXT))
        return F.struct(
            start.alias("start"),
            end.alias("end"),
            p["hit"].alias("value"),
            piece(p["cut"], start - lead, lead).alias("before"),
            piece(p["cut"], end, F.lit(CONTEXT)).alias("after"),
        )

    laid = F.transform(F.arrays_zip(hits.alias("hit"), starts.alias("start"), cut.alias("cut")), laid_out)
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    found = F.col(text).rlike(hint) & F.col(text).rlike(pattern)
    return F.when(found, laid).otherwise(F.array()).cast(kind)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` (never null), ``_blocks`` and the arrays of base spans ``_email`` .. ``_phone``."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    worth = reduce(lambda a, b: a | b, [F.col("_text").rlike(h) for k in KINDS for h in (HINT[k], _base_hint(k))])
    out = out.withColumn("_blocks", F.when(worth, blocks("_text")))
    out = out.withColumns({f"_{k}": matches("_text", BASE[k], _base_hint(k)) for k in KINDS})
    return out.withColumns({f"_{k}": checked(k) for k in KINDS})


def checked(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda s: passes(kind, s["value"]))


def _base_hint(kind: str) -> str:
    return {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}[kind]


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds ``_more_email`` .. ``_more_phone``: the spans of the loose patterns."""
    return docs.withColumns(
        {
            f"_more_{k}": reduce(F.concat, [matches("_text", p, HINT[k]) for p in LOOSE[k]])
            for k in KINDS
        }
    )


def features(kind: str, span: Column) -> list[Column]:
    """Yes/no features of a candidate; at most twelve, so that all combinations fit a small table."""
    value, before, after = span["value"], span["before"], span["after"]
    number = digits(value)
    shape = {
        "email": [
            value.contains("@"),
            value.contains(" "),
            value.rlike(r"\.\x20?[A-Za-z]{2,}$"),
            value.rlike(r"^[A-Za-z0-9]"),
            F.length(value) <= 64,
            value.rlike(r"[\[(]\x20?dot"),
        ],
        "ip": [
            value.contains(" "),
            value.contains(":"),
            F.size(F.split(value, "[.:]")) == 4,
            value.rlike(r"(?:^|[.:\x20])[0-9]{4,}"),
            value.rlike(r"(?:^|[.:\x20])0[0-9]"),
        ],
        "card": [
            F.length(number).between(13, 19),
            F.length(number) == 16,
            value.rlike(r"^[0-9]+$"),
            value.rlike(r"^[0-9]{4}(?:[\x20-][0-9]{4}){2,}"),
            number.rlike("^[3-6]"),
            luhn(number),
        ],
        "phone": [
            value.startswith("+"),
            F.length(number).between(9, 15),
            value.rlike(r"^[0-9]+$"),
            value.rlike(r"\([0-9]+\)"),
            value.rlike(r"[0-9]{7,}"),
        ],
    }[kind]
    around = [
        before.rlike(r"[\p{L}0-9_]$"),
        after.rlike(r"^[\p{L}0-9_]"),
        before.rlike(r"[=:\"'#/\\.-]\s?$") & ~before.rlike(r"[\p{L}][.:]\s?$"),
        before.rlike(CUES[kind]),
    ]
    return [F.coalesce(f, F.lit(False)) for f in [*shape, *around]]


def code(kind: str, span: Column) -> Column:
    """The features as bits of one number."""
    return reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(features(kind, span))])


# What may not stand before or after a candidate that is a base span: a base match would go on there.
GOES_ON = {
    "email": (rf"[{LOCAL}]$", rf"^\.?[{HOST}]"),
    "ip": (r"[0-9]$", r"^[0-9]"),
    "card": (r"[0-9][\x20-]?$", r"^[\x20-]?[0-9]"),
    "phone": (r"\+[\x20().0-9-]*$", r"^[\x20().-]*[0-9]"),
}


def is_base(kind: str, span: Column) -> Column:
    """Whether a candidate is a base span, from its value and surroundings alone (so in constant time)."""
    value, (before, after) = span["value"], GOES_ON[kind]
    whole = value.rlike(rf"^(?:{BASE[kind]})$") & passes(kind, value)
    return whole & ~span["before"].rlike(before) & ~span["after"].rlike(after)


def is_known(kind: str, span: Column) -> Column:
    """What a candidate is learned from: it is a base span, or becomes one by a known way of writing.

    An address with its signs in words, sixteen digits in fours with a right check digit whatever stands between them,
    or a grouped number that is announced as a telephone number.
    """
    value = span["value"]
    number = digits(value)
    if kind == "email":
        signs = F.regexp_replace(value, r"\x20?[\[(]\x20?at\x20?[\])]\x20?", "@")
        signs = F.regexp_replace(signs, r"\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?", ".")
        other = ~value.contains("@") & signs.rlike(rf"^[{LOCAL}]+@[{HOST}]+(?:\.[{HOST}]+)*\.[A-Za-z]{{2,}}$")
    elif kind == "card":
        other = value.rlike(r"^[0-9]{4}(?:[\x20./-]{1,2}[0-9]{4}){3}$") & luhn(number)
    elif kind == "phone":
        grouped = value.rlike(r"[0-9][\x20()./-]+[0-9]+[\x20()./-]+[0-9]")
        other = grouped & F.length(number).between(10, 15) & span["before"].rlike(CUES["phone"])
    else:
        other = F.lit(False)
    return F.coalesce(is_base(kind, span) | other, F.lit(False))


def combinations(rows: DataFrame) -> DataFrame:
    """How many candidates of the corpus, and how many known ones, have each combination of features."""
    held = F.pmod(F.xxhash64("_text"), F.lit(5)) == 0

    def coded(kind: str) -> Column:
        return F.transform(
            f"_more_{kind}",
            lambda s: F.struct(
                F.lit(kind).alias("kind"), code(kind, s).alias("code"), is_known(kind, s).alias("hit")
            ),
        )

    every = F.concat(*[coded(k) for k in KINDS])
    return (
        rows.select(F.inline(every), held.alias("held"))
        .groupBy("kind", "code", "held")
        .agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    )


# ---- boosted trees over the table of combinations: at most 2^10 rows per kind, so a plain loop on the driver

ROUNDS, DEPTH, RATE, SMOOTH = 40, 3, 0.3, 1.0
N_FEATURES = 10


def _leaf(rows: list[tuple[int, float, float, float]]) -> float:
    gradient = sum(hits - n * p for _, n, hits, p in rows)
    curvature = sum(n * p * (1 - p) for _, n, _, p in rows)
    return RATE * gradient / (curvature + SMOOTH)


def _gain(rows: list) -> float:
    gradient = sum(hits - n * p for _, n, hits, p in rows)
    return gradient * gradient / (sum(n * p * (1 - p) for _, n, _, p in rows) + SMOOTH)


def _tree(rows: list, depth: int) -> tuple | float:
    best, at = _gain(rows) + 1e-9, None
    for feature in range(N_FEATURES) if depth else ():
        on = [r for r in rows if r[0] >> feature & 1]
        off = [r for r in rows if not r[0] >> feature & 1]
        if on and off and (gain := _gain(on) + _gain(off)) > best:
            best, at = gain, (feature, on, off)
    if at is None:
        return _leaf(rows)
    return at[0], _tree(at[1], depth - 1), _tree(at[2], depth - 1)


def _value(tree: tuple | float, bits: int) -> float:
    while isinstance(tree, tuple):
        tree = tree[1] if bits >> tree[0] & 1 else tree[2]
    return tree


def boost(table: list[tuple[int, float, float]]) -> dict[int, float]:
    """Probability of a base span by combination of features, from (code, n, hits) rows."""
    score = {c: 0.0 for c, _, _ in table}
    for _ in range(ROUNDS):
        rows = [(c, n, hits, 1 / (1 + math.exp(-score[c]))) for c, n, hits in table]
        tree = _tree(rows, DEPTH)
        for c in score:
            score[c] += _value(tree, c)
    return {c: 1 / (1 + math.exp(-s)) for c, s in score.items()}


def fit(table: list, precision: float, support: int) -> dict[str, list[int]]:
    """The combinations to redact, by kind.

    Trees are fitted on the rows that are not held out and score every combination. From the best score down, the
    held-out candidates are counted; the lowest score at which at least ``precision`` of them are base spans is the
    threshold. Without ``support`` held-out candidates above any score, nothing is added.
    """
    chosen = {}
    for kind in KINDS:
        rows = [r for r in table if r["kind"] == kind]
        train = [(r["code"], r["n"], r["hits"]) for r in rows if not r["held"]]
        if not train:
            continue
        scores = boost(train)
        seen, n, hits, threshold = sorted((r for r in rows if r["held"] and r["code"] in scores), key=lambda r: -scores[r["code"]]), 0, 0, None
        for i, r in enumerate(seen):
            n, hits = n + r["n"], hits + r["hits"]
            last = i + 1 == len(seen) or scores[seen[i + 1]["code"]] < scores[r["code"]]
            if last and n >= support and hits >= precision * n:
                threshold = scores[r["code"]]
        if threshold is not None:
            chosen[kind] = sorted(c for c, s in scores.items() if s >= threshold)
    return chosen


def spans_of(docs: DataFrame, precision: float = 0.9, support: int = 20) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end), by kind as in KINDS, then start, then end."""
    rows = with_candidates(with_base(docs))
    chosen = fit(settle(combinations(rows)).collect(), precision, support)

    def triples(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = {k: triples(k, F.col(f"_{k}")) for k in KINDS}
    every = dict(base)

    def picked(kind: str, codes: list[int]) -> Column:
        return F.filter(f"_more_{kind}", lambda s: code(kind, s).isin(codes))

    for k, codes in chosen.items():
        found = F.array_sort(F.concat(base[k], triples(k, picked(k, codes))))
        before = F.concat(F.array(F.lit(None)), F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))))
        every[k] = F.array_compact(F.zip_with(found, before, lambda s, b: F.when(~s.eqNullSafe(b), s)))
    return rows.withColumn("base", F.concat(*base.values())).withColumn("spans", F.concat(*[every[k] for k in KINDS])).select(
        *[c for c in docs.columns if c not in {"base", "spans"}], "base", "spans"
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: str) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one. Same columns.

    ``n_chars``, where there is such a column, becomes the length of the new text. Rows without spans stay as they
    are, a null text too.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    found = spans_of(rows, **options)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # One pass over the sorted spans: those that begin a gap, with where the gap before them begins.
    merged = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<since:int,start:int,kind:string>>").alias("out")),
        lambda state, s: F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= state["at"],
                F.concat(state["out"], F.array(F.struct(state["at"].alias("since"), s["start"].alias("start"), s["kind"].alias("kind")))),
            ).otherwise(state["out"]).alias("out"),
        ),
    )
    found = found.withColumn("_merged", F.when(F.size("spans") > 0, merged)).withColumn(
        "_blocks", F.when(F.size("spans") > 0, blocks("text"))
    )
    gaps = F.arrays_zip(F.col("_merged.out").alias("gap"), F.array_repeat(F.col("_blocks"), F.size("_merged.out")).alias("cut"))
    kept = F.transform(
        gaps,
        lambda s: F.concat(
            piece(s["cut"], s["gap"]["since"], s["gap"]["start"] - s["gap"]["since"]), F.lit("["), F.upper(s["gap"]["kind"]), F.lit("]")
        ),
    )
    last = piece(F.col("_blocks"), F.col("_merged.at"), F.greatest(F.length("text") - F.col("_merged.at"), F.lit(0)))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(kept, ""), last)).otherwise(F.col("text"))
    found = found.withColumn("_clean", clean)
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_clean").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
