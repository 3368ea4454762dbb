"""Text expressions: normalising, tokens and substrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.constants import (
    ASCII_LOWER,
    ASCII_PUNCTUATION,
    ASCII_SPACE,
    ASCII_UPPER,
    STOP_WORDS,
)

def stem(text: Column) -> Column:
    """ASCII lower case, no ASCII punctuation, trimmed, runs of spaces made one.

    ``translate`` leaves accented letters alone, where ``lower`` would not.
    """
    letters = F.translate(text, ASCII_UPPER + ASCII_PUNCTUATION, ASCII_LOWER)
    return F.regexp_replace(F.trim(letters, F.lit(ASCII_SPACE)), " +", " ")


def tokens(text: Column) -> Column:
    """The words of a text, split on runs of ASCII white space."""
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda word: word != "")


def content_words(text: Column) -> Column:
    """The words of a text without stop words; repeated words stay repeated."""
    return F.filter(tokens(text), lambda word: ~word.isin(STOP_WORDS))


def substrings(text: Column, length: Column) -> Column:
    """The distinct substrings of one length; empty where the text is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    pieces = F.transform(starts, lambda at: F.substring(text, at, length))
    return F.when(F.length(text) >= length, F.array_distinct(pieces)).otherwise(
        F.array().cast("array<string>")
    )


def substring_lengths(text: Column, longest: int | None = None) -> Column:
    """1..n for a text of n characters (at most ``longest``); empty for an empty text."""
    top = F.length(text) if longest is None else F.least(F.length(text), F.lit(longest))
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), top)).otherwise(
        F.array().cast("array<int>")
    )
