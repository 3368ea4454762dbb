"""Expressions for catalog fields: rank, display text, values cut out of URLs and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.constants import (
    DISPLAY_SEPARATOR,
    DURATION_PATTERN,
    NO_TRAILER_PENALTY,
    REVIEW_FACTOR,
    SCORE_FACTOR,
    TRAILER_ANY_PATTERN,
    TRAILER_HD_PATTERN,
    UNKNOWN_DATE,
)


def _float(value: float) -> Column:
    return F.lit(value).cast("float")


# --- catalog derivation -------------------------------------------------------------------


def known_date(date: Column) -> Column:
    return F.when(date == "", F.lit(UNKNOWN_DATE)).otherwise(date)


def local_cover(raw_rank: Column) -> Column:
    return F.concat(F.lit("/"), raw_rank.try_cast("int").cast("string"), F.lit(".jpg"))


def popularity(
    raw_rank: Column, trailer: Column, reviews: Column, score: Column
) -> Column:
    """Popularity in single precision, truncated; unknown values are -1 and count as such.

    Every literal is a float: a wider one would move the whole sum to double precision.
    """
    penalty = F.when(trailer == "", _float(NO_TRAILER_PENALTY)).otherwise(_float(0))
    rank = raw_rank - penalty + reviews * _float(REVIEW_FACTOR) + score * _float(SCORE_FACTOR)
    return rank.try_cast("int")


def without_first_character(values: Column) -> Column:
    return F.transform(values, lambda v: F.substring(v, F.lit(2), F.length(v)))


def without_nulls(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


# --- display ------------------------------------------------------------------------------


def number_text(value: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def score_text(score: Column) -> Column:
    tenths = F.floor(score.cast("double") * 10 + 0.5) / 10
    return F.when(score == -1, F.lit("?")).otherwise(number_text(tenths))


def review_count(reviews: Column) -> Column:
    return F.when(reviews == -1, _float(0)).otherwise(reviews)


def duration_genre_date(hours: Column, minutes: Column, genre: Column, date: Column) -> Column:
    duration = F.concat(number_text(hours), F.lit("h "), number_text(minutes), F.lit(" min"))
    return F.concat_ws(
        DISPLAY_SEPARATOR,
        F.when(hours != -1, duration),
        F.when(F.size(genre) > 0, F.array_join(genre, ", ")),
        date,
    )


def director_date(director: Column, date: Column) -> Column:
    return F.concat(director, F.lit(" ("), date, F.lit(")"))


# --- pages --------------------------------------------------------------------------------


def first_number(url: Column) -> Column:
    """The first run of digits, -1 where there is none."""
    digits = F.nullif(F.regexp_extract(url, r"(\d+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("float"), _float(-1))


def duration_part(html: Column, part: int) -> Column:
    """Hours (1) or minutes (2) of the first duration on a page; null where there is none."""
    digits = F.nullif(F.regexp_extract(html, DURATION_PATTERN, part), F.lit(""))
    return digits.try_cast("float")


def number_or_null(text: Column, decimal_comma: bool = False) -> Column:
    value = F.replace(text, F.lit(","), F.lit(".")) if decimal_comma else text
    return value.try_cast("float")


def stripslashes(text: Column) -> Column:
    """Escaped line ends become line ends, every other backslash goes."""
    return F.replace(F.regexp_replace(text, r"\\[nr]", "\n"), F.lit("\\"), F.lit(""))


def trailer_file(html: Column) -> Column:
    """The first HD video on a trailer page, else the first other one; null without any."""
    hd = F.nullif(F.regexp_extract(html, TRAILER_HD_PATTERN, 1), F.lit(""))
    other = F.nullif(F.regexp_extract(html, TRAILER_ANY_PATTERN, 1), F.lit(""))
    found = F.concat(F.lit("http:"), stripslashes(F.coalesce(hd, other)))
    return F.when(F.contains(html, F.lit(".mp4")), found)  # most pages skip the patterns


def unescape_attribute(text: Column) -> Column:
    for entity, character in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def anchor_links(html: Column, css_class: str | None = None) -> Column:
    """``href`` values of the anchors on a page in page order, optionally of one class."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?i)(<a\s[^>]*>)"), F.lit(1))
    if css_class is not None:
        of_class = rf'(?i)\sclass\s*=\s*["\'](?:[^"\']*\s)?{css_class}(?:\s[^"\']*)?["\']'
        anchors = F.filter(anchors, lambda a: F.regexp_like(a, F.lit(of_class)))
    href = r'(?i)\shref\s*=\s*["\']([^"\']*)["\']'
    anchors = F.filter(anchors, lambda a: F.regexp_like(a, F.lit(href)))
    return F.transform(anchors, lambda a: unescape_attribute(F.regexp_extract(a, href, 1)))
