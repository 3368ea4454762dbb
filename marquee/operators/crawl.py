"""From listing pages to film pages to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.constants import LISTING_LINK_CLASS
from marquee.functions import fields
from marquee.operators.extract import extract_pages
from marquee.operators.skew import repeat_rows
from marquee.sources.archive import StoredArchive, fetch


def page_links(
    pages: DataFrame, css_class: str | None = LISTING_LINK_CLASS, prefix: str = ""
) -> DataFrame:
    """One row per link on a page, in page order; pages that were not fetched have none."""
    links = fields.anchor_links(F.col("html"), css_class)
    exploded = pages.withColumn("_links", links).drop("html", "url")
    return exploded.select(
        *[c for c in exploded.columns if c != "_links"], F.posexplode("_links").alias("place", "link")
    ).withColumn("url", F.concat(F.lit(prefix), F.col("link"))).drop("link")


def crawl(seeds: DataFrame, archive: DataFrame | StoredArchive, site: str) -> DataFrame:
    """Extracted film pages of all links on the listing pages, one row per link.

    A film is read once however many links lead to it, and repeated afterwards.
    """
    links = page_links(fetch(seeds, archive), prefix=site)
    films = links.groupBy("url").agg(F.count("*").alias("links"))
    return repeat_rows(extract_pages(fetch(films, archive), archive, site), "links")


def listing_events(listings: DataFrame, ts) -> DataFrame:
    """One event per listing page that was fetched."""
    read = listings.filter(F.col("html").isNotNull())
    return read.select(ts.alias("ts"), F.lit("DIRECTORIES").alias("tag"))
