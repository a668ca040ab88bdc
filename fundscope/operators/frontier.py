"""Crawl-frontier operators over already-fetched listing pages (RL-2, RL-3).

RL-2 keeps the first sighting of every URL across sources: a per-URL ``min(struct(rank, page, pos))``
aggregate, so hot navigation links are pre-aggregated per task (partial aggregation) instead of
being sorted whole in one window partition.

RL-3 reproduces "walk the pages of a source in order, stop at the first page with no new links": a
page has new links iff it is the first page of some link of its source. First pages and the stop page
are minima, so everything is pre-aggregated per task, whatever one source's share of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANG_ORDER = ["en", "fr", "de", "es"]


def lang_of(url: Column) -> Column:
    """Source of a driver page: the language segment of its path ('' when absent)."""
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/([a-z]{2})/", 1)


def source_rank(source: Column, order=LANG_ORDER) -> Column:
    r = F.array_position(F.array(*[F.lit(x) for x in order]), source)
    return F.when(r > 0, r - 1).otherwise(F.lit(len(order))).cast("int")


def frontier_dedup(links: DataFrame, order=LANG_ORDER) -> DataFrame:
    """RL-2: links (page_id, link, pos, source) -> the first sighting per link, ordered by
    (source rank, page, position)."""
    first = links.groupBy("link").agg(
        F.min(F.struct(source_rank(F.col("source"), order).alias("r"), F.col("page_id"), F.col("pos"),
                       F.col("source"))).alias("f"))
    return first.select("link", F.col("f.source").alias("source"), F.col("f.page_id").alias("page_id"),
                        F.col("f.pos").alias("pos"))


def pagination_cut(listing: DataFrame, links: DataFrame) -> DataFrame:
    """RL-3: listing (page_id, source) with links (page_id, link) -> links first seen on a processed page
    (source, link, page_id). Pages go by page_id within their source; processing stops at the first page
    without a new link (a linkless page included)."""
    pages = listing.select("page_id", "source")
    first = (links.select("page_id", "link").join(pages, "page_id").groupBy("source", "link")
             .agg(F.min("page_id").alias("page_id")))
    stop = (pages.join(first.select("source", "page_id"), ["source", "page_id"], "left_anti")
            .groupBy("source").agg(F.min("page_id").alias("_stop")))
    kept = first.join(stop, "source", "left").filter(F.col("_stop").isNull() | (F.col("page_id") < F.col("_stop")))
    return kept.select("source", "link", "page_id")
