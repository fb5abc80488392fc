"""Pages to link edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.wiki import is_article


def hrefs(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per anchor of pages (html, ...): the columns in keep and href (undecoded, unquoted)."""
    rows = pages.select(*keep, F.explode(H.raw_hrefs(F.col("html"))).alias("__raw"))
    return rows.select(*keep, H.unquoted(F.col("__raw")).alias("href"))


def pages_to_edges(pages: DataFrame, include_internal: bool = False, articles_only: bool = False, max_pages: int | None = None, order: str = "url", unicode: bool = True, once: bool = False) -> DataFrame:
    """source, target of each page of pages (url, html), each pair of a page once, or with `once` each pair of all pages: several
    URLs may have one canonical form.

    Self-links go, and links within a site unless include_internal; articles_only keeps targets that are articles.
    max_pages keeps the first pages with links, in order of the column `order`. Pages with unusable URLs or without
    surviving links give nothing. The scan reads url and html alone.
    """
    pages = pages.select(*dict.fromkeys(["url", "html", order]), U.parse_base(F.col("url")).alias("__page"))
    pages = U.with_resolved(pages, "source", F.col("url"), None, unicode)
    pages = U.with_resolved(pages, "__declared", H.base_href(F.col("html")), F.col("__page"), unicode)
    raw = F.explode(F.array_distinct(H.raw_hrefs(F.col("html")))).alias("__raw")
    links = pages.where("source is not null").select(order, "source", F.coalesce("__declared", "__page").alias("__from"), raw)
    links = U.with_resolved(links, "target", H.decode_entities(H.unquoted(F.col("__raw"))), F.col("__from"), unicode)
    links = links.where("target is not null and source <> target")
    if not include_internal:
        links = external_only(links)
    if articles_only:
        links = articles(links)
    if max_pages is not None:
        first = links.select(order, "source").distinct().orderBy(order, "source").limit(max(1, max_pages))
        links = links.join(first, [order, "source"], "left_semi")
    return links.select(*dict.fromkeys([*([] if once else [order]), "source", "target"])).distinct().select("source", "target")


def external_only(edges: DataFrame) -> DataFrame:
    """Edges between different sites."""
    return edges.where(~U.same_site(U.host_of(F.col("source")), U.host_of(F.col("target"))))


def articles(edges: DataFrame) -> DataFrame:
    """Edges to articles."""
    return edges.where(is_article(F.col("target")))
