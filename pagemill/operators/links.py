"""Search pages: listing links, next-page state and page reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.functions.markup import attribute, flat_attribute
from pagemill.functions.select import has_class
from pagemill.operators.sequence import ROWS_PER_SLICE, hot_join, spread_join

PAGE_KEY = ["market", "search_term", "page_num"]


def _tags(tag: str) -> Column:
    return F.filter(F.col("els"), lambda e: e["tag"] == tag)


def _value(flat: bool):
    """How an attribute of an element is read."""
    return flat_attribute if flat else (lambda e, name: attribute(e["attrs"], name))


def listing_hrefs(flat: bool = False) -> Column:
    """Addresses of the listing links of a parsed page, in document order."""
    value = _value(flat)
    links = F.filter(F.col("els"), has_class("s-item__link", "a"))
    return F.filter(F.transform(links, lambda t: value(t, "href")), U.is_listing_link)


def next_page_flags(flat: bool = False) -> Column:
    """struct(link, href, button, disabled) from the first next-link and next-button."""
    value = _value(flat)

    def nexts(tag: str) -> Column:
        return F.get(F.filter(_tags(tag), lambda t: F.coalesce(value(t, "type"), F.lit("")) == "next"), F.lit(0))

    link, button = nexts("a"), nexts("button")
    return F.struct(
        link.isNotNull().alias("link"),
        (F.coalesce(value(link, "href"), F.lit("")) != "").alias("href"),
        button.isNotNull().alias("button"),
        (F.coalesce(value(button, "aria-disabled"), F.lit("")) == "true").alias("disabled"))


def has_next(flags: Column, rule: Column) -> Column:
    """The market's decision from the flags."""
    link, href, button, disabled = (flags[n] for n in ("link", "href", "button", "disabled"))
    return (
        F.when(rule == "href_or_open_button", href | ~disabled)
        .when(rule == "button_then_href", ~disabled & href)
        .when(rule == "link_or_open_button", link | (button & ~disabled))
        .when(rule == "link", link)
        .otherwise(href | (~disabled & link)))


def page_facts(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per search page: its links (array), their number and the next-page state; ``keep`` are kept too.

    The elements of ``parsed`` are whole or flat ones; flat ones are read several times as fast.
    """
    keep = keep or []
    flat = "_href" in parsed.schema["els"].dataType.elementType.names
    return parsed.select(
        *PAGE_KEY, "base_url", "captured_at", "next_page_rule", *keep,
        listing_hrefs(flat).alias("hrefs"), next_page_flags(flat).alias("flags"),
    ).select(
        *PAGE_KEY, "base_url", "captured_at", *keep, "hrefs",
        F.size("hrefs").cast("bigint").alias("n_links"),
        has_next(F.col("flags"), F.col("next_page_rule")).alias("has_next"))


def search_links(facts: DataFrame) -> DataFrame:
    """One row per listing link with its 0-based place on the page.

    An inner explode would test the links' array in filters of its own, each of which finds the links again.
    """
    item = U.item_id(F.col("href"))
    return (facts.select(*PAGE_KEY, "base_url", "captured_at",
                         F.posexplode_outer("hrefs").alias("pos", "href"))
            .where("pos is not null").select(*PAGE_KEY, "pos", "captured_at", item.alias("item_id"),
                    U.listing_url(F.col("base_url"), item).alias("url")))


def page_limit(pages: DataFrame) -> DataFrame:
    """Per term, the last page that is read.

    Paging stops at the first page with no next page or no links, and at the
    first hole in the page numbers.  Each rule is a per-term minimum over pages,
    so one term's pages are never gathered.
    """
    term = ["market", "search_term"]
    pages = pages.select(*PAGE_KEY, "has_next", "n_links")
    stops = (pages.where(~(F.col("has_next") & (F.col("n_links") > 0)))
             .groupBy(*term).agg(F.min("page_num").alias("stop")))
    starts = (pages.select(*PAGE_KEY)
              .join(pages.select(*term, (F.col("page_num") + 1).alias("page_num")),
                    PAGE_KEY, "left_anti")
              .groupBy(*term)
              .agg(F.min(F.when(F.col("page_num") > 1, F.col("page_num") - 1)).alias("stop"),
                   F.max(F.col("page_num") == 1).alias("_first")))
    holes = starts.select(*term, F.when(F.col("_first"), F.col("stop")).otherwise(0).alias("stop"))
    ends = pages.groupBy(*term).agg(F.max("page_num").alias("stop"))
    return (stops.unionByName(holes).unionByName(ends)
            .groupBy(*term).agg(F.min("stop").alias("last_page")))


def reached_pages(pages: DataFrame) -> DataFrame:
    """The pages of each term that paging gets to."""
    return (spread_join(pages, page_limit(pages), ["market", "search_term"], F.col("page_num"))
            .where(F.col("page_num") <= F.col("last_page")).drop("last_page"))


def unseen(links: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``seen``; copies in ``seen`` are combined first."""
    return links.join(seen.select(*keys).distinct(), keys, "left_anti")


def link_products(links: DataFrame, products: DataFrame, how: str = "inner",
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Links (a staged table) with the product read at their address.

    ``products`` holds one row per (market, url).  A popular listing may be linked
    from anywhere, so the links of such a listing are split over several tasks.
    """
    return hot_join(links, products, ["market", "url"],
                    F.concat_ws("|", "search_term", "page_num", "pos"), how, rows_per_slice)
