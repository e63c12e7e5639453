"""Search and listing addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: listings asked for per search page.
PAGE_SIZE = 240


def quote_plus(x: Column) -> Column:
    """C17: form encoding that keeps '~' and escapes '*'."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")),
                     F.lit("*"), F.lit("%2A"))


def search_url(base: Column, term: Column, page_num: Column) -> Column:
    """S4"""
    return F.concat(base, F.lit("/sch/i.html?_nkw="), quote_plus(term),
                    F.lit("&_pgn="), page_num.cast("string"), F.lit(f"&_ipg={PAGE_SIZE}"))


def is_listing_link(href: Column) -> Column:
    """P8"""
    return F.contains(F.coalesce(href, F.lit("")), F.lit("itm/"))


def item_id(href: Column) -> Column:
    """The part after the first 'itm/', cut at the next one and at '?'."""
    return F.substring_index(F.split_part(href, F.lit("itm/"), F.lit(2)), "?", 1)


def listing_url(base: Column, item: Column) -> Column:
    """C19"""
    return F.concat(base, F.lit("/itm/"), item)


def site_of(search: Column) -> Column:
    """C20: the part of a search address before '/sch'."""
    return F.substring_index(search, "/sch", 1)
