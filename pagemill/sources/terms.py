"""Run parameters as tables: search terms, caps and search requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.functions.urls import search_url


def split_terms(terms: Column) -> Column:
    """Comma-separated terms, trimmed; empty ones are kept."""
    return F.transform(F.split(strip(terms), ","), strip)


def item_cap(text: Column) -> Column:
    """S3: blank or 0 means no cap (null); see :func:`unreadable_cap` for what is no number."""
    return F.nullif(strip(text).try_cast("int"), F.lit(0))


def unreadable_cap(text: Column) -> Column:
    """S3: a cap that is neither blank nor a whole number; such a request is refused, not run without a cap."""
    return ~F.coalesce(strip(text), F.lit("")).rlike(r"^([+-]?[0-9]{1,9})?$")


def refused_requests(requests: DataFrame) -> DataFrame:
    """Requests with an unreadable cap, with the reason."""
    return requests.where(unreadable_cap(F.col("max_items"))).withColumn(
        "reason", F.concat(F.lit("unreadable item cap: "), F.col("max_items")))


def search_terms(requests: DataFrame) -> DataFrame:
    """(market, terms, max_items) texts -> one row per term with its place and cap.

    Requests whose cap cannot be read are left to :func:`refused_requests`.
    """
    return requests.where(~unreadable_cap(F.col("max_items"))).select(
        "market", F.posexplode(split_terms(F.col("terms"))).alias("term_no", "search_term"),
        item_cap(F.col("max_items")).alias("max_items"))


def search_requests(terms: DataFrame, pages: Column) -> DataFrame:
    """One row per search page to capture (``terms`` with ``base_url``)."""
    return terms.select(
        "market", "search_term", "base_url",
        F.explode(F.sequence(F.lit(1), pages)).alias("page_num"),
    ).select("market", "search_term", "page_num",
             search_url(F.col("base_url"), F.col("search_term"), F.col("page_num")).alias("url"))
