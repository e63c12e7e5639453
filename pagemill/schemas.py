"""Explicit schemas; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# The product record, in output order.
TEXT_FIELDS = ["title", "subtitle", "current_price", "was_price", "discount",
               "availability", "sold_count", "shipping", "location", "returns",
               "condition", "brand", "type"]
PRODUCT_FIELDS = ["url", *TEXT_FIELDS, "store_info"]

STORE_INFO = T.StructType([
    T.StructField(name, T.StringType(), False) for name in ("name", "feedback", "sales")])

PRODUCT = T.StructType(
    [T.StructField("url", T.StringType(), False)]
    + [T.StructField(name, T.StringType()) for name in TEXT_FIELDS]
    + [T.StructField("store_info", STORE_INFO)])

CAPTURE = T.StructType([
    T.StructField("market", T.StringType()),
    T.StructField("search_term", T.StringType()),
    T.StructField("page_type", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
])

# The envelope as stored; lean writers fill only ``products``.
ENVELOPE = T.StructType([
    T.StructField("products", T.ArrayType(PRODUCT)),
    T.StructField("total_products", T.LongType()),
    T.StructField("requested_items", T.LongType()),
    T.StructField("actual_items_found", T.LongType()),
    T.StructField("last_updated", T.StringType()),
])
