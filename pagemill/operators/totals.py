"""Running totals of the store from mergeable exact bitmaps (A2, A3).

A batch leaves, for each key and each run of 32,768 item numbers it touches, the number of its rows and a bitmap of its items.
Totals add the numbers and join the bitmaps, so no stored row is read again and an item of several batches counts once.  A
bitmap takes 4 KB in memory, whatever it holds; numbers without neighbours make many nearly empty ones, which compress well in
files but not in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_totals(products: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """(keys, part, rows, bits): combined on the map side, and a hot key is spread over its parts.

    ``item`` is a number of 0 or more; where it is null or negative the row counts, its address does not (part is null).
    """
    number = F.when(item >= 0, item.cast("bigint"))
    return (products.select(*keys, F.bitmap_bucket_number(number).alias("part"), F.bitmap_bit_position(number).alias("_at"))
            .groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg("_at").alias("bits")))


def add_batch(products: DataFrame, path: str, batch_id: int, keys: list[str], item: Column) -> None:
    """Keep the totals of one batch; the same batch again replaces them."""
    (batch_totals(products, keys, item).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .parquet(f"{path}/batch_id={batch_id}"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of several batches in the same form; merging merged ones gives the same in any order."""
    return parts.groupBy(*keys, "part").agg(F.sum("rows").alias("rows"), F.bitmap_or_agg("bits").alias("bits"))


def fold_batches(spark: SparkSession, path: str, to: str, keys: list[str]) -> None:
    """All batches of ``path`` as batch 0 of ``to``, a new folder."""
    merged(spark.read.parquet(path), keys).write.parquet(f"{to}/batch_id=0")


def running_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What ``store_totals`` gives for the rows of all batches."""
    items = F.when(F.col("part").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    return (merged(spark.read.parquet(path), keys).groupBy(*keys)
            .agg(F.sum("rows").alias("total_products"), F.sum(items).alias("distinct_urls")))
