"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a digest that make the uniform number; 52 bits fit a double exactly.
HEX_DIGITS = 13
#: Records of a block when records of a shard are numbered.
BLOCK = 4096


def _draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) that key and shard decide."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    number = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")
    return (number.cast("double") + F.lit(0.5)) / F.lit(float(16 ** HEX_DIGITS))


def rendezvous(key: Column, weights: list[float], more: list[float] | None = None) -> list[Column]:
    """The shard of ``key``, and with ``more`` shards added the shard it then has.

    Shard ``i`` bids ``-weights[i] / ln(draw)``; the highest bid wins, the lowest number on a tie.
    A bid depends on one shard and the key alone, so a new shard takes rows only into itself, and
    a shard's share is its weight's.  Null keys count as the text ``null``.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    bids = [F.struct((F.lit(-float(w)) / F.ln(_draw(key, i))).alias("bid"), F.lit(-i).alias("shard"))
            for i, w in enumerate([*weights, *(more or [])])]
    best = F.greatest(*bids[:len(weights)]) if len(weights) > 1 else bids[0]
    grown = [F.greatest(best, *bids[len(weights):])] if more else []
    return [(-b["shard"]).cast("int") for b in [best, *grown]]


def assign_shards(docs: DataFrame, key: str, weights: list[float], more: list[float] | None = None,
                  shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``docs`` with the shard of each row (and ``grown`` with ``more`` shards); no shuffle.

    Existing columns of these names are replaced.  Repeated keys share a shard.
    """
    columns = rendezvous(F.col(key), weights, more)
    return docs.withColumns(dict(zip([shard, grown], columns)))


def number_in_shard(rows: DataFrame, order: list[str], block: str, shard: str = "shard",
                    slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by ``block`` (a hash spread evenly), then ``order``.

    A shard may hold any number of rows: rows are ranked within blocks of about ``BLOCK`` rows, and
    a small table of counts (one row a block) gives the rows before each block.  Blocks are cut by
    the leading bits of ``block``, so the order is that of ``block`` over the whole shard.
    """
    total = rows.count()
    bits = max(0, min(40, math.ceil(math.log2(max(1, total) / BLOCK / 8))))
    rows = rows.withColumn("_block", F.shiftrightunsigned(F.col(block), 52 - bits) if bits else F.lit(0).cast("bigint"))
    sizes = rows.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_block").orderBy(block, *order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return (ranked.join(starts, [shard, "_block"])
            .withColumn(slot, F.col("_start") + F.col("_rank")).drop("_block", "_start", "_rank"))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Documents dealt over equal shards by their id (law ``key``).

    Null texts count 16 bytes and the checksum of the empty text; a null id is one key like any other.
    Rows with one id stay together, in the order of size and checksum.  Extra columns are left out.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")),
                           1, HEX_DIGITS), 16, 10).cast("bigint").alias("_place"))
    rows = assign_shards(rows, "doc_id", [1.0] * n_shards, [1.0])
    numbered = number_in_shard(rows, ["doc_id", "size", "text_crc32"], "_place")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           F.col("slot").cast("bigint").alias("slot"), "grown_shard")
