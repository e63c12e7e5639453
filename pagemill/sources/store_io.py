"""Envelope files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import folder_name
from pagemill.schemas import ENVELOPE


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """One JSON document per file, under a folder of the market and term, nulls kept.

    A term is replaced whole, so parts it no longer has go with the old ones; terms that are
    not in ``envelopes`` stay.  Documents of a term of several parts carry their ``part``.
    """
    options = {"pretty": "true", "ignoreNullFields": "false"}
    only = F.size("envelope.products") == F.col("envelope.total_products")
    document = F.when(only, F.to_json("envelope", options)).otherwise(
        F.to_json(F.struct("part", "envelope.*"), options))
    (envelopes.select("market", folder_name(F.col("search_term")).alias("term_slug"), "part",
                      document.alias("value"))
     # one document per file: a part is bounded, and so is a writer's work
     .repartition("market", "term_slug", "part").drop("part")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", 1).partitionBy("market", "term_slug")
     .option("lineSep", "\n").text(path))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelope files, tolerant of empty and broken ones.

    A broken file is one row with null products and its text in ``corrupt``; an
    empty or missing file is no row, that is an empty store.
    """
    schema = T.StructType([T.StructField("part", T.LongType()), *ENVELOPE.fields, T.StructField("corrupt", T.StringType())])
    return (spark.read.schema(schema).option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
            .json(path))


def stored_products(envelopes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per stored product; broken envelopes hold none."""
    return (envelopes.where(F.col("products").isNotNull())
            .select(*keys, F.inline("products")))
