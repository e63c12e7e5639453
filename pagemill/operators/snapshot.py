"""Snapshots by a digest tree: only changed buckets are written, and terms that vanished go.

The rows of a term fall into buckets by a hash of the address.  A bucket has an order-free digest, a term the digest of its
buckets.  Two trees are compared from the top: buckets are looked at only below terms that differ.  A version of the snapshot
is a manifest (a row a bucket: its digest and the version that wrote its rows); its number is written last, so a sync that is
stopped leaves the version before it in force, and what the manifest does not name is not in the snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.sequence import spread_join
from pagemill.operators.store import fingerprint
from pagemill.schemas import PRODUCT_FIELDS
from pagemill.session import work_dir

BUCKETS = 64
TERM = ["market", "search_term"]
BUCKET = [*TERM, "bucket"]
DIGEST = ["rows", "xor", "sum"]


def open_snapshot(spark: SparkSession, path: str) -> None:
    """An empty snapshot, version 0."""
    (spark.createDataFrame([], "market string, search_term string, bucket int, rows bigint, xor bigint, sum decimal(38,0), written int")
     .write.mode("overwrite").parquet(f"{path}/manifest/version=0"))
    _commit(spark, path, 0)


def _commit(spark: SparkSession, path: str, version: int) -> None:
    """From here on the version is in force."""
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{path}/versions")


def latest_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A row a bucket: its digest, and the version whose files hold its rows."""
    at = latest_version(spark, path) if version is None else version
    return spark.read.parquet(f"{path}/manifest/version={at}")


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest (or a given) version."""
    live = manifest(spark, path, version).select(*BUCKET, "written")
    if live.isEmpty():
        return spark.createDataFrame([], "market string, search_term string, url string")
    rows = spark.read.parquet(f"{path}/rows").withColumnRenamed("version", "written").withColumn("_key", _key(*BUCKET))
    return spread_join(rows, _keyed(live), ["_key", "written"], F.col("url"), "left_semi").drop("_key", "written", "bucket")


def _key(*columns: str) -> Column:
    """One text for a key, also where parts are null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(_key(*BUCKET).alias("_key"), "written")


def _differ(now: DataFrame, then: DataFrame, keys: list[str], digest: list[str]) -> DataFrame:
    """Keys (as _key) whose digests differ, with ``kind``: added, changed or removed."""
    a = now.select(_key(*keys).alias("_key"), *keys, F.struct(*digest).alias("_now"))
    b = then.select(_key(*keys).alias("_key"), *[F.col(k).alias(f"_{k}") for k in keys], F.struct(*digest).alias("_then"))
    kind = F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "removed").otherwise("changed")
    both = a.join(b, "_key", "full").where(~F.col("_now").eqNullSafe(F.col("_then")))
    return both.select("_key", *[F.coalesce(k, f"_{k}").alias(k) for k in keys], kind.alias("kind"))


def term_digests(buckets: DataFrame) -> DataFrame:
    """The level above the buckets."""
    return buckets.groupBy(*TERM).agg(F.sum("rows").alias("rows"), F.bit_xor(F.xxhash64("bucket", *DIGEST)).alias("xor"),
                                      F.sum(F.xxhash64("bucket", *DIGEST).cast("decimal(38,0)")).alias("sum"))


def sync_snapshot(current: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Make the snapshot at ``path`` hold the rows of ``current``; gives (market, search_term, kind) of the terms that differed.

    The rows of the snapshot are not read.  Rows of changed buckets go to files of the new version, the manifest follows.
    Nothing is written where no term differs.  The same call again finds nothing to do.
    """
    spark = current.sparkSession
    old_version = latest_version(spark, path)
    version, then = old_version + 1, manifest(spark, path, old_version)
    rows = current.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"))
    work = work_dir(spark, "snapshot-digests")
    fingerprint(rows, BUCKET).write.parquet(work + "/now")
    now = spark.read.parquet(work + "/now")
    terms = _differ(term_digests(now), term_digests(then), TERM, DIGEST)
    terms.write.parquet(work + "/terms")
    terms = spark.read.schema(terms.schema).parquet(work + "/terms")
    if terms.isEmpty():
        return terms.drop("_key")
    # Below the terms that differ: the buckets that differ.
    wanted = terms.select("_key")
    below = lambda level: level.join(wanted, _key(*TERM) == F.col("_key"), "left_semi")
    changed = _differ(below(now), below(then), BUCKET, DIGEST).where("kind <> 'removed'").select("_key")
    changed.write.parquet(work + "/buckets")
    changed = spark.read.schema(changed.schema).parquet(work + "/buckets")
    (spread_join(rows.withColumn("_key", _key(*BUCKET)), changed, ["_key"], F.col("url")).drop("_key")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/rows/version={version}"))
    kept = then.select(_key(*BUCKET).alias("_key"), F.col("written").alias("_written"))
    (now.withColumn("_key", _key(*BUCKET)).join(kept, "_key", "left")
     .join(changed.withColumn("_new", F.lit(True)), "_key", "left")
     .select(*BUCKET, *DIGEST, F.when(F.col("_new"), F.lit(version)).otherwise(F.col("_written")).cast("int").alias("written"))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/manifest/version={version}"))
    _commit(spark, path, version)
    return terms.drop("_key")
