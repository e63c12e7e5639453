"""The product store: append-if-new, snapshots, quarantine, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import compact_time, folder_name, iso_time, slug
from pagemill.operators.links import unseen
from pagemill.operators.sequence import chunk_no, keep_first, positioned, spread_join
from pagemill.schemas import PRODUCT_FIELDS

# Products per envelope part; a term of any size is a run of bounded parts.
ENVELOPE_PART = 1000
# Tasks that write the rows of one term.
WRITERS = 16

DEDUP_KEYS = {"term": ["market", "search_term", "url"], "market": ["market", "url"]}


def new_products(batch: DataFrame, store: DataFrame, dedup_scope: str = "term") -> DataFrame:
    """First copy of each product in the batch that the store does not hold."""
    keys = DEDUP_KEYS[dedup_scope]
    return unseen(keep_first(batch, keys, first_by(batch, keys)), store, keys)


def first_by(rows: DataFrame, keys: list[str]) -> list[str]:
    """What decides the first copy - the place of the term in the request where known, else of the capture in time."""
    when = ["term_no"] if "term_no" in rows.columns else ["captured_at"] if "captured_at" in rows.columns else []
    if "search_term" in keys:
        when = []
    return [c for c in (*when, "search_term", "page_num", "pos") if c in rows.columns and c not in keys]


def appended(store: DataFrame, batch: DataFrame, dedup_scope: str = "term") -> DataFrame:
    """The store after the batch."""
    return store.unionByName(new_products(batch, store, dedup_scope))


def write_store(products: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by market and term slug.

    Rows go to writers by (market, term, a hash of the address): a term has at most ``WRITERS``
    files a write, however many tasks made its rows, and a large term is not one writer's.
    """
    spread = F.pmod(F.xxhash64("url"), F.lit(WRITERS))
    (products.withColumn("term_slug", folder_name(F.col("search_term")))
     .repartition("market", "term_slug", spread).write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("market", "term_slug").parquet(path))


def store_file_name(market: Column, term: Column, prefix: str = "products") -> Column:
    """The name of a term's envelope."""
    return slug(F.concat(F.lit(f"{prefix}_"), market, F.lit("_"), term, F.lit(".json")))


def store_totals(products: DataFrame, keys: list[str]) -> DataFrame:
    """A2, A3: stored rows and distinct addresses.

    Addresses are first combined per (key, url), so a hot key is counted in parallel.
    """
    return (products.groupBy(*keys, "url").agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*keys).agg(F.sum("n").alias("total_products"),
                                F.count(F.lit(1)).alias("distinct_urls")))


def fingerprint(products: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free digest of the rows of each key."""
    row = F.xxhash64(F.struct(*PRODUCT_FIELDS))
    return products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("xor"),
        F.sum(row.cast("decimal(38,0)")).alias("sum"))


def changed_since(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ from the last snapshot; one that vanished has 0 rows and is changed."""
    now, then = fingerprint(current, keys), fingerprint(snapshot, keys)
    digest = ["rows", "xor", "sum"]
    joined = now.join(then.select(*keys, *[F.col(c).alias(f"_{c}") for c in digest]), keys, "full")
    same = F.lit(True)
    for c in digest:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), (~same).alias("changed"))


def snapshot_rows(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to copy - those of the keys that changed since the last snapshot."""
    changed = changed_since(current, snapshot, keys).where("changed").select(*keys)
    return spread_join(current, changed, keys, F.col("url"))


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Replace the snapshot of the keys in ``rows``, leave the others as they are."""
    (rows.withColumn("term_slug", folder_name(F.col("search_term")))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("market", "term_slug").parquet(path))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row telling whether two tables hold the same bag of rows."""
    extra = a.exceptAll(b).unionByName(b.exceptAll(a))
    return extra.agg((F.count(F.lit(1)) == 0).alias("equal"))


def quarantine(rows: DataFrame, reason: Column, at: Column) -> DataFrame:
    """Rejected rows with a reason and a time stamp."""
    return (rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
            .withColumn("quarantined_at", compact_time(at)))


def save_or_quarantine(batch: DataFrame, save, path: str, at: Column, mode: str = "append") -> bool:
    """Run ``save()``; if it fails, keep the batch aside with the reason. True when saved.

    With ``mode`` overwrite ``path`` is the batch's own folder, which a replay replaces.
    """
    try:
        save()
        return True
    except Exception as failure:
        reason = f"{type(failure).__name__}: {failure}"
        quarantine(batch, F.lit(reason), at).write.mode(mode).parquet(path)
        return False


def envelopes(products: DataFrame, requested: Column, updated_at: Column,
              part_size: int = ENVELOPE_PART) -> DataFrame:
    """Products as envelope rows (market, search_term, part, envelope).

    The counters are those of the whole term.  A term larger than
    ``part_size`` becomes several parts, each with the term's counters; joined in
    part order their arrays are the term's products in order.
    """
    term = ["market", "search_term"]
    # One small row a part, so that a large term's parts are not joined on the term.
    totals = products.groupBy(*term).agg(F.count(F.lit(1)).alias("total_products")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_no(F.col("total_products"), part_size))))
    record = F.struct("seq", F.struct(*PRODUCT_FIELDS).alias("product"))
    parts = (
        positioned(products, term, "page_num", ["pos", "url"])
        .withColumn("part", chunk_no(F.col("seq"), part_size))
        .groupBy(*term, "part").agg(F.array_sort(F.collect_list(record)).alias("_rows"),
                                    F.max(updated_at).alias("_at"),
                                    F.max(requested).cast("bigint").alias("_asked")))
    return parts.join(totals, [*term, "part"]).select(
        *term, "part", F.struct(
            F.transform("_rows", lambda r: r["product"]).alias("products"),
            F.col("total_products"), F.col("_asked").alias("requested_items"),
            F.col("total_products").alias("actual_items_found"),
            iso_time(F.col("_at")).alias("last_updated")).alias("envelope"))
