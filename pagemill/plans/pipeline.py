"""The whole run: captured pages -> product store, quarantine and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import compact_time
from pagemill.operators.fields import extract_fields, is_complete
from pagemill.operators.links import PAGE_KEY, link_products, page_facts, reached_pages, search_links, unseen
from pagemill.operators.sequence import keep_first, positioned, spread_join, within_cap
from pagemill.operators.store import DEDUP_KEYS, first_by, quarantine, write_store
from pagemill.operators.summary import run_summary
from pagemill.operators.validate import attempt_class, capture_outcome, with_verdict
from pagemill.plans.rules import with_rules
from pagemill.schemas import PRODUCT_FIELDS
from pagemill.session import work_dir
from pagemill.sources.captures import fetched

TERM = ["market", "search_term"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many times; survives lost executors and cuts the plan."""
    spark = df.sparkSession
    path = work_dir(spark, name) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
            folder.getFileSystem(conf).delete(folder, True)


def checked_pages(captures: DataFrame, rules: DataFrame, page_type: str) -> DataFrame:
    """Fetched pages of one kind with their verdict, parsed where worth it; search pages get flat elements."""
    return with_verdict(with_rules(fetched(captures, page_type), rules), flat=page_type == "search")


def product_rows(checked: DataFrame, keep: list[str]) -> DataFrame:
    """valid product pages -> ``keep`` + all fields, incomplete rows included."""
    return extract_fields(checked.where("is_valid"), keep)


def page_rejects(checked: DataFrame, keep: list[str]) -> DataFrame:
    """Pages that failed a check."""
    return quarantine(checked.select(*keep, "is_valid", "verdict", "captured_at"),
                      F.when(~F.col("is_valid"), F.col("verdict")),
                      F.col("captured_at")).drop("is_valid", "verdict")


def first_product_per_url(products: DataFrame) -> DataFrame:
    return keep_first(products, ["market", "url"], ["captured_at"])


@dataclass
class Run:
    """What a run gives: ``stored`` are the new rows, ``rejects`` the captures and rows that failed, ``account`` the fate of every capture."""
    pages: DataFrame
    found: DataFrame
    stored: DataFrame
    rejects: DataFrame
    summary: DataFrame
    account: DataFrame


PAGE = ["market", "page_type", "search_term", "url"]
REJECT = [*PAGE, "page_num", "attempt"]
CHECKED = [*REJECT, "status", "error", "is_valid", "verdict", "retry_any_status"]


@dataclass
class Parsed:
    """What the captures of a run say, as written tables that any number of runs may read."""
    searches: DataFrame
    products: DataFrame
    rejects: DataFrame
    facts: DataFrame
    pages: DataFrame

    def unstage(self) -> None:
        """Remove what no :class:`Run` reads."""
        unstage(self.searches, self.products, self.facts)


def parse_captures(captures: DataFrame, rules: DataFrame) -> Parsed:
    """The part of a run that neither the terms nor the store decide: pages checked and read, failures, and the pages that paging reaches.

    Pages are parsed once, where they are read, before any join: fields are a thousandth of the markup, so markup is never shuffled.
    """
    searches = stage(page_facts(checked_pages(captures, rules, "search"), [c for c in CHECKED if c not in PAGE_KEY])
                     .withColumn("capture_no", F.monotonically_increasing_id()), "searches")
    products = stage(extract_fields(checked_pages(captures, rules, "product"), [*CHECKED, "captured_at"])
                     .withColumn("capture_no", F.monotonically_increasing_id()), "products")
    rejects = stage(run_rejects(captures, rules, searches, products), "rejects")
    facts = keep_first(searches.where("is_valid").select(*PAGE_KEY, "base_url", "captured_at", "hrefs", "n_links", "has_next"),
                       PAGE_KEY, ["captured_at"])
    facts = stage(facts, "facts")
    return Parsed(searches, products, rejects, facts, stage(reached_pages(facts), "pages"))


def run(captures: DataFrame, terms: DataFrame, rules: DataFrame,
        dedup_scope: str = "term", store: DataFrame | None = None, parsed: Parsed | None = None) -> Run:
    """Search pages -> links -> products -> caps -> new rows, rejects and summary, all terms in one job.

    ``terms`` is (market, search_term, max_items), with the place in the request as ``term_no``
    where known: of the terms that list a product the first requested keeps it under scope
    ``market``.  ``store`` holds the products of earlier runs; their links are left out before
    anything is joined, so the same captures give no row twice.

    Every capture that failed is in ``rejects`` with a reason and the outcome of its page: an unknown
    market or page type, an error, a status, a failed check, an incomplete row.  ``account`` has a row for each
    capture, whatever became of it (:func:`run_account`).

    Extraction results and links are staged because the joins and positions need two passes
    over them.  Several runs over the same captures may share ``parsed``, what :func:`parse_captures` made of these captures
    and rules; whoever made it removes its tables.
    """
    read = parse_captures(captures, rules) if parsed is None else parsed
    searches, products, rejects, pages = read.searches, read.products, read.rejects, read.pages

    keys = DEDUP_KEYS[dedup_scope]
    asked = spread_join(search_links(pages), one_cap(terms), TERM, F.concat_ws("|", "page_num", "pos"))
    fresh = keep_first(asked, keys, first_by(asked, keys))
    if store is not None:
        fresh = unseen(fresh, store, keys)
    links = stage(fresh.drop("captured_at", "term_no"), "links")
    wanted = ["market", "url", "captured_at", *[f for f in PRODUCT_FIELDS if f != "url"]]
    complete = first_product_per_url(products.where(F.col("is_valid") & is_complete()).select(*wanted))
    found = stage(link_products(links, complete), "found")
    kept = positioned(found, TERM, "page_num", ["pos"]).where(within_cap(F.col("seq"), F.col("max_items")))
    stored = stage(kept, "stored")
    account = stage(run_account(rejects, searches, products, pages, found, stored, store, keys), "account")
    unstage(links)
    if parsed is None:
        read.unstage()
    return Run(pages, found, stored, rejects, run_summary(terms, pages, found, stored, rejects), account)


def run_account(rejects: DataFrame, searches: DataFrame, products: DataFrame, pages: DataFrame, found: DataFrame,
                stored: DataFrame, store: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row for each capture of the run with its ``fate``.

    A listing is ``stored`` (for some term), ``beyond cap``, ``already stored`` (an earlier run has it), ``not linked`` (no page
    that was read asks for it) or a ``repeat`` of an earlier capture of its address; a search page is ``read``, ``page not
    reached`` or a ``repeat``; any other capture has the reason of its reject.
    """
    def fated(table: DataFrame, fate: str) -> DataFrame:
        return table.select("market", "url", F.lit(fate).alias("fate"))

    # The first of these counts where several hold for an address.
    order = ["stored", "beyond cap", "already stored"]
    fates = fated(stored, order[0]).unionByName(fated(found, order[1]))
    if store is not None:
        asked = search_links(pages).select(*keys).distinct()
        fates = fates.unionByName(fated(asked.join(store.select(*keys).distinct(), keys, "left_semi"), order[2]))
    rank = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("fate"))
    fates = fates.groupBy("market", "url").agg(F.min(F.struct(rank.alias("rank"), "fate"))["fate"].alias("fate"))

    def first(rows: DataFrame, key: list[str]) -> DataFrame:
        kept = keep_first(rows.select(*key, "captured_at", "capture_no"), key, ["captured_at"])
        return kept.select("capture_no", F.lit(True).alias("_first"))

    listings = products.where(F.col("is_valid") & is_complete()).select(*REJECT, "captured_at", "capture_no")
    listings = listings.join(first(listings, ["market", "url"]), "capture_no", "left")
    listings = spread_join(listings, fates, ["market", "url"], F.col("capture_no"), "left").withColumn(
        "fate", F.when(F.col("_first"), F.coalesce("fate", F.lit("not linked"))).otherwise("repeat"))
    valid = searches.where("is_valid").select(*REJECT, "captured_at", "capture_no")
    read = pages.select(*PAGE_KEY).distinct().withColumn("_read", F.lit("read"))
    valid = valid.join(first(valid, PAGE_KEY), "capture_no", "left").join(read, PAGE_KEY, "left").withColumn(
        "fate", F.when(F.col("_first"), F.coalesce("_read", F.lit("page not reached"))).otherwise("repeat"))
    whole = [*REJECT, "fate"]
    return rejects.withColumnRenamed("reason", "fate").select(*whole).unionByName(listings.select(*whole)).unionByName(valid.select(*whole))


def not_fetched() -> Column:
    """Why a capture holds no page; null where it does."""
    return F.when(~F.coalesce(F.col("status") == 200, F.lit(False)), F.coalesce(
        F.nullif("error", F.lit("")), F.concat(F.lit("status "), F.col("status").cast("string")), F.lit("not fetched")))


def run_rejects(captures: DataFrame, rules: DataFrame, searches: DataFrame, products: DataFrame) -> DataFrame:
    """Captures that failed, one row each, with the outcome of all attempts at their page.

    Only narrow columns are read again; the outcome is 'success' where another attempt got the page.
    """
    known = captures.select(*REJECT, "status", "error", "captured_at").join(
        F.broadcast(rules.select("market", "retry_any_status")), "market", "left")
    strange = F.when(F.col("retry_any_status").isNull(), "unknown market").when(
        ~F.coalesce(F.col("page_type").isin("search", "product"), F.lit(False)), "unknown page type")
    failed = F.coalesce(strange, not_fetched())
    cols = [*REJECT, "status", "error", "captured_at", "retry_any_status", "is_valid", "reason"]
    unread = known.withColumn("reason", failed).where("reason is not null").withColumn("is_valid", F.lit(False))
    judged = F.when(~F.col("is_valid"), F.col("verdict"))
    tried = unread.select(*cols).unionByName(searches.withColumn("reason", judged).select(*cols)).unionByName(
        products.withColumn("reason", F.coalesce(judged, F.when(~is_complete(), "incomplete product"))).select(*cols))
    tried = tried.withColumn("attempt", F.coalesce("attempt", F.lit(1))).withColumn(
        "attempt_class", attempt_class(F.col("status"), F.col("error"), F.col("is_valid"),
                                       F.coalesce("retry_any_status", F.lit(False))))
    lost = tried.where("reason is not null")
    # An address may be null or shared by any number of captures, so the outcome is joined by a filled, split key.
    key = F.xxhash64(*PAGE)
    outcome = capture_outcome(tried.withColumn("_page", key), ["_page"]).select("_page", "outcome")
    return spread_join(lost.withColumn("_page", key), outcome, ["_page"], F.struct("attempt", "captured_at")).select(
        *REJECT, "reason", "outcome", compact_time(F.col("captured_at")).alias("quarantined_at"))


def save_run(result: Run, store_path: str, quarantine_path: str, run_id: str) -> None:
    """Save the new rows to the store and the rejects to the quarantine, each under the run's own folder.

    Saving the same run again replaces what it saved, so a save that was stopped is mended by repeating it.
    """
    at = f"run={run_id}"
    result.rejects.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("market").parquet(f"{quarantine_path}/{at}")
    write_store(result.stored, f"{store_path}/{at}", "overwrite")


def one_cap(terms: DataFrame) -> DataFrame:
    """One row per term; of several requests the widest counts, and no cap is wider than any."""
    cap = F.nullif("max_items", F.lit(0))
    place = [F.min("term_no").alias("term_no")] if "term_no" in terms.columns else []
    return terms.groupBy(*TERM).agg(
        F.when(F.count(cap) == F.count(F.lit(1)), F.max(cap)).alias("max_items"), *place)


def capture_rejects(captures: DataFrame, rules: DataFrame, page_type: str) -> DataFrame:
    return page_rejects(checked_pages(captures, rules, page_type),
                        ["market", "search_term", "url"])


def rejected_products(products: DataFrame, at: Column) -> DataFrame:
    """Extracted rows without a title or price."""
    return quarantine(products, F.when(~is_complete(), "incomplete product"), at)
