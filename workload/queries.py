"""One query per operator, each over whole tables rendered from the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import select as S
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.functions.markup import attribute, page_elements, with_elements
from pagemill.operators import fields as FD
from pagemill.operators.containment import nearest_above
from pagemill.operators.key_index import KeyIndex, open_key_index
from pagemill.operators.links import (link_products, page_facts, reached_pages,
                                      search_links, unseen)
from pagemill.operators.sequence import (chunk_no, is_snapshot_batch, keep_first, positioned,
                                         progress, ranked, within_cap)
from pagemill.operators.snapshot import open_snapshot, read_snapshot, sync_snapshot
from pagemill.operators.store import (appended, changed_since, envelopes, same_rows,
                                      store_file_name, store_totals)
from pagemill.operators.summary import TERM
from pagemill.operators.totals import add_batch, running_totals
from pagemill.operators.validate import attempt_class, capture_outcome, with_verdict
from pagemill.plans.pipeline import (checked_pages, page_rejects, parse_captures, product_rows, rejected_products,
                                     run, save_run, stage)
from pagemill.plans.rules import unknown_markets
from pagemill.schemas import CAPTURE
from pagemill.session import work_dir
from pagemill.sources.captures import fetched, read_captures, stream_captures
from pagemill.sources.envelope_source import document_rows, read_terms, replace_terms
from pagemill.sources.store_io import read_envelopes, stored_products, write_envelopes
from pagemill.sources.terms import search_requests, search_terms
from pagemill.streaming import flow
from pagemill.streaming.links import link_stream, linked_products, listing_stream
from pagemill.streaming.paging import outcome_stream, reached_stream
from pagemill.streaming.state import capped_stream, keyed_state
from workload import render as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["market", "url"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs ---------------------------------------------------------

def _listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Valid listing pages, parsed, with rules."""
    return with_verdict(R.listings(spark, sf)).where("is_valid")


def _fields(spark: SparkSession, sf: str, *groups: str) -> DataFrame:
    return FD.extract_fields(_listing_pages(spark, sf), KEY, list(groups)).drop("extract_note")


def _market_fields(spark: SparkSession, sf: str, markets: list[str], *groups: str) -> DataFrame:
    """Fields of the markets that share a rule; others are left out before parsing."""
    pages = R.listings(spark, sf).where(F.col("market").isin(markets))
    return FD.extract_fields(with_verdict(pages).where("is_valid"), KEY, list(groups)).drop(
        "extract_note")


def _all_listing_elements(spark: SparkSession, sf: str) -> DataFrame:
    return with_elements(R.listing_captures(spark, sf)).select("item", "els", "texts")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return page_facts(with_verdict(R.searches(spark, sf), flat=True).where("is_valid"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return search_links(_facts(spark, sf))


def _complete(spark: SparkSession, sf: str) -> DataFrame:
    rows = product_rows(checked_pages(R.listing_captures(spark, sf), R.rules(spark), "product"),
                        ["market", "search_term", "page_num", "pos", "url", "captured_at"])
    return rows.where(FD.is_complete()).drop("extract_note")


def _flat_store_info(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "store_info"],
                     F.col("store_info.name").alias("store_name"),
                     F.col("store_info.feedback").alias("store_feedback"),
                     F.col("store_info.sales").alias("store_sales"))


# --- sources and sinks -----------------------------------------------------

@query
def q_capture_scan(spark, sf):
    """Captures written and read back by their schema; some were not fetched."""
    cols = [c for c in CAPTURE.names if c != "html"]
    path = work_dir(spark, "captures") + "/table"
    listings = R.listing_captures(spark, sf).withColumn("status", F.when(F.col("item") % 17 == 5, 404).otherwise(200))
    searches = R.search_captures(spark, sf).withColumn("status", F.when(F.col("o_orderkey") % 13 != 3, 200))
    listings.select(*cols).unionByName(searches.select(*cols)).write.parquet(path)
    captures = read_captures(spark, path)
    return (fetched(captures, "product").unionByName(fetched(captures, "search"))
            .groupBy("market", "page_type").agg(F.count(F.lit(1)).alias("pages")))


def _term_texts(spark, sf):
    """One request text per order: three words of it, with blanks and an empty term."""
    o = R.table(spark, sf, "orders")
    return o.select(
        R.market_of(F.col("o_orderkey")).alias("market"), F.col("o_orderkey").alias("request"),
        F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" , lot "), "o_custkey",
                 F.lit(",,café ~a*b&c ")).alias("terms"),
        F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "0")
        .otherwise((F.col("o_orderkey") % 50).cast("string")).alias("max_items"))


@query
def q_search_terms(spark, sf):
    texts = _term_texts(spark, sf)
    terms = search_terms(texts.withColumn("market", F.concat_ws("/", "market", "request")))
    return terms.select(F.split_part("market", F.lit("/"), F.lit(2)).cast("bigint").alias("request"),
                        "term_no", "search_term", "max_items")


@query
def q_search_requests(spark, sf):
    terms = search_terms(_term_texts(spark, sf)).select("market", "search_term").distinct()
    with_base = terms.join(F.broadcast(R.rules(spark).select("market", "base_url")), "market")
    return search_requests(with_base, F.lit(3))


@query
def q_market_dim(spark, sf):
    parts = R.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 37 == 0, "JP").otherwise(
            R.market_of(F.col("p_partkey"))).alias("market"))
    rules = R.rules(spark)
    known = parts.join(F.broadcast(rules), "market").select(
        "p_partkey", "market", "base_url", "min_length", "next_page_rule")
    lost = unknown_markets(parts, rules).select(
        "p_partkey", "market", F.lit("unknown market").alias("base_url"),
        F.lit(None).cast("int").alias("min_length"), F.lit(None).cast("string").alias("next_page_rule"))
    return known.unionByName(lost)


@query
def q_store_slug(spark, sf):
    p = R.table(spark, sf, "part").select(R.market_of(F.col("p_partkey")).alias("market"), "p_name")
    return p.groupBy("market", "p_name").agg(F.count(F.lit(1)).alias("products")).select(
        "market", X.slug(F.col("p_name")).alias("term_slug"),
        store_file_name(F.col("market"), F.col("p_name")).alias("file_name"), "products")


def _key_rows(spark, sf):
    """Store-shaped rows straight from lineitem, with real repeats of (market, term, url)."""
    o = R.search_pages(spark, sf)
    li = R.table(spark, sf, "lineitem")
    item = F.col("l_partkey") - F.col("l_partkey") % 10 + F.col("l_orderkey") % 10
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select("market", "search_term", F.col("page_num").cast("int").alias("page_num"),
                    (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("pos"),
                    F.concat(F.lit("/itm/"), item.cast("string")).alias("url"),
                    F.col("l_orderkey").alias("okey")))


@query
def q_upsert_new(spark, sf):
    rows = _key_rows(spark, sf)
    store = keep_first(rows.where("okey % 4 <> 0"), ["market", "search_term", "url"],
                       ["page_num", "pos"])
    return appended(store, rows.where("okey % 4 = 0")).drop("okey", "pos")


@query
def q_key_index(spark, sf):
    """q_upsert_new with the store's keys in an index that grew batch by batch; the store itself is not read for them."""
    keys = ["market", "search_term", "url"]
    rows = stage(_key_rows(spark, sf), "rows")
    path = work_dir(spark, "key-index") + "/keys"
    open_key_index(spark, path, keys, buckets=16, expected_keys=1_000_000)
    index = KeyIndex(spark, path)
    for i in (1, 2, 3):
        index = index.append(rows.where(F.col("okey") % 4 == i))
    index = index.fold()
    store = keep_first(rows.where("okey % 4 <> 0"), keys, ["page_num", "pos"])
    batch = keep_first(rows.where("okey % 4 = 0"), keys, ["page_num", "pos"])
    return store.unionByName(index.new_rows(batch)).drop("okey", "pos")


@query
def q_snapshot_changed(spark, sf):
    now = stage(_complete(spark, sf), "snapshot")
    # the earlier snapshot lacks one product in some terms and differs in another
    item = F.substring_index("url", "/", -1).cast("bigint")
    then = now.where(item % 30 != 7).withColumn(
        "title", F.when(item % 40 == 3, F.lit("old")).otherwise(F.col("title")))
    same, other = same_rows(now, now.repartition("url")), same_rows(now, then)
    # the products of one market are gone from the store
    return (changed_since(now.where(F.col("market") != "NL"), then, ["market"])
            .join(F.broadcast(same.withColumnRenamed("equal", "self_equal")))
            .join(F.broadcast(other.withColumnRenamed("equal", "then_equal"))))


@query
def q_snapshot_sync(spark, sf):
    """A snapshot brought up to date: rows added and changed, and the terms of one market gone."""
    now = stage(_complete(spark, sf), "snapshot")
    item = F.substring_index("url", "/", -1).cast("bigint")
    path = work_dir(spark, "snapshots") + "/products"
    open_snapshot(spark, path)
    sync_snapshot(now.where(item % 30 != 7).withColumn("title", F.when(item % 40 == 3, "old").otherwise(F.col("title"))), path)
    sync_snapshot(now.where(F.col("market") != "NL"), path)
    return read_snapshot(spark, path).select(*TERM, "url", "title")


@query
def q_quarantine(spark, sf):
    captures = R.listing_captures(spark, sf)
    pages = checked_pages(captures, R.rules(spark), "product")
    bad_pages = page_rejects(pages, KEY)
    rows = product_rows(pages, [*KEY, "captured_at"])
    bad_rows = rejected_products(rows, F.col("captured_at"))
    cols = [*KEY, "reason", "quarantined_at"]
    return bad_pages.select(*cols).unionByName(bad_rows.select(*cols))


@query
def q_store_envelope(spark, sf):
    out = envelopes(stage(_complete(spark, sf), "products"), F.lit(50), F.col("captured_at"), part_size=40)
    return out.select(
        "market", "search_term", "part", F.size("envelope.products").cast("bigint").alias("in_part"),
        F.element_at("envelope.products", 1)["url"].alias("first_url"),
        F.element_at("envelope.products", -1)["title"].alias("last_title"),
        "envelope.total_products", "envelope.requested_items", "envelope.actual_items_found",
        "envelope.last_updated")


@query
def q_store_read(spark, sf):
    """Envelope files written and read back, broken and empty ones among them."""
    path = work_dir(spark, "envelopes") + "/store"
    whole = envelopes(stage(_complete(spark, sf), "products"), F.lit(None).cast("int"), F.col("captured_at"))
    write_envelopes(whole, path)
    broken = whole.select("market", F.lit("broken").alias("term_slug"),
                          F.lit('{"products": [{"url": "x"').alias("value")).distinct()
    broken.write.mode("append").partitionBy("market", "term_slug").text(path)
    broken.select("market", F.lit("empty").alias("term_slug"), F.lit("").alias("value")) \
        .write.mode("append").partitionBy("market", "term_slug").option("lineSep", " ").text(path)
    read = read_envelopes(spark, path)
    return _flat_store_info(stored_products(read, ["market", "term_slug"]))


@query
def q_envelope_source(spark, sf):
    """Envelopes through the data source: written, some markets' terms replaced in fewer parts, broken and empty ones, read in splits."""
    path = work_dir(spark, "envelope-source")
    done = stage(_complete(spark, sf), "products")
    asked, at = F.lit(None).cast("int"), F.col("captured_at")
    first = stage(document_rows(envelopes(done, asked, at, part_size=40)), "documents")
    odd = first.select("market").distinct()
    replace_terms(first.unionByName(odd.select("market", F.lit("broken").alias("term_slug"), F.lit(0).cast("bigint").alias("part"),
                                               F.lit('{"products": [{"url": "x"').alias("value")))
                  .unionByName(odd.select("market", F.lit("empty").alias("term_slug"), F.lit(0).cast("bigint").alias("part"),
                                          F.lit("").alias("value"))), path)
    again = done.where(F.col("market").isin("US", "FR", "NL"))
    replace_terms(stage(document_rows(envelopes(again, asked, at)), "documents"), path)
    return _flat_store_info(stored_products(read_terms(spark, path, splitBytes=1 << 20), ["market", "term_slug"]))


# --- checks ----------------------------------------------------------------

@query
def q_validate(spark, sf):
    """Verdicts of the raw pages table and of the rendered captures."""
    rules = R.rules(spark)
    raw = (R.spread(R.table(spark, sf, "pages")).select(
        F.lit("US").alias("market"), F.lit("product").alias("page_type"),
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("url"), "html"))
    cols = ["market", "page_type", "url", "html"]
    every = raw.unionByName(R.listing_captures(spark, sf).select(*cols)).unionByName(
        R.search_captures(spark, sf).select(*cols))
    judged = with_verdict(every.join(F.broadcast(rules), "market"))
    return judged.select("market", "page_type", "url", "verdict", "is_valid", "blocked")


def _attempts(spark, sf):
    """Events as attempts at a page (a user), numbered in time."""
    e = R.table(spark, sf, "events").select(
        "user_id", "ts", "event_id", "event_type",
        F.floor(F.unix_timestamp("ts") / 86400).alias("day"))
    log = positioned(e, ["user_id"], "day", ["ts", "event_id"], "attempt")
    status = (F.when(F.col("event_type").isin("view", "click"), 200)
              .when(F.col("event_type") == "error", 503)
              .when(F.col("event_type") == "signup", 404))
    error = F.when(F.col("event_type") == "purchase", F.when(
        F.col("event_id") % 2 == 0, "Connection reset").otherwise("bad certificate"))
    valid = F.col("event_type") == "view"
    return log.withColumn("error", error).withColumn(
        "attempt_class", attempt_class(status, F.col("error"), valid, F.lit(False)))


@query
def q_capture_outcome(spark, sf):
    return capture_outcome(_attempts(spark, sf), ["user_id"])


@query
def q_complete_products(spark, sf):
    return _fields(spark, sf, "title", "price").where(FD.is_complete()).select(
        *KEY, "title", "current_price")


# --- elements and selectors ------------------------------------------------

@query
def q_page_elements(spark, sf):
    els = page_elements(with_elements(R.spread(R.table(spark, sf, "pages"))), ["page_id"])
    return els.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def _selected(spark, sf, pred, name="n"):
    """Number of matching elements per listing page."""
    return _all_listing_elements(spark, sf).select(
        "item", F.size(S.all_where(F.col("els"), pred)).cast("bigint").alias(name))


def _first_text(spark, sf, picked) -> DataFrame:
    return _all_listing_elements(spark, sf).withColumn("_el", picked).select(
        "item", S.text(F.col("texts"), F.col("_el")).alias("text"))


@query
def q_sel_tag_class(spark, sf):
    return _selected(spark, sf, S.has_class("ux-textspans--STRIKETHROUGH", "span"))


@query
def q_sel_class_all(spark, sf):
    return _selected(spark, sf, S.has_all_classes(["vim", "x-returns-minview"], "div"))


@query
def q_sel_class_substr(spark, sf):
    return _selected(spark, sf, S.class_has_substrings(["STRIKE", "POSITIVE"], "span", False))


@query
def q_sel_descendant(spark, sf):
    els = F.col("els")
    return _first_text(spark, sf, S.first(S.below(
        els, S.has_class("x-item-title__mainTitle", "h1"), S.is_tag("span"))))


@query
def q_tree_join(spark, sf):
    """q_sel_descendant over rows of elements: a page is never one array value after the parse."""
    pages = stage(_all_listing_elements(spark, sf), "elements")
    title = F.array_contains("classes", "x-item-title__mainTitle") & (F.col("tag") == "h1")
    # what is neither a title nor a span is no answer and does not ask
    rows = (page_elements(pages.select("item", "els"), ["item"]).select("item", "eid", "last", "t_start", "t_end", "tag", title.alias("title"))
            .where("tag = 'span' or title"))
    spans = nearest_above(rows, ["item"], F.col("title")).where("tag = 'span' and above is not null")
    first = spans.groupBy("item").agg(F.min(F.struct("eid", "t_start", "t_end")).alias("_el"))
    return (pages.select("item", "texts").join(first, "item", "left")
            .select("item", S.text(F.col("texts"), F.col("_el")).alias("text")))


@query
def q_sel_child(spark, sf):
    els = F.col("els")
    items = S.all_where(els, S.has_class("ux-section__item"))
    return _first_text(spark, sf, S.first(FD.let(items, lambda its: S.all_where(
        els, lambda e: S.has_class("ux-textspans", "span")(e)
        & F.exists(its, lambda i: S.child_of(i)(e))))))


@query
def q_sel_direct(spark, sf):
    els = F.col("els")
    box = S.first_where(els, S.has_class("x-quantity__availability", "div"))
    return _all_listing_elements(spark, sf).select("item", FD.let(box, lambda b: F.size(
        S.all_where(els, S.child_of(b)))).cast("bigint").alias("n"))


@query
def q_sel_attr(spark, sf):
    pages = with_elements(R.search_captures(spark, sf))
    els = F.col("els")
    return pages.select(
        "o_orderkey",
        F.size(S.all_where(els, S.has_attribute("type", "next", "a"))).cast("bigint").alias("links"),
        F.size(S.all_where(els, S.has_attribute("type", "next", "button"))).cast("bigint").alias("buttons"))


@query
def q_sel_position(spark, sf):
    """First, second and last children of the shipping content."""
    els, texts = F.col("els"), F.col("texts")
    pages = _all_listing_elements(spark, sf).withColumn(
        "_box", S.first_where(els, S.has_class(FD.VALUES_CONTENT, "div"))
    ).withColumn("_in", S.descendants(els, F.col("_box")))

    def pick(pred):
        return S.text(texts, S.first_where(F.col("_in"), pred))

    return pages.select(
        "item", pick(S.both(S.is_tag("div"), S.nth_child(2))).alias("second"),
        pick(S.both(S.is_tag("div"), S.last_child())).alias("last"),
        F.size(S.all_where(F.col("_in"), S.nth_child(1))).cast("bigint").alias("firsts"))


@query
def q_sel_list(spark, sf):
    spec = S.either(S.has_class("ux-labels-values--marca", "dl"),
                    S.has_class("ux-labels-values--marque", "dl"),
                    S.has_class("ux-labels-values--brand", "dl"))
    return _first_text(spark, sf, S.first_where(F.col("els"), spec))


@query
def q_sel_contains(spark, sf):
    els, texts = F.col("els"), F.col("texts")
    return _first_text(spark, sf, S.first_where(els, lambda e: S.has_class(
        FD.SECONDARY, "span")(e) & F.contains(S.raw_text(texts, e), F.lit(FD.LOCATION_IT))))


@query
def q_sel_first(spark, sf):
    return _first_text(spark, sf, S.first_where(F.col("els"), S.has_class("x-price-primary", "div")))


@query
def q_sel_all(spark, sf):
    """Every link of the raw pages in document order."""
    pages = with_elements(R.spread(R.table(spark, sf, "pages")))
    found = S.all_where(F.col("els"), S.is_tag("a"))
    return (pages.select("page_id", F.posexplode(found).alias("n", "el"))
            .select("page_id", F.col("n").cast("bigint").alias("n"),
                    attribute(F.col("el.attrs"), "href").alias("href")))


@query
def q_sel_nth(spark, sf):
    els = F.col("els")
    return _first_text(spark, sf, S.nth(S.below(
        els, S.has_class("x-quantity__availability", "div"), S.has_class("ux-textspans", "span")), 1))


@query
def q_attr_read(spark, sf):
    pages = with_elements(R.search_captures(spark, sf))
    button = S.first_where(F.col("els"), S.is_tag("button"))
    link = S.first_where(F.col("els"), S.has_attribute("type", "next", "a"))
    return pages.withColumns({"_b": button, "_l": link}).select(
        "o_orderkey", attribute(F.col("_b.attrs"), "aria-disabled").alias("disabled"),
        F.coalesce(attribute(F.col("_l.attrs"), "href"), F.lit("")).alias("href"))


@query
def q_attr_references(spark, sf):
    """Named and numeric references in an address; a name without semicolon and a doubly written one stay as they are."""
    key = F.col("p_partkey").cast("string")
    href = F.concat(F.lit("&#47;itm&#x2F;"), key, F.lit("?q=caf&eacute;&nbsp;&quot;&apos;&lt;&copy=1&amp;amp;&euro;&#8364;"))
    quote = F.when(F.col("p_partkey") % 2 == 0, "'").otherwise('"')
    page = R.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("<p><a href="), quote, href, quote, F.lit(">x</a>")).alias("html"))
    link = S.first_where(F.col("els"), S.is_tag("a"))
    return with_elements(page).withColumn("_a", link).select("p_partkey", attribute(F.col("_a.attrs"), "href").alias("href"))


@query
def q_subtree_text(spark, sf):
    return _first_text(spark, sf, S.first_where(
        F.col("els"), S.has_class("x-store-information__highlights", "h4")))


@query
def q_excl_class(spark, sf):
    els, texts = F.col("els"), F.col("texts")
    spans = S.below_first(els, S.has_class(FD.VALUES_CONTENT, "div"), lambda e: S.has_class(
        FD.SPAN, "span")(e) & ~S.has_class(FD.CLIPPED)(e) & ~S.has_class(FD.CUSTOM_VIEW)(e))
    return _all_listing_elements(spark, sf).withColumn("_s", spans).select(
        "item", F.array_join(F.transform("_s", lambda e: S.text(texts, e)), "|").alias("parts"))


@query
def q_excl_descendant(spark, sf):
    els, texts = F.col("els"), F.col("texts")
    spans = FD.let(S.all_where(els, S.has_class(FD.CLIPPED, "span")), lambda bad: S.below_first(
        els, S.has_class(FD.VALUES_CONTENT, "div"), lambda e: S.has_class(FD.SPAN, "span")(e)
        & ~F.exists(bad, lambda b: S.contains(e, b))))
    return _all_listing_elements(spark, sf).withColumn("_s", spans).select(
        "item", F.array_join(F.transform("_s", lambda e: S.text(texts, e)), "|").alias("parts"))


@query
def q_grandparent(spark, sf):
    """Spans whose grandparent's class list is exactly one given value."""
    els = F.col("els")
    wanted = F.array(F.lit(FD.VALUES_CONTENT))
    return _all_listing_elements(spark, sf).select("item", F.size(S.all_where(
        els, lambda e: S.has_class(FD.SPAN, "span")(e) & F.coalesce(
            F.get(els, F.get(els, e["parent"])["parent"])["classes"] == wanted, F.lit(False)))
    ).cast("bigint").alias("n"))


@query
def q_fallback(spark, sf):
    els = F.col("els")

    def value(tag, holder):
        return S.first(FD.let(S.first_where(els, S.has_class("ux-labels-values--brand", tag)),
                              lambda top: FD.let(
            S.all_where(els, lambda e: S.contains(top, e)),
            lambda sub: S.below(sub, holder, S.has_class(FD.SPAN)))))

    return _first_text(spark, sf, F.coalesce(
        value("dl", S.is_tag("dd")), value("div", S.has_class(FD.VALUES))))


# --- product fields --------------------------------------------------------

@query
def q_field_title(spark, sf):
    return _fields(spark, sf, "title")


@query
def q_field_price(spark, sf):
    return _fields(spark, sf, "price").select(*KEY, "current_price", "was_price")


@query
def q_field_discount(spark, sf):
    return _fields(spark, sf, "price").select(*KEY, "discount")


@query
def q_field_quantity(spark, sf):
    return _fields(spark, sf, "quantity")


def _rule_query(name: str, markets: list[str], group: str) -> None:
    def run_query(spark, sf):
        return _market_fields(spark, sf, markets, group)

    run_query.__name__ = name
    query(run_query)


_rule_query("q_shipping_us", ["US"], "shipping")
_rule_query("q_shipping_uk_ca", ["CA", "GB"], "shipping")
_rule_query("q_shipping_es_mx", ["DE", "ES", "MX"], "shipping")
_rule_query("q_shipping_fr", ["FR"], "shipping")
_rule_query("q_shipping_it", ["IT"], "shipping")
_rule_query("q_shipping_au", ["AU"], "shipping")
_rule_query("q_shipping_nl", ["NL"], "shipping")
_rule_query("q_location_last", ["US"], "location")
_rule_query("q_location_first", ["NL"], "location")
_rule_query("q_location_marker", ["CA", "GB"], "location")
_rule_query("q_location_es_mx", ["DE", "ES", "MX"], "location")
_rule_query("q_location_fr", ["FR"], "location")
_rule_query("q_location_it", ["IT"], "location")
_rule_query("q_location_au", ["AU"], "location")


@query
def q_returns(spark, sf):
    return _fields(spark, sf, "returns")


@query
def q_condition(spark, sf):
    return _fields(spark, sf, "condition")


@query
def q_brand_type(spark, sf):
    return _fields(spark, sf, "spec")


@query
def q_store_info(spark, sf):
    return _flat_store_info(_fields(spark, sf, "store"))


@query
def q_product_fields(spark, sf):
    """Flagship: captures -> checks -> elements -> all fields -> complete products."""
    return _flat_store_info(_complete(spark, sf)).drop("search_term", "page_num", "pos",
                                                       "captured_at")


# --- scalar functions, over whole columns of the tables --------------------

def _documents(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", "text")


def _scalar(name: str, source: Callable, **columns: Column | Callable) -> None:
    def run_query(spark, sf):
        df, key = source(spark, sf)
        return df.select(key, *[c().alias(n) for n, c in columns.items()])

    run_query.__name__ = name
    query(run_query)


def _docs(spark, sf):
    return _documents(spark, sf), "doc_id"


def _parts(spark, sf):
    return R.table(spark, sf, "part"), "p_partkey"


def _orders(spark, sf):
    return R.table(spark, sf, "orders"), "o_orderkey"


def _pages(spark, sf):
    return R.table(spark, sf, "pages"), "page_id"


def _lit(*parts):
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


_scalar("q_strip", _docs, text=lambda: X.strip(_lit(" \x1c \n", F.col("text"), " \t ")))
_scalar("q_collapse", _docs, text=lambda: X.collapse(F.col("text")))
_scalar("q_trailing_dot", _docs, text=lambda: X.drop_trailing_dot(F.col("text")))
_scalar("q_trailing_dots", _docs, text=lambda: X.drop_trailing_dots(_lit(F.col("text"), "...")))
_scalar("q_dot_space", _docs, text=lambda: X.close_dots(F.replace(F.col("text"), F.lit("."), F.lit(" ."))))
_scalar("q_before_marker", _docs, text=lambda: X.before_marker(F.col("text"), "the"))
_scalar("q_after_marker", _docs, text=lambda: X.after_last_marker(F.col("text"), "the"))
_scalar("q_after_colon", _docs, text=lambda: X.after_colon(F.col("text")))
_scalar("q_prefix_remove", _parts,
        text=lambda: X.remove_prefixed(_lit(F.col("p_name"), " ", F.col("p_name")), "red "))
_scalar("q_first_sentence", _docs, text=lambda: X.first_sentence(F.col("text")))
_scalar("q_percent", _parts, text=lambda: X.first_percent(
    F.when(F.col("p_size") % 5 == 0, "no deal").otherwise(
        _lit("save 5 or ", F.col("p_size").cast("string"), "% and 3%"))))
_scalar("q_concat_pair", _parts, text=lambda: X.join_pair(F.col("p_brand"), F.col("p_type")))
_scalar("q_join_parts", _docs, text=lambda: X.join_parts(F.split(F.col("text"), "\n")))
_scalar("q_noise_filter", _parts, text=lambda: F.array_join(X.drop_noise(F.array(
    F.col("p_brand"), F.lit("."), F.lit("&nbsp;"), F.lit(" "), F.lit(""),
    F.when(F.col("p_size") % 2 == 0, ".").otherwise(F.col("p_type")))), "|"))
_scalar("q_exclude_any", _docs,
        keep=lambda: ~X.contains_any(F.col("text"), ["http", "@", "License", "copyright"]))
_scalar("q_icontains", _pages, hit=lambda: X.icontains(F.col("html"), "NAV"))
_scalar("q_url_base", _pages, site=lambda: U.site_of(_lit(F.col("url"), "/sch/i.html?_nkw=", F.col("url"))))
_scalar("q_time_format", _orders, iso=lambda: X.iso_time(F.col("o_orderdate")),
        compact=lambda: X.compact_time(F.col("o_orderdate")))


# --- links, pages, joins ---------------------------------------------------

@query
def q_search_links(spark, sf):
    return _links(spark, sf).drop("captured_at")


@query
def q_ordered_links(spark, sf):
    # a range sort reads its input twice, so pages are not read in it
    links = stage(_links(spark, sf).select("market", "search_term", "page_num", "pos", "item_id"), "links")
    return links.orderBy("market", "search_term", "page_num", "pos").select(
        "market", "search_term", "page_num", "pos", "item_id")


@query
def q_links_per_page(spark, sf):
    pages = with_elements(R.spread(R.table(spark, sf, "pages")))
    hrefs = pages.select("page_id", F.explode(S.all_where(F.col("els"), S.is_tag("a"))).alias("el"))
    return hrefs.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.count(F.when(F.contains(attribute(F.col("el.attrs"), "href"), F.lit("?")), 1)).alias("with_query"))


@query
def q_has_next(spark, sf):
    facts = page_facts(with_verdict(R.searches(spark, sf), flat=True).where("is_valid"))
    return facts.select("market", "search_term", "page_num", "n_links", "has_next")


@query
def q_page_reach(spark, sf):
    facts = stage(_facts(spark, sf).drop("hrefs"), "facts")
    # one page of some terms was never captured
    holes = facts.where(~((F.col("page_num") == 7) & F.col("market").isin("AU", "US")))
    return reached_pages(holes).select("market", "search_term", "page_num", "n_links", "has_next")


@query
def q_unseen_links(spark, sf):
    links = _links(spark, sf)
    seen = R.listing_captures(spark, sf).where(F.col("item") % 3 == 0).select("market", "url")
    return unseen(links, seen, ["market", "url"]).select(
        "market", "search_term", "page_num", "pos", "item_id")


@query
def q_link_products(spark, sf):
    products = _fields(spark, sf, "title", "price").where(FD.is_complete())
    links = stage(_links(spark, sf).drop("captured_at"), "links")
    return link_products(links, products, "left").select(
        "market", "search_term", "page_num", "pos", "item_id", "title",
        F.col("title").isNull().alias("missing"))


# --- order-dependent operators ---------------------------------------------

def _placed(spark, sf, per_term=None):
    """Distinct links of each term with their position in it."""
    links = stage(keep_first(_links(spark, sf).drop("captured_at"), ["market", "search_term", "url"],
                             ["page_num", "pos"]), "links")
    return ranked(links, TERM, ["page_num", "pos"], per_group=per_term)


def _caps(spark, sf):
    terms = R.table(spark, sf, "orders").select(
        R.market_of(F.col("o_orderkey")).alias("market"),
        F.lower("o_orderpriority").alias("search_term")).distinct()
    m = F.col("market")
    return terms.withColumn("max_items", F.when(m.isin("AU", "CA", "DE"), 7)
                            .when(m == "ES", 0).when(m == "US", 100000)
                            .when(m.isin("FR", "NL"), 40).cast("int"))


@query
def q_dedup_first(spark, sf):
    links = _links(spark, sf)
    return keep_first(links, ["market", "url"], ["captured_at", "page_num", "pos"]).select(
        "market", "url", "search_term", "page_num", "pos")


@query
def q_cap_per_term(spark, sf):
    capped = _placed(spark, sf, _caps(spark, sf))
    return capped.where(within_cap(F.col("seq"), F.col("max_items"))).select(
        *TERM, "page_num", "pos", "item_id", "seq")


@query
def q_chunks(spark, sf):
    return _placed(spark, sf).select(*TERM, "item_id", chunk_no(F.col("seq"), 5).alias("chunk"))


@query
def q_progress(spark, sf):
    capped = _placed(spark, sf, _caps(spark, sf))
    return capped.select(*TERM, "item_id", progress(F.col("seq"), F.col("max_items")).alias("progress"))


@query
def q_batches(spark, sf):
    batch = chunk_no(F.col("seq"), 50)
    return _placed(spark, sf).groupBy(*TERM, batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("rows")).withColumn(
        "snapshot", is_snapshot_batch(F.col("batch"), 20))


# --- summaries -------------------------------------------------------------

def _all_captures(spark, sf):
    cols = ["market", "search_term", "page_type", "page_num", "url", "status", "attempt", "error", "html",
            "captured_at"]
    return R.listing_captures(spark, sf).select(*cols).unionByName(
        R.search_captures(spark, sf).select(*cols))


@query
def q_run_summary(spark, sf):
    return run(_all_captures(spark, sf), _caps(spark, sf), R.rules(spark)).summary


@query
def q_run_store(spark, sf):
    """A later run, repeats dropped in the whole market: half of the listings are stored already."""
    captures = R.listing_captures(spark, sf)
    had = captures.where(F.col("item") % 2 == 0).select("market", "url")
    new = run(_all_captures(spark, sf), _caps(spark, sf), R.rules(spark), "market", had).stored
    return new.select(*TERM, "page_num", "url", "seq", "title")


@query
def q_run_account(spark, sf):
    """What became of every capture of a run."""
    account = run(_all_captures(spark, sf), _caps(spark, sf), R.rules(spark)).account
    return account.groupBy("market", "page_type", "fate").agg(F.count(F.lit(1)).alias("captures"))


@query
def q_run_saved_twice(spark, sf):
    """A run saved, saved again, and followed by a run over the same captures that knows the store."""
    captures, caps, rules, out = _all_captures(spark, sf), _caps(spark, sf), R.rules(spark), work_dir(spark, "saved")
    parsed = parse_captures(captures, rules)  # both runs read it
    first = run(captures, caps, rules, parsed=parsed)
    for _ in range(2):
        save_run(first, out + "/store", out + "/aside", "1")
    again = run(captures, caps, rules, store=spark.read.parquet(out + "/store/run=1"), parsed=parsed)
    parsed.unstage()
    fresh = again.stored.where(F.coalesce("max_items", F.lit(0)) == 0).agg(F.count(F.lit(1)).alias("again"))
    return spark.read.parquet(out + "/store/run=1").select(*TERM, "page_num", "url", "seq", "title").join(F.broadcast(fresh))


def _strange_markets(spark, sf):
    market = F.when(F.col("item") % 37 == 0, "JP").otherwise(F.col("market"))
    return R.listing_captures(spark, sf).withColumn("market", market)


def _failed_fetches(listings):
    z = F.col("item") % 17
    return (listings.withColumn("status", F.when(z == 5, 404).when(z != 6, 200))
            .withColumn("error", F.when(z == 6, "timeout")))


@query
def q_run_rejects(spark, sf):
    """Some captures failed, some were tried again, some are of a market without rules."""
    listings = _strange_markets(spark, sf)
    first = _failed_fetches(listings)
    again = listings.where(F.col("item") % 17 == 6).withColumn("attempt", F.lit(2))
    searches = R.search_captures(spark, sf)
    cols = CAPTURE.names
    captures = first.select(*cols).unionByName(again.select(*cols)).unionByName(searches.select(*cols))
    return run(captures, _caps(spark, sf), R.rules(spark)).rejects.select("market", "url", "attempt", "reason", "outcome")


@query
def q_store_totals(spark, sf):
    return store_totals(_key_rows(spark, sf), ["market"])


@query
def q_store_totals_merge(spark, sf):
    """q_store_totals after three batches, without a scan of what is stored."""
    rows, path = stage(_key_rows(spark, sf), "rows"), work_dir(spark, "totals") + "/parts"
    item = F.substring_index("url", "/", -1).cast("bigint")
    for i in (0, 1, 2, 1):  # one batch comes twice
        add_batch(rows.where(F.col("okey") % 3 == i), path, i, ["market"], item)
    return running_totals(spark, path, ["market"])


# --- streams ---------------------------------------------------------------

SLICES = 3


def _add_slice(spark, sf, path, i):
    """Add a third of the listing captures; whole search pages go together."""
    pages = R.listing_captures(spark, sf).drop("item")
    pages.where(F.col("page_num") % SLICES == i).write.mode("append").parquet(path)


def _stream_input(spark, sf, steps: list[int]) -> str:
    """A folder of captures that arrived in the given order."""
    path = work_dir(spark, "captures") + "/in"
    for i in steps:
        _add_slice(spark, sf, path, i)
    return path


def _products_from(spark, path):
    captures = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return flow.product_stream(captures, R.rules(spark))


def _run_upsert(spark, sf, caps=None, steps=(0, 1, 2)):
    """Slices arrive one by one; the stream runs after each, from where it stopped."""
    path, out = work_dir(spark, "captures") + "/in", work_dir(spark, "stream")
    store, checkpoint = out + "/store", out + "/checkpoint"
    flow.open_store(spark, store)
    for i in steps:
        _add_slice(spark, sf, path, i)
        flow.start_upsert(_products_from(spark, path), store, checkpoint,
                          caps=caps).awaitTermination()
    return store


@query
def q_stream_products(spark, sf):
    store = _run_upsert(spark, sf)
    return _flat_store_info(flow.read_store(spark, store)).drop("batch_id", "captured_at")


@query
def q_stream_flush(spark, sf):
    store = _run_upsert(spark, sf)
    return flow.read_store(spark, store).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))


@query
def q_stream_quarantine(spark, sf):
    """One start over a capture table without link places, in several batches: products and rejects."""
    path, out = work_dir(spark, "captures") + "/in", work_dir(spark, "stream")
    (_failed_fetches(_strange_markets(spark, sf)).select(*CAPTURE.names)
     .repartition(6, "url").write.parquet(path))
    rows = flow.product_stream(stream_captures(spark, path, files_per_trigger=2), R.rules(spark), rejects=True)
    flow.open_store(spark, out + "/store")
    flow.start_upsert(rows, out + "/store", out + "/checkpoint", quarantine_path=out + "/aside").awaitTermination()
    stored = flow.read_store(spark, out + "/store")
    batches = stored.agg((F.count_distinct("batch_id") > 1).alias("in_batches"))
    aside = spark.read.parquet(out + "/aside").select("market", "url", "title", "reason")
    return (stored.select("market", "url", "title", F.lit(None).cast("string").alias("reason"))
            .unionByName(aside.withColumn("title", F.when(F.col("reason") == "incomplete product", F.col("title"))))
            .join(F.broadcast(batches)))


def _stream_to_table(df, spark):
    out = work_dir(spark, "table")
    (df.writeStream.format("parquet").option("path", out + "/rows")
     .option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    return spark.read.schema(df.schema).parquet(out + "/rows")


@query
def q_stream_dedup(spark, sf):
    path = _stream_input(spark, sf, [0, 1, 0, 2])
    seen = flow.first_seen(_products_from(spark, path), ["market", "url"])
    return _stream_to_table(seen.select("market", "url", "title"), spark)


@query
def q_stream_cap(spark, sf):
    store = _run_upsert(spark, sf, caps=_stream_caps(spark, sf))
    return flow.read_store(spark, store).select("market", "search_term", "url")


def _stream_caps(spark, sf):
    return stage(R.listing_captures(spark, sf).select("market", "search_term").distinct()
                 .withColumn("max_items", F.when(F.col("market").isin("AU", "GB"), 5)
                             .when(F.col("market") == "US", 20).cast("int")), "caps")


@query
def q_stream_state_cap(spark, sf):
    """The caps of q_stream_cap, held as state of the stream: slices arrive one by one, no batch reads what is stored."""
    path, out, caps = work_dir(spark, "captures") + "/in", work_dir(spark, "state"), _stream_caps(spark, sf)
    for i in range(SLICES):
        _add_slice(spark, sf, path, i)
        kept = capped_stream(_products_from(spark, path), caps)
        with keyed_state(spark):
            query_ = (kept.writeStream.format("parquet").option("path", out + "/rows")
                      .option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start())
        query_.awaitTermination()
    return spark.read.schema(kept.schema).parquet(out + "/rows").select("market", "search_term", "url", "title")


def _heartbeat(spark, day):
    """Captures that hold nothing but a later time, which lets waiting rows out."""
    kinds = F.explode(F.array(F.lit("search"), F.lit("product")))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in CAPTURE.fields}
    return spark.range(1).select(kinds.alias("page_type")).select(*[
        {"market": F.lit("US"), "status": F.lit(200), "page_type": F.col("page_type"), "html": F.lit(""),
         "captured_at": F.timestamp_seconds(F.lit(1_600_000_000 + day * 86400))}.get(n, c).alias(n) for n, c in empty.items()])


@query
def q_stream_links(spark, sf):
    """Search and listing captures in one stream, several starts: links with their product, misses when their time is over."""
    path, out = work_dir(spark, "captures") + "/in", work_dir(spark, "links")
    searches = R.search_captures(spark, sf)
    # a crawler stops where paging ends, so later pages never arrive
    reached = reached_pages(stage(_facts(spark, sf).drop("hrefs"), "facts")).select(*TERM, "page_num")
    searches = searches.join(reached, [*TERM, "page_num"]).select(*CAPTURE.names)
    listings = R.listing_captures(spark, sf).withColumn("captured_at", F.col("captured_at") - F.expr("interval 100000000 seconds"))
    slices = [searches.where("page_num % 2 = 0").unionByName(listings.where("item % 2 = 1").select(*CAPTURE.names)),
              searches.where("page_num % 2 = 1").unionByName(listings.where("item % 2 = 0").select(*CAPTURE.names))]
    bound = "1000 days"
    for rows in [*slices, _heartbeat(spark, 10_000)]:
        rows.write.mode("append").parquet(path)
        captures = stream_captures(spark, path)
        joined = linked_products(link_stream(captures, R.rules(spark), bound), listing_stream(captures, R.rules(spark), bound), bound, bound)
        (joined.writeStream.format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(joined.schema).parquet(out + "/rows").select(*TERM, "item_id", "url", "title", "current_price", "missing")


def _run_keyed(spark, stream, out):
    """One start of a stream that keeps keyed state, until it has read all there is."""
    with keyed_state(spark):
        started = (stream.writeStream.format("parquet").option("path", out + "/rows")
                   .option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start())
    started.awaitTermination()


@query
def q_stream_page_reach(spark, sf):
    """q_page_reach from search pages that arrive last page first, in several starts; a much later page lets the terms close."""
    path, out = work_dir(spark, "captures") + "/in", work_dir(spark, "paging")
    facts = stage(_facts(spark, sf).drop("hrefs"), "facts")
    holes = facts.where(~((F.col("page_num") == 7) & F.col("market").isin("AU", "US")))
    later = facts.limit(1).withColumns({"market": F.lit("later"), "page_num": F.lit(0).cast(facts.schema["page_num"].dataType) + 1,
                                        "captured_at": F.col("captured_at") + F.expr("interval 20000 days")})
    slices = [holes.where(F.col("page_num") % SLICES == i) for i in (2, 0, 1)]
    for rows in [*slices, later]:
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(facts.schema).parquet(path)
        _run_keyed(spark, reached_stream(stream, silence=86400, delay="10000 days"), out)
    done = spark.read.parquet(out + "/rows").where("market <> 'later'")
    closed = done.where("ended is not null").select(*TERM, F.col("page_num").alias("last_page"))
    return (done.where("ended is null").join(closed, TERM).where(F.col("page_num") <= F.col("last_page"))
            .select(*TERM, "page_num", "n_links", "has_next"))


@query
def q_stream_outcome(spark, sf):
    """q_capture_outcome from attempts that arrive out of order; each page gives its row when no attempt came for a day."""
    path, out = work_dir(spark, "attempts") + "/in", work_dir(spark, "outcomes")
    log = stage(_attempts(spark, sf).select("user_id", "attempt", "attempt_class", "error", F.col("ts").cast("timestamp").alias("captured_at")), "log")
    later = log.limit(1).withColumns({"user_id": F.lit(-1).cast(log.schema["user_id"].dataType),
                                      "captured_at": F.col("captured_at") + F.expr("interval 20000 days")})
    for rows in [log.where("attempt % 2 = 0"), log.where("attempt % 2 = 1"), later]:
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(log.schema).parquet(path)
        _run_keyed(spark, outcome_stream(stream, "user_id", silence=86400, delay="10000 days"), out)
    return spark.read.parquet(out + "/rows").where("user_id <> -1")


@query
def q_stream_reset(spark, sf):
    """Two runs over the same captures: each starts with nothing seen."""
    path = _stream_input(spark, sf, [0, 1, 2, 0])
    runs = _products_from(spark, path).select("market", "search_term", "url", "captured_at",
                           F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id"))
    seen = flow.first_seen(runs, ["run_id", "market", "search_term", "url"])
    return _stream_to_table(seen, spark).groupBy("run_id", "market", "search_term").agg(
        F.count(F.lit(1)).alias("products"))


@query
def q_stream_resume(spark, sf):
    """Starts and stops after every slice; the last one repeats captures already stored."""
    store = _run_upsert(spark, sf, steps=(0, 1, 2, 0))
    return flow.read_store(spark, store).select("market", "search_term", "url", "title")
