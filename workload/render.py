"""Captured pages rendered from the given tables, with known field values.

No marketplace pages are among the test tables, so listing pages are rendered
from ``part`` and ``supplier`` and search pages from ``orders`` and
``lineitem``.  What varies is a function of the key, so SQL over the same tables
says what extraction must return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.reuse import reused
from pagemill.functions.urls import search_url
from pagemill.operators.sequence import positioned
from pagemill.plans.rules import MARKET_KEYS, market_rules, with_rules

# Rendered pages are a few thousand characters, so the checks use this minimum.
MIN_LENGTH = 1500


def spread(rows: DataFrame) -> DataFrame:
    """Rendering makes each key row a hundred times wider, so key rows are spread first."""
    return rows.repartition(max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    return market_rules(spark, min_length=MIN_LENGTH)


def market_of(key: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MARKET_KEYS]), (key % 10).cast("int"))


def _s(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _html(*parts) -> Column:
    return F.concat(*[_s(p) for p in parts])


def _if(cond: Column, then, other="") -> Column:
    return F.when(cond, _s(then)).otherwise(_s(other))


@reused
def listing_html() -> Column:
    """One listing page from a ``part`` row joined to its ``supplier``."""
    k, market = F.col("p_partkey"), F.col("market")
    size = F.col("p_size").cast("string")
    brand, kind, seller = F.col("p_brand"), F.col("p_type"), F.col("s_name")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    price = _html("US $", F.floor(cents / 100).cast("string"), ".",
                  F.lpad((cents % 100).cast("string"), 2, "0"))
    is_fr, is_it = market == "FR", market == "IT"

    title = _html(
        '<div class="x-item-title">',
        _if(k % 41 != 0, _html('<h1 class="x-item-title__mainTitle"><span class="ux-textspans">\n&nbsp;',
                               F.col("p_name"), " <b>No.</b>", k.cast("string"),
                               " &amp; more&#160;</span></h1>")),
        _if(k % 3 != 0, _html('<div class="x-item-title__subTitle"><span>', kind,
                              " edition</span></div>")),
        "</div>")

    was = _if(k % 2 == 0, _html(
        '<span class="ux-textspans ux-textspans--STRIKETHROUGH">US $9', size, "</span>"))
    off = _html(size, "% off")
    deal = (
        F.when(k % 4 == 0, _html('<span class="ux-textspans ux-textspans--EMPHASIS"> (', off, ")</span>"))
        .when(k % 4 == 1, _html('<span class="ux-textspans--SECONDARY">', off, "</span>"))
        .when(k % 4 == 2, _html("<span class='ux-textspans--EMPHASIS'>Save big</span>",
                                '<span class="ux-textspans--SECONDARY">', off, "</span>"))
        .otherwise(F.lit("")))
    boxed = k % 8 < 4
    money = _html(
        '<div class="x-price-section" data-x="a>b">',
        _if(k % 43 != 0, _html('<div class="x-price-primary"><span class="ux-textspans">', price,
                               "</span><br></div>")),
        _if(boxed, '<div class="x-price-transparency"><span class="x-price-transparency--discount">'),
        was, deal, _if(boxed, "</span></div>"), "</div>")

    quantity = _if(k % 7 != 0, _html(
        '<div class="x-quantity__availability"><span class="ux-textspans">', size,
        " available</span> / ",
        _if(k % 3 != 1, _html('<span class="ux-textspans">', (k % 97).cast("string"),
                              " sold</span>")), "</div>"))

    strong = _if((F.floor(k / 10) % 2) == 0, _html(
        '<span class="ux-textspans ux-textspans--POSITIVE ux-textspans--BOLD">Free ', size,
        _if(is_fr, ".."), "</span> "))
    location = F.when(is_fr, _if(k % 20 < 10, "Lieu où se trouve l'objet : ")).when(
        is_it, _if(k % 3 != 0, "Oggetto che si trova a:")).when(
        market.isin("DE", "ES", "MX"),
        F.when(k % 3 == 0, "Located in:").when(k % 3 == 1, "Ubicado en: ").otherwise("")
    ).otherwise(_if(k % 3 != 0, "Located in: "))
    content = _html(
        '<div class="ux-labels-values__values-content"><div>', strong,
        '<span class="ux-textspans">Tip<span class="clipped">x</span></span>',
        '<span class="ux-textspans">Standard ', seller, '.</span>',
        '<span class="ux-textspans"> . </span><span class="ux-textspans clipped">hidden</span>',
        '<span class="ux-textspans"><a href="#">See details</a></span>',
        '<span class="ux-textspans__custom-view ux-textspans">cv</span></div>',
        '<div><span class="ux-textspans ux-textspans--SECONDARY">', location, seller,
        " Town</span></div></div>")
    shipping = _if((k % 13 != 0) | (k % 11 == 0), _html(
        '<div class="d-shipping-minview"><div class="ux-layout-section__row">',
        '<div class="ux-labels-values-with-hints" data-testid="ux-labels-values-with-hints">',
        '<div class="ux-labels-values ux-labels-values--shipping">',
        '<div class="ux-labels-values__labels"><span class="ux-textspans">Shipping:</span></div>',
        '<div class="ux-labels-values__values">', _if(k % 11 != 0, content),
        "</div></div></div></div></div>"))

    returns = _if(k % 17 != 0, _html(
        '<div class="', _if(k % 20 < 10, "vim "), 'x-returns-minview"><div class="ux-labels-values__values">',
        '<div class="ux-labels-values__values-content"><span class="ux-textspans">', size,
        ' days</span><span class="ux-textspans ux-textspans--EMPHASIS">returns\n  accepted</span>',
        '<span class="ux-textspans">&nbsp;.</span><span class="ux-textspans">Seller pays .</span>',
        '<span class="ux-textspans clipped">hidden</span><span class="ux-textspans">',
        _if(is_it, "Vedi i dettagli", "See details"), "</span>",
        _if(is_fr, '<span class="ux-textspans">Afficher plus</span>'), "</div></div></div>"))

    condition = _if(k % 5 != 0, _html(
        '<div class="x-item-condition-max-view"><div class="ux-section__item">',
        '<p><span class="ux-textspans">decoy</span></p><span class="ux-textspans">',
        _if(k % 2 == 0, "New", "Used"), ". Opened ", kind, "</span></div></div>"))

    def spec(layout: Column, dl_name: Column, div_name: Column, plain: str, value: Column) -> Column:
        dl = _html('<dl class="ux-labels-values ux-labels-values--', dl_name,
                   '"><dt><span class="ux-textspans">x</span></dt><dd>')
        div = _html('<div class="ux-labels-values ux-labels-values--', div_name,
                    '"><div class="ux-labels-values__labels"><span class="ux-textspans">x</span></div>',
                    '<div class="ux-labels-values__values"><span class="ux-textspans">', value,
                    "</span></div></div>")
        return (F.when(layout == 0, _html(dl, '<span class="ux-textspans">', value, "</span></dd></dl>"))
                .when(layout == 1, div)
                .otherwise(_html('<dl class="ux-labels-values--', _s(plain), '"><dd>-</dd></dl>', div)))

    specs = _html(
        spec(k % 3, F.when(is_fr & (k % 20 < 10), "marque").when(is_it, "marca").otherwise("brand"),
             F.lit("brand"), "brand", brand),
        spec((k + 1) % 3, F.when(is_fr, "style").when(is_it, "stile").otherwise("type"),
             _if(is_fr, "kind", "type"), "type", kind))

    store = _if(k % 19 != 0, _html(
        '<div class="x-store-information__header"><span class="ux-textspans ux-textspans--BOLD">',
        seller, '</span><h4 class="x-store-information__highlights"><span class="ux-textspans">',
        size, ' items</span><span class="ux-textspans">', (k % 100).cast("string"),
        '% positive feedback</span><span class="ux-textspans ux-textspans--SECONDARY">',
        (k % 1000).cast("string"), "</span>",
        _if(k % 6 != 0, '<span class="ux-textspans--SECONDARY">items sold</span>'), "</h4></div>"))

    page = _html(
        '<!DOCTYPE html><html><head><title>listing</title><meta charset="utf-8">',
        "<script>var a = '</div><div class=\"x-item-title\">';</script>",
        '<!-- <div class="x-price-section"> --></head><body><p>Hello <b>there<ul><li>a<li>b</ul>',
        _if(k % 59 == 0, "<p>Please pass the ROBOT check</p>"),
        title, _if(k % 47 != 0, money), quantity, shipping, returns, condition, specs, store,
        "<footer><p>", F.repeat(F.lit("Lorem ipsum dolor. "), 20), "</footer></body></html>")
    return F.when(k % 53 == 0, F.lit("<html><body>gone</body></html>")).otherwise(page)


def listing_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetched listing page per part (capture columns plus ``item`` and ``pos``)."""
    k = F.col("p_partkey")
    market = market_of(k)
    base = rules(spark).select("market", "base_url")
    suppliers = table(spark, sf_dir, "supplier")
    parts = (table(spark, sf_dir, "part").withColumn("market", market)
             .withColumn("_seller", k % max(1, suppliers.count())))
    sellers = suppliers.select(F.col("s_suppkey").alias("_seller"), "s_name")
    return (
        spread(parts.join(sellers, "_seller").join(F.broadcast(base), "market"))
        .select("market", F.lower("p_type").alias("search_term"),
                F.lit("product").alias("page_type"),
                (F.floor(k / 240) + 1).cast("int").alias("page_num"),
                F.concat("base_url", F.lit("/itm/"), k.cast("string")).alias("url"),
                F.lit(200).alias("status"), F.lit(1).alias("attempt"),
                F.lit(None).cast("string").alias("error"),
                listing_html().alias("html"),
                F.timestamp_seconds(F.lit(1_700_000_000) + k).alias("captured_at"),
                k.alias("item"), (k % 240).cast("int").alias("pos")))


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> (market, search_term, page_num, o_orderkey): one search page per order."""
    orders = table(spark, sf_dir, "orders").select(
        F.lower("o_orderpriority").alias("search_term"), market_of(F.col("o_orderkey")).alias("market"),
        "o_orderkey", F.floor(F.col("o_orderkey") / 1000).alias("_far"))
    return positioned(orders, ["market", "search_term"], "_far", ["o_orderkey"], "page_num").drop("_far")


def search_links_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, rows of links in order): what each search page lists."""
    item = (F.col("l_partkey") - F.col("l_partkey") % 10 + F.col("l_orderkey") % 10)
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("item"))
    # a page lists at most the lines of one order
    return (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(row)).alias("_lines")))


def search_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetched search page per order."""
    pages = search_pages(spark, sf_dir)
    lines = search_links_truth(spark, sf_dir)
    base = rules(spark).select("market", "base_url")
    key = F.col("o_orderkey")
    state = key % 97 - 90

    def entry(line: Column) -> Column:
        return _html('<li class="s-item s-item__pl"><a target=_blank class="s-item__link" href="', F.col("base_url"),
                     "/itm/", line["item"].cast("string"), "?hash=", line["l_suppkey"].cast("string"),
                     '&amp;n=1"><span>item</span></a></li>')

    links = F.array_join(F.transform(F.coalesce("_lines", F.array().cast(
        "array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,item:bigint>>")), entry), "")
    link_full, link_bare = '<a type="next" href="?p=2">Next</a>', '<a type="next">Next</a>'
    button_on, button_off = ('<button type="next">N</button>',
                             '<button type="next" aria-disabled="true">N</button>')
    control = (F.when(state == 1, link_bare).when(state == 2, button_on).when(state == 3, button_off)
               .when(state == 4, "").when(state == 5, link_full + button_off)
               .when(state == 6, link_bare + button_off).otherwise(link_full))
    html = _html(
        "<html><head><title>search</title></head><body><ul class='srp-results srp-list'>",
        '<li class="s-item"><a class="s-item__link" href="/help?x=1">ad</a></li>', links,
        '</ul><a class="plain" href="/itm/999">no</a><nav>', control, "</nav><p>",
        F.repeat(F.lit("Lorem ipsum dolor. "), 80), "</body></html>")
    return (
        spread(pages.join(lines, key == F.col("l_orderkey"), "left")
               .join(F.broadcast(base), "market"))
        .select("market", "search_term", F.lit("search").alias("page_type"),
                F.col("page_num").cast("int").alias("page_num"),
                search_url(F.col("base_url"), F.col("search_term"), F.col("page_num")).alias("url"),
                F.lit(200).alias("status"), F.lit(1).alias("attempt"),
                F.lit(None).cast("string").alias("error"), html.alias("html"),
                F.timestamp_seconds(F.lit(1_600_000_000) + key).alias("captured_at"),
                key.alias("o_orderkey")))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing captures with their market's rules."""
    return with_rules(listing_captures(spark, sf_dir), rules(spark))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search captures with their market's rules."""
    return with_rules(search_captures(spark, sf_dir), rules(spark))
