"""The market dimension (S5, J4): one small row of rules per market.

Everything that differs between markets is a value in this table, so all
markets run through one plan.  The table has one row per market (ten), which is
what makes broadcasting it safe.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Page checks, the same in every market.
MIN_LENGTH = 50_000
ERROR_TEXTS = [
    "Sorry, the page you requested was not found",
    "This listing was ended",
    "Security Measure",
    "Robot Check",
]
BLOCKED_TEXTS = ["Robot Check", "Security Measure"]
REQUIRED = {
    "search": ["ul.srp-results", "li.s-item"],
    "product": ["div.x-item-title", "div.x-price-section"],
}
RETRY_STATUSES = [408, 429, 500, 502, 503, 504]
RETRY_ERRORS = ["timeout", "connection"]
MAX_ATTEMPTS = 3


@dataclass(frozen=True)
class MarketRule:
    market: str
    host_suffix: str
    verdict: str = "long"
    price: str = "standard"
    discount: str = "standard"
    ship_root: str = "row"
    shipping: str = "uk_ca"
    location: str = "marker"
    returns: str = "standard"
    condition: str = "first_sentence"
    spec: str = "dl_div"
    feedback: str = "first"
    store: str = "header"
    next_page: str = "link_then_button"
    retry_any_status: bool = False


_ES = dict(host_suffix=".es", shipping="es", location="second_div")

# DE carries the ES rules and the ES site until rules of its own exist.
MARKETS = [
    MarketRule("AU", ".com.au", ship_root="any", shipping="au", location="prefix"),
    MarketRule("CA", ".ca"),
    MarketRule("DE", **_ES),
    MarketRule("ES", **_ES),
    MarketRule("FR", ".fr", shipping="fr", location="last_div", returns="fr", spec="fr",
               store="blank", next_page="button_then_href"),
    MarketRule("GB", ".co.uk", next_page="link"),
    MarketRule("IT", ".it", ship_root="any", shipping="it", location="it", returns="it",
               spec="it"),
    MarketRule("MX", ".com.mx", price="mx", discount="mx", shipping="mx",
               location="second_div"),
    MarketRule("NL", ".nl", discount="emphasis", ship_root="minview", shipping="nl",
               location="first_div", returns="none", condition="whole", spec="div",
               next_page="link_or_open_button", retry_any_status=True),
    MarketRule("US", ".com", verdict="short", ship_root="minview", shipping="us",
               location="every_div", spec="dl", feedback="positive",
               next_page="href_or_open_button"),
]
MARKET_KEYS = [m.market for m in MARKETS]

RULE_COLUMNS = ["verdict", "price", "discount", "ship_root", "shipping", "location",
                "returns", "condition", "spec", "feedback", "store", "next_page",
                "retry_any_status"]


def market_rules(spark: SparkSession, site: str = "marketplace",
                 min_length: int = MIN_LENGTH) -> DataFrame:
    """The rule table; ``site`` is the host name between 'www.' and the market suffix."""
    text_rules = [f.name for f in fields(MarketRule)
                  if f.name not in ("market", "host_suffix", "retry_any_status")]
    names = ["market", "host_suffix", *[f"{n}_rule" for n in text_rules], "retry_any_status"]
    rows = spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, astuple(m))]) for m in MARKETS])))
    required = F.create_map(*[
        part for kind, sels in REQUIRED.items()
        for part in (F.lit(kind), F.array(*[F.lit(s) for s in sels]))])
    return rows.select(
        "market",
        F.concat(F.lit(f"https://www.{site}"), F.col("host_suffix")).alias("base_url"),
        F.lit(min_length).alias("min_length"),
        F.array(*[F.lit(t) for t in ERROR_TEXTS]).alias("error_texts"),
        required.alias("required"),
        *[f"{n}_rule" for n in text_rules], "retry_any_status")


def with_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the rules of each row's market; rows of unknown markets drop out."""
    return df.join(F.broadcast(rules), "market")


def unknown_markets(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose market has no rules, for quarantine."""
    return df.join(F.broadcast(rules.select("market")), "market", "left_anti")
