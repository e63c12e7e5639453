"""Product fields from a parsed page.

A page is first cut down to the few sections the rules look at; the element and
text arrays of the whole page are dropped there.  Each field is then one
expression over a small section array, with the market's variant chosen by its
rule code.  The whole extraction is a chain of projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import select as S
from pagemill.functions import text as X
from pagemill.functions.markup import let
from pagemill.functions.reuse import reused
from pagemill.schemas import TEXT_FIELDS

# The class names and phrases the rules refer to.
SPAN = "ux-textspans"
BOLD = "ux-textspans--BOLD"
POSITIVE = "ux-textspans--POSITIVE"
EMPHASIS = "ux-textspans--EMPHASIS"
SECONDARY = "ux-textspans--SECONDARY"
STRIKETHROUGH = "ux-textspans--STRIKETHROUGH"
CUSTOM_VIEW = "ux-textspans__custom-view"
CLIPPED = "clipped"
VALUES_CONTENT = "ux-labels-values__values-content"
VALUES = "ux-labels-values__values"
LABELS = "ux-labels-values--"
BRAND_NAMES = ["brand", "marque", "marca", "marke"]
TYPE_NAMES = ["type", "style", "kind", "stile", "stil"]
PAGE_MARKS = [
    "x-item-title", "x-price-section", "x-quantity__availability", "d-shipping-minview",
    "ux-layout-section__row", "ux-labels-values-with-hints", LABELS + "shipping",
    "x-returns-minview", "x-item-condition-max-view", "x-store-information__header",
] + [LABELS + n for n in BRAND_NAMES + TYPE_NAMES]
NO_SHIPPING = "No shipping info found"
LOCATION_PREFIXES_FR = ["Located in:", "Ubicado en:", "Lieu où se trouve l'objet : ",
                        "Lieu où se trouve l'objet&nbsp;:"]
LOCATION_IT = "Oggetto che si trova a:"
DETAILS_IT = "Vedi i dettagli"
EXCLUDED_IT = [DETAILS_IT, LOCATION_IT, "Ricevilo tra", "per la spedizione"]
DETAILS = "See details"
DETAILS_ES = "Ver detalles"

_span = S.has_class(SPAN, "span")
_secondary = S.has_class(SECONDARY, "span")


def _section(root: Column) -> Column:
    """The element and everything below it, with text where a rule may read it."""
    def node(e: Column) -> Column:
        reads_text = (e["tag"] == "span") | F.array_contains(e["classes"], SPAN)
        return F.struct(
            *[e[c].alias(c) for c in ("eid", "last", "parent", "child_no", "last_child",
                                      "tag", "classes")],
            F.when(reads_text, S.text(F.col("texts"), e)).alias("text"))

    return F.transform(S.subtree(F.col("els"), root), node)


@reused
def _section_columns() -> tuple[dict[str, Column], ...]:
    """Columns to add, step by step, on the way from the page to its sections."""
    marks = F.col("_marks")

    def mark(pred) -> Column:
        return S.first_where(marks, pred)

    names = F.array(*[F.lit(n) for n in PAGE_MARKS])
    marked = S.all_where(F.col("els"), lambda e: F.arrays_overlap(e["classes"], names))

    # div.row div.hints[data-testid=..] div.--shipping below the shipping view
    hints = S.below(marks, S.has_class("ux-layout-section__row", "div"), S.both(
        S.has_class("ux-labels-values-with-hints", "div"),
        S.has_attribute("data-testid", "ux-labels-values-with-hints", "div")))
    shipping_label = S.has_class(LABELS + "shipping", "div")
    row_label = let(hints, lambda outs: S.first_where(marks, lambda e: (
        shipping_label(e) & S.contains(F.col("_view"), e) & S.inside_any(outs)(e))))
    view = mark(S.has_class("d-shipping-minview", "div"))
    ship = (F.when(F.col("ship_root_rule") == "minview", F.col("_view"))
            .when(F.col("ship_root_rule") == "any", mark(shipping_label))
            .otherwise(row_label))
    content = S.first_where(S.descendants(F.col("els"), F.col("_ship")),
                            S.has_class(VALUES_CONTENT, "div"))
    returns_mark = F.when(
        F.col("returns_rule") == "it", mark(S.has_all_classes(["vim", "x-returns-minview"], "div"))
    ).otherwise(mark(S.has_class("x-returns-minview", "div")))

    def spec(e: Column) -> Column:
        below = S.subtree(F.col("els"), e)
        def holder(h: Column) -> Column:
            return F.when(e["tag"] == "dl", h["tag"] == "dd").otherwise(S.has_class(VALUES)(h))

        value = S.first(let(below, lambda b: S.below(b, holder, S.has_class(SPAN))))
        return F.struct(e["tag"].alias("tag"), e["classes"].alias("classes"),
                        S.text(F.col("texts"), value).alias("value"))

    spec_classes = F.array(*[F.lit(LABELS + n) for n in BRAND_NAMES + TYPE_NAMES])
    specs = F.transform(
        S.all_where(marks, lambda e: e["tag"].isin("dl", "div")
                    & F.arrays_overlap(e["classes"], spec_classes)), spec)
    conditions = S.all_where(marks, S.has_class("x-item-condition-max-view", "div"))

    # A shipping view inside a div that is the last child somewhere above it.
    in_last_div = F.exists(F.col("els"), S.both(
        S.is_tag("div"), S.last_child(),
        lambda e: (e["eid"] <= F.col("_content")["eid"])
        & (e["last"] >= F.col("_content")["eid"])))

    sections = {
        "s_title": _section(mark(S.has_class("x-item-title", "div"))),
        "s_price": _section(mark(S.has_class("x-price-section", "div"))),
        "s_quantity": _section(mark(S.has_class("x-quantity__availability", "div"))),
        "s_ship": _section(F.col("_ship")),
        "s_in_last_div": F.when(F.col("location_rule") == "last_div", in_last_div),
        "s_returns": _section(returns_mark),
        "s_condition": F.flatten(F.transform(conditions, _section)),
        "s_store": _section(mark(S.has_class("x-store-information__header", "div"))),
        "s_specs": specs,
    }
    return {"_marks": marked}, {"_view": view}, {"_ship": ship}, {"_content": content}, sections


def with_sections(parsed: DataFrame) -> DataFrame:
    """Replace ``els`` and ``texts`` by one small array per section."""
    *steps, sections = _section_columns()
    found = parsed
    for step in steps:
        found = found.withColumns(step)
    return found.select(*[c for c in parsed.columns if c not in ("els", "texts")],
                        *[c.alias(n) for n, c in sections.items()])


def _text(el: Column) -> Column:
    return el["text"]


def _texts(els: Column) -> Column:
    return F.transform(els, lambda e: e["text"])


def _span_below(sec: Column, outer, inner=S.is_tag("span")) -> Column:
    """First span below some element matching ``outer``."""
    return S.first(S.below(sec, outer, inner))


def _by_rule(column: str, variants: dict[str, Column], default: Column | None = None) -> Column:
    rule = F.col(f"{column}_rule")
    out = None
    for name, value in variants.items():
        out = F.when(rule == name, value) if out is None else out.when(rule == name, value)
    return out if default is None else out.otherwise(default)


@reused
def title_fields() -> dict[str, Column]:
    """F1, F2"""
    sec = F.col("s_title")
    return {
        "title": _text(_span_below(sec, S.has_class("x-item-title__mainTitle", "h1"))),
        "subtitle": _text(_span_below(sec, S.has_class("x-item-title__subTitle", "div"))),
    }


@reused
def price_fields() -> dict[str, Column]:
    """F3, F4, F5"""
    sec = F.col("s_price")
    primary = S.has_class("x-price-primary", "div")
    box = S.first(S.below_first(sec, S.has_class("x-price-transparency", "div"),
                                S.has_class("x-price-transparency--discount", "span")))

    def in_box(name: str) -> Column:
        return _text(let(box, lambda b: S.first_where(
            sec, lambda e: S.has_class(name, "span")(e) & S.contains(b, e))))

    def plain(name: str) -> Column:
        return _text(S.first_where(sec, S.has_class(name, "span")))

    return {
        "current_price": _by_rule("price", {"mx": _text(_span_below(sec, primary, _span))},
                                  _text(_span_below(sec, primary))),
        "was_price": _by_rule("price", {"mx": in_box(STRIKETHROUGH)}, plain(STRIKETHROUGH)),
        # Emphasis text without a percentage does not fall back to the other span.
        "discount": _by_rule("discount", {
            "mx": in_box(EMPHASIS),
            "emphasis": X.first_percent(plain(EMPHASIS)),
        }, X.first_percent(F.coalesce(plain(EMPHASIS), plain(SECONDARY)))),
    }


@reused
def quantity_fields() -> dict[str, Column]:
    """F6, F7"""
    spans = S.all_where(F.col("s_quantity"), _span)
    return {"availability": _text(S.nth(spans, 0)), "sold_count": _text(S.nth(spans, 1))}


def with_shipping_parts(sections: DataFrame) -> DataFrame:
    """Cut the shipping section into the arrays the shipping and location rules share."""
    sec = F.col("s_ship")
    content = S.first_where(S.all_where(sec, lambda e: e["eid"] > S.first(sec)["eid"]),
                            S.has_class(VALUES_CONTENT, "div"))
    lead = F.when(F.col("shipping_rule") == "fr",
                  S.first_where(F.col("c_els"), S.both(S.is_tag("div"), S.nth_child(1)))
                  ).otherwise(S.first_where(F.col("c_els"), S.is_tag("div")))
    return (
        sections
        .withColumn("c_box", content)
        .withColumn("c_els", S.all_where(sec, lambda e: S.contains(F.col("c_box"), e)))
        .withColumn("c_lead", lead)
        .withColumn("c_lead_els",
                    S.all_where(F.col("c_els"), lambda e: S.contains(F.col("c_lead"), e)))
    )


def _readable(e: Column, *phrases: str) -> Column:
    out = (e["text"] != "") & ~X.is_noise(e["text"])
    for p in phrases:
        out = out & ~F.contains(e["text"], F.lit(p))
    return out


def _without(e: Column, *names: str) -> Column:
    """E17"""
    out = F.lit(True)
    for n in names:
        out = out & ~F.array_contains(e["classes"], n)
    return out


@reused
def shipping_field() -> dict[str, Column]:
    """F8"""
    box, els, lead = F.col("c_box"), F.col("c_els"), F.col("c_lead")
    lead_els = F.col("c_lead_els")
    has_box = box.isNotNull()

    def joined(spans: Column) -> Column:
        return X.join_parts(_texts(F.coalesce(spans, F.array().cast(_SECTION))))

    us = joined(S.all_where(lead_els, lambda e: _span(e) & _readable(e, DETAILS)
                            & _without(e, CLIPPED, CUSTOM_VIEW)))

    uk = joined(S.all_where(els, lambda e: _span(e) & _readable(e, DETAILS)))
    uk = X.drop_trailing_dot(X.before_marker(uk, "Located in:"))

    # Direct children of the lead div with no help bubble or clipped span inside.
    unwanted = S.either(S.has_class("ux-bubble-help"), S.has_class(CLIPPED, "span"))
    es = joined(let(S.all_where(lead_els, unwanted), lambda bad: S.all_where(
        lead_els, lambda e: _span(e) & S.child_of(lead)(e)
                            & _readable(e, DETAILS, DETAILS_ES)
                            & (F.coalesce(F.get(e["classes"], F.lit(0)), F.lit("")) != CUSTOM_VIEW)
                            & ~F.exists(bad, lambda b: S.contains(e, b)))))
    es = X.drop_trailing_dot(es)

    fr_parts = S.all_where(lead_els, S.both(
        S.class_has_substrings([BOLD, POSITIVE], "span", need_all=False), _readable))
    fr = F.when(F.size(fr_parts) > 0, X.drop_trailing_dots(joined(fr_parts)))

    strong = S.all_where(els, lambda e: S.has_all_classes([POSITIVE, BOLD], "span")(e)
                         & (e["text"] != "") & ~e["text"].startswith(DETAILS_IT))
    pudo = F.array(F.lit("ux-labels-values--pudo"))

    def grandparent_is_pudo(e: Column) -> Column:
        """E19"""
        sec = F.col("s_ship")
        base = S.first(sec)["eid"]
        up = F.get(sec, F.get(sec, e["parent"] - base)["parent"] - base)
        return F.coalesce(up["classes"] == pudo, F.lit(False))

    other = S.all_where(els, lambda e: _span(e) & (e["text"] != "")
                        & ~X.contains_any(e["text"], EXCLUDED_IT)
                        & _without(e, SECONDARY) & ~grandparent_is_pudo(e))
    it_parts = F.when(F.size(strong) > 0, strong).otherwise(other)
    it = F.when(F.size(it_parts) > 0, X.collapse(joined(it_parts)))

    lead_strong = S.first_where(lead_els, S.class_has_substrings(
        [POSITIVE, BOLD], "span", need_all=True))
    au_parts = S.all_where(lead_els, lambda e: _span(e) & _readable(e, DETAILS)
                           & _without(e, CLIPPED))
    au = F.when(lead_strong.isNotNull(), _text(lead_strong)).when(
        F.size(au_parts) > 0, joined(au_parts))

    nl = joined(S.all_where(els, lambda e: _span(e) & (e["text"] != "")
                            & ~X.is_noise(e["text"], X.NOISE_NL)))
    has_row = F.col("s_ship").isNotNull()
    return {"shipping": _by_rule("shipping", {
        "us": F.when(has_box, X.drop_trailing_dot(us)),
        "uk_ca": F.when(has_box, uk),
        "es": F.when(has_box, es).when(has_row, NO_SHIPPING),
        "mx": F.when(has_box, es),
        "fr": F.coalesce(F.when(has_box, fr), F.lit(NO_SHIPPING)),
        "it": F.when(has_box, it).when(~has_row, NO_SHIPPING),
        "au": F.when(has_box, au),
        "nl": F.when(has_box, nl),
    })}


@reused
def location_field() -> dict[str, Column]:
    """F9"""
    els, sec = F.col("c_els"), F.col("s_ship")
    labels = S.all_where(els, _secondary)
    divs = let(labels, lambda ls: S.all_where(els, lambda e: (e["tag"] == "div")
                                              & F.exists(ls, lambda s: S.contains(e, s))))

    def label_in(outer: Column) -> Column:
        return _text(let(outer, lambda o: S.first_where(
            els, lambda e: _secondary(e) & S.contains(o, e))))

    row_label = _text(_span_below(sec, S.has_class(VALUES_CONTENT, "div"), _secondary))
    marker = F.when(F.contains(row_label, F.lit("Located in:")),
                    X.after_last_marker(row_label, "Located in:"))

    second = label_in(S.first_where(els, S.both(S.is_tag("div"), S.nth_child(2))))
    second = (F.when(F.contains(second, F.lit("Located in:")),
                     X.after_last_marker(second, "Located in:"))
              .when(F.contains(second, F.lit("Ubicado en:")),
                    X.after_last_marker(second, "Ubicado en:"))
              .otherwise(second))

    fr = _text(F.when(F.col("s_in_last_div"), S.first(labels)).otherwise(
        _span_below(els, S.both(S.is_tag("div"), S.last_child()), _secondary)))
    fr_cut = None
    for p in LOCATION_PREFIXES_FR:
        hit, cut = F.contains(fr, F.lit(p)), X.after_last_marker(fr, p)
        fr_cut = F.when(hit, cut) if fr_cut is None else fr_cut.when(hit, cut)

    it = _text(S.first_where(els, lambda e: _secondary(e)
                             & F.contains(e["text"], F.lit(LOCATION_IT))))
    return {"location": _by_rule("location", {
        "every_div": X.after_colon(label_in(S.last(divs))),
        "first_div": X.after_colon(label_in(S.first(divs))),
        "marker": marker,
        "second_div": second,
        "last_div": F.coalesce(F.nullif(fr_cut, F.lit("")), fr),
        "it": X.after_last_marker(it, LOCATION_IT),
        "prefix": X.remove_prefixed(_text(S.first(labels)), "Located in: "),
    })}


@reused
def returns_field() -> dict[str, Column]:
    """F10"""
    sec = F.col("s_returns")
    is_box = S.has_class(VALUES_CONTENT, "div")

    def parts(phrase: str) -> Column:
        return S.below_first(sec, is_box, lambda e: _span(e) & _readable(e, phrase)
                             & _without(e, CLIPPED))

    def tidy(x: Column) -> Column:
        return X.close_dots(X.collapse(x))

    def joined(spans: Column) -> Column:
        return X.join_parts(_texts(spans))

    has_box = F.exists(sec, is_box)
    fr = parts(DETAILS)
    return {"returns": _by_rule("returns", {
        "none": F.lit(None).cast("string"),
        "it": F.when(has_box, tidy(joined(parts(DETAILS_IT)))),
        "fr": F.when(has_box & (F.size(fr) > 0), tidy(X.before_marker(joined(fr), "Afficher"))),
    }, F.when(has_box, tidy(joined(parts(DETAILS)))))}


@reused
def condition_field() -> dict[str, Column]:
    """F11"""
    sec = F.col("s_condition")
    items = S.below(sec, S.has_class("x-item-condition-max-view", "div"),
                    S.has_class("ux-section__item"))
    found = _text(let(items, lambda its: S.first_where(
        sec, lambda e: _span(e) & F.exists(its, lambda i: S.child_of(i)(e)))))
    return {"condition": _by_rule("condition", {"whole": found}, X.first_sentence(found))}


@reused
def spec_fields() -> dict[str, Column]:
    """F12, F13"""
    specs = F.col("s_specs")

    def value(tag: str, *names: str) -> Column:
        wanted = F.array(*[F.lit(LABELS + n) for n in names])
        return S.first_where(specs, lambda e: (e["tag"] == tag)
                             & F.arrays_overlap(e["classes"], wanted))["value"]

    return {
        "brand": _by_rule("spec", {
            "dl": value("dl", "brand"),
            "div": value("div", "brand"),
            "fr": F.coalesce(value("dl", "brand"), value("dl", "marque"), value("div", "brand")),
            "it": value("dl", "marca", "marke", "brand"),
        }, F.coalesce(value("dl", "brand"), value("div", "brand"))),
        "type": _by_rule("spec", {
            "dl": value("dl", "type"),
            "div": value("div", "type"),
            "fr": F.coalesce(*[value(tag, n) for tag in ("dl", "div")
                               for n in ("type", "style", "kind")]),
            "it": value("dl", "stile", "stil", "type", "style"),
        }, F.coalesce(value("dl", "type"), value("div", "type"))),
    }


@reused
def store_field() -> dict[str, Column]:
    """F14-F17"""
    sec = F.col("s_store")
    notes = S.has_class("x-store-information__highlights", "h4")
    spans = S.below_first(sec, notes, _span)
    counts = S.below_first(sec, notes, _secondary)
    feedback = _by_rule("feedback", {
        "positive": S.first_where(spans, lambda e: F.contains(e["text"], F.lit("positive feedback"))),
    }, S.first(spans))
    sales = F.when(F.size(counts) >= 2,
                   X.join_pair(_text(S.nth(counts, 0)), _text(S.nth(counts, 1))))
    name = _text(S.first_where(sec, S.has_class(BOLD, "span")))

    def part(value: Column) -> Column:
        return _by_rule("store", {"blank": F.lit("")}, F.coalesce(value, F.lit("")))

    return {"store_info": F.struct(part(name).alias("name"), part(_text(feedback)).alias("feedback"),
                                   part(sales).alias("sales"))}


_SECTION = ("array<struct<eid:int,last:int,parent:int,child_no:int,last_child:boolean,"
            "tag:string,classes:array<string>,text:string>>")

FIELD_GROUPS = {
    "title": title_fields, "price": price_fields, "quantity": quantity_fields,
    "shipping": shipping_field, "location": location_field, "returns": returns_field,
    "condition": condition_field, "spec": spec_fields, "store": store_field,
}


def extract_fields(parsed: DataFrame, keep: list[str],
                   groups: list[str] | None = None) -> DataFrame:
    """parsed pages (with rule columns) -> ``keep`` + the fields of ``groups``.

    A field that cannot be read is null; nothing drops the row.  ``extract_note``
    marks pages with a shipping row but no content under it.
    """
    sections = with_sections(parsed)
    groups = list(FIELD_GROUPS) if groups is None else groups
    if {"shipping", "location"} & set(groups):
        sections = with_shipping_parts(sections)
    fields: dict[str, Column] = {}
    for group in groups:
        fields.update(FIELD_GROUPS[group]())
    if "shipping" in groups:
        fields["extract_note"] = F.when(
            F.col("s_ship").isNotNull() & F.col("c_box").isNull(), "shipping content missing")
    return sections.select(*keep, *[c.alias(n) for n, c in fields.items()])


def is_complete() -> Column:
    """P9"""
    return ((F.coalesce(F.col("title"), F.lit("")) != "")
            & (F.coalesce(F.col("current_price"), F.lit("")) != ""))


def blank_to_null(products: DataFrame) -> DataFrame:
    """Clean view: blank texts and the 'not found' text both become null."""
    return products.select(*[
        F.nullif(F.nullif(F.col(c), F.lit("")), F.lit(NO_SHIPPING)).alias(c)
        if c in TEXT_FIELDS else F.col(c) for c in products.columns])
