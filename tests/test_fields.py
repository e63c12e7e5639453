"""Hand-written snippets per market and field; all are extracted in one job."""

import pytest

from pagemill.functions.markup import with_elements
from pagemill.operators.fields import NO_SHIPPING, extract_fields
from pagemill.plans.rules import MARKET_KEYS, market_rules, with_rules


def ship(inner, hints=True):
    body = f'<div class="ux-labels-values--shipping">{inner}</div>'
    if hints:
        body = ('<div class="ux-layout-section__row"><div class="ux-labels-values-with-hints" '
                f'data-testid="ux-labels-values-with-hints">{body}</div></div>')
    return f'<div class="d-shipping-minview">{body}</div>'


def content(inner):
    return f'<div class="ux-labels-values__values-content">{inner}</div>'


def span(text, extra=""):
    return f'<span class="ux-textspans {extra}">{text}</span>'


SEC = "ux-textspans--SECONDARY"
ES = ["DE", "ES", "MX"]
STD_ROW = ["CA", "GB"]

# (markets, field, html, expected)
CASES = [
    (MARKET_KEYS, "title", '<div class="x-item-title"><h1 class="x-item-title__mainTitle"><span>\xa0A<b>B</b>\n</span></h1></div>', "AB"),
    (MARKET_KEYS, "title", '<h1 class="x-item-title__mainTitle"><span>outside</span></h1>', None),
    (MARKET_KEYS, "subtitle", '<div class="x-item-title"><div class="x-item-title__subTitle"><span>s</span></div></div>', "s"),
    (["US"], "current_price", '<div class="x-price-section"><div class="x-price-primary"><span>$1</span></div></div>', "$1"),
    (["MX"], "current_price", '<div class="x-price-section"><div class="x-price-primary"><span>$1</span></div></div>', None),
    (["US", "FR"], "discount", f'<div class="x-price-section">{span("sale", "ux-textspans--EMPHASIS")}{span("20% off", SEC)}</div>', None),
    (["US", "FR"], "discount", f'<div class="x-price-section">{span("save 7, 20% off", SEC)}</div>', "20%"),
    (["NL"], "discount", f'<div class="x-price-section">{span("20% off", SEC)}</div>', None),
    (["GB"], "sold_count", f'<div class="x-quantity__availability">{span("1 left")}</div>', None),
    (["GB"], "sold_count", f'<div class="x-quantity__availability">{span("1 left")}{span("2 sold")}</div>', "2 sold"),
    # shipping
    (["US"], "shipping", ship(content(f"<div>{span('Free')}{span('.')}{span('post.')}</div>")), "Free post"),
    (["US"], "shipping", ship(content("text only")), ""),
    (STD_ROW, "shipping", ship(content(f"{span('Free')}{span('x', 'clipped')}{span('Located in: Leeds')}")), "Free x"),
    (STD_ROW, "shipping", ship(content(span("Free")), hints=False), None),
    (STD_ROW, "shipping", ship(content(span("See details"))), ""),
    (ES, "shipping", ship(content(f"<div>{span('Gratis.')}<p>{span('deep')}</p>{span('Ver detalles')}</div>")), "Gratis"),
    (ES, "shipping", ship(content(f"<div>{span('A<span class=clipped>b</span>')}{span('C<i class=ux-bubble-help></i>')}{span('D')}</div>")), "D"),
    (["DE", "ES"], "shipping", ship("<p>none</p>"), NO_SHIPPING),
    (["MX"], "shipping", ship("<p>none</p>"), None),
    (["MX"], "extract_note", ship("<p>none</p>"), "shipping content missing"),
    (["FR"], "shipping", ship(content(f"<div>{span('Gratuit..', 'ux-textspans--BOLD')}{span('x')}</div>")), "Gratuit"),
    (["FR", "IT"], "shipping", "<p></p>", NO_SHIPPING),
    (["IT"], "shipping", ship(content(f"{span('Gratis  qui', 'ux-textspans--POSITIVE ux-textspans--BOLD')}{span('x')}"), hints=False), "Gratis qui"),
    (["IT"], "shipping", ship(content(f"{span('Vedi i dettagli ora', 'ux-textspans--POSITIVE ux-textspans--BOLD')}{span('a')}{span('b', SEC)}{span('Ricevilo tra 2')}")), "a"),
    (["IT"], "shipping", ship(content(f'<div class="ux-labels-values--pudo"><p>{span("pudo")}</p></div>{span("a")}')), "a"),
    (["IT"], "shipping", ship("none"), None),
    (["AU"], "shipping", ship(content(f"<div>{span('x')}{span('Free', 'ux-textspans--POSITIVE ux-textspans--BOLD')}</div>"), hints=False), "Free"),
    (["AU"], "shipping", ship(content(f"<div>{span('See details')}</div>")), None),
    (["NL"], "shipping", ship(content(f"{span('Gratis')}{span('Details')}{span('.')}{span('nu')}"), hints=False), "Gratis nu"),
    # location
    (["US"], "location", ship(content(f"<div>{span('In: A', SEC)}</div><div>{span('In: B: C', SEC)}</div>")), "B: C"),
    (["NL"], "location", ship(content(f"<div>{span('In: A', SEC)}</div><div>{span('In: B', SEC)}</div>")), "A"),
    (["US", "NL"], "location", ship(content(f"<div>{span('a:b', SEC)}</div>")), "a:b"),
    (STD_ROW, "location", ship(content(span("Located in: x Located in: y", SEC))), "y"),
    (STD_ROW, "location", ship(content(span("Leeds", SEC))), None),
    (ES, "location", ship(content(f"<div></div><div>{span('Ubicado en: Vigo', SEC)}</div>")), "Vigo"),
    (ES, "location", ship(content(f"<div>{span('Ubicado en: Vigo', SEC)}</div>")), None),
    (["FR"], "location", ship(content(f"<div></div><div>{span('Lieu où se trouve l&#39;objet : Lyon', SEC)}</div>")), "Lyon"),
    (["FR"], "location", ship(content(f"<div>{span('Located in:', SEC)}</div>")), "Located in:"),
    (["IT"], "location", ship(content(f"{span('Roma', SEC)}{span('Oggetto che si trova a: Bari', SEC)}")), "Bari"),
    (["AU"], "location", ship(content(span("Located in: Perth", SEC))), "Perth"),
    (["AU"], "location", ship(content(span("Item Located in: Perth", SEC))), None),
    # returns
    (["US", "AU", "CA", "ES"], "returns", f'<div class="x-returns-minview">{content(span("30  days") + span("ok .") + span("z", "clipped") + span("See details"))}</div>', "30 days ok."),
    (["US"], "returns", f'<div class="x-returns-minview">{content("")}</div>', ""),
    (["FR"], "returns", f'<div class="x-returns-minview">{content("")}</div>', None),
    (["FR"], "returns", f'<div class="x-returns-minview">{content(span("30 jours Afficher plus"))}</div>', "30 jours"),
    (["IT"], "returns", f'<div class="x-returns-minview">{content(span("30 giorni"))}</div>', None),
    (["IT"], "returns", f'<div class="vim x-returns-minview">{content(span("30 giorni") + span("Vedi i dettagli"))}</div>', "30 giorni"),
    (["NL"], "returns", f'<div class="x-returns-minview">{content(span("30 dagen"))}</div>', None),
    # condition
    (["US"], "condition", f'<div class="x-item-condition-max-view"><div class="ux-section__item">{span("New")}</div></div>', "New."),
    (["NL"], "condition", f'<div class="x-item-condition-max-view"><div class="ux-section__item">{span("New. Box")}</div></div>', "New. Box"),
    (["US"], "condition", f'<div class="x-item-condition-max-view"><div class="ux-section__item"><p>{span("New")}</p></div></div>', None),
    # brand, type
    (["US"], "brand", f'<div class="ux-labels-values--brand"><div class="ux-labels-values__values">{span("B")}</div></div>', None),
    (["GB", "NL", "FR"], "brand", f'<div class="ux-labels-values--brand"><div class="ux-labels-values__values">{span("B")}</div></div>', "B"),
    (["FR"], "brand", f'<dl class="ux-labels-values--marque"><dd>{span("M")}</dd></dl>', "M"),
    (["IT"], "brand", f'<dl class="ux-labels-values--brand"><dd>{span("1")}</dd></dl><dl class="ux-labels-values--marca"><dd>{span("2")}</dd></dl>', "1"),
    (["FR"], "type", f'<div class="ux-labels-values--kind"><div class="ux-labels-values__values">{span("K")}</div></div>', "K"),
    (["IT"], "type", f'<dl class="ux-labels-values--stil"><dd>{span("S")}</dd></dl>', "S"),
]
ROWS = [(i, m, c[1], c[2], c[3]) for i, c in enumerate(CASES) for m in c[0]]


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(i, m, h) for i, m, _, h, _ in ROWS], "n int, market string, html string")
    pages = with_elements(with_rules(df, market_rules(spark)))
    return {(r.n, r.market): r for r in extract_fields(pages, ["n", "market"]).collect()}


@pytest.mark.parametrize("n,market,field,html,want", ROWS)
def test_field(extracted, n, market, field, html, want):
    assert extracted[(n, market)][field] == want


HEADER = ('<div class="x-store-information__header">' + span("Shop", "ux-textspans--BOLD")
          + '<h4 class="x-store-information__highlights">' + span("5 items") + span("98% positive feedback")
          + span("1K", SEC) + span("sold", SEC) + "</h4></div>")


def test_store_info(spark):
    df = spark.createDataFrame([(m, HEADER) for m in MARKET_KEYS], "market string, html string")
    rows = extract_fields(with_elements(with_rules(df, market_rules(spark))), ["market"], ["store"]).collect()
    got = {r.market: tuple(r.store_info) for r in rows}
    assert got.pop("US") == ("Shop", "98% positive feedback", "1K sold")
    assert got.pop("FR") == ("", "", "")
    assert set(got.values()) == {("Shop", "5 items", "1K sold")}
