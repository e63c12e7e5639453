"""Element building on well-formed and broken markup."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import markup
from pagemill.functions import select as S
from pagemill.functions.markup import attribute, with_elements

CASES = {
    "nested": ("<div class='a b'><p>x</p><span>y</span></div>",
               [("div", 0, ["a", "b"], "xy"), ("p", 1, [], "x"), ("span", 1, [], "y")]),
    "void": ("<div>a<br>b<img src=x>c</div>", [("div", 0, [], "abc"), ("br", 1, [], ""), ("img", 1, [], "")]),
    "unclosed inline": ("<div><b>x<i>y</div><p>z</p>",
                        [("div", 0, [], "xy"), ("b", 1, [], "xy"), ("i", 2, [], "y"), ("p", 0, [], "z")]),
    "stray end": ("</p></div><div>x</b>y</div>", [("div", 0, [], "xy")]),
    "inline end cannot close a block": ("<b>1<div>2</b>3</div>",
                                        [("b", 0, [], "123"), ("div", 1, [], "23")]),
    "script is opaque": ("<script>'</div><p>'</script><p>x</p>", [("script", 0, [], ""), ("p", 0, [], "x")]),
    "open comment": ("<p>x</p><!-- <p>y</p>", [("p", 0, [], "x")]),
    "quoted bracket": ('<p title="a>b" class="c">x</p>', [("p", 0, ["c"], "x")]),
    "class in a value": ("<p title=' class=\"no\"' CLASS=yes>x</p>", [("p", 0, ["yes"], "x")]),
    "references": ("<p>a&amp;b &#8364; &eacute;&nbsp;&amp;lt; &bogus;</p>",
                   [("p", 0, [], "a&b € é\xa0&lt; &bogus;")]),
    "stray bracket": ("<p>1 < 2</p>", [("p", 0, [], "1 < 2")]),
    "truncated": ("<div><p>x", [("div", 0, [], "x"), ("p", 1, [], "x")]),
    "self closed": ("<div><span/>x</div>", [("div", 0, [], "x"), ("span", 1, [], "")]),
    "upper case": ("<DIV Class='Q'>x</Div>", [("div", 0, ["Q"], "x")]),
    "empty": ("", []),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("null", None)],
                               "name string, html string")
    texts = F.transform("els", lambda e: S.raw_text(F.col("texts"), e))
    return {r.name: r for r in with_elements(df).select("name", "els", texts.alias("t")).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_elements(parsed, name):
    row = parsed[name]
    got = [(e.tag, e.parent, list(e.classes), t) for e, t in zip(row.els, row.t)][1:]
    assert got == CASES[name][1]
    assert [e.eid for e in row.els] == list(range(len(row.els)))


def test_null_page(parsed):
    assert parsed["null"].els is None


def test_sibling_numbers(spark):
    df = spark.createDataFrame([("<div><p>1</p>t<b>2</b><i>3</i></div>",)], "html string")
    els = with_elements(df).first().els
    assert [(e.tag, e.child_no, e.last_child) for e in els[2:]] == [
        ("p", 1, False), ("b", 2, False), ("i", 3, True)]


def test_attributes(spark):
    df = spark.createDataFrame([("""<a x=' href="no"' href="/q?a=1&amp;b=2" Type=next disabled>t</a>""",)],
                               "html string")
    a = with_elements(df).select(F.col("els")[1]["attrs"].alias("t"))
    row = a.select(*[attribute(F.col("t"), n).alias(n) for n in ("href", "type", "disabled", "rel")]).first()
    assert tuple(row) == ("/q?a=1&b=2", "next", "", None)


def test_a_batch_of_pages_is_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        page = "<p>" + "x" * 1000 + "</p>"
        with_elements(spark.range(10).select(F.lit(page).alias("html"))).count()
        assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.set(key, before)


def test_a_tag_is_read_once_a_batch():
    out, patterns = markup.Columns(), (
        re.compile(markup.TOKEN_PATTERN, re.I | re.S), re.compile(markup.PLAIN_TAG_PATTERN, re.I | re.S),
        re.compile(markup.ATTRIBUTE_PATTERN), re.compile(markup.REFERENCE_PATTERN), re.compile(markup.SETTLED_PATTERN))
    for _ in range(50):
        markup.read_page('<ul><li class="a">x</li><li class="a">y</li></ul>', *patterns, out)
    assert len(out.kind) == 200 and out.tags == ["", "ul", "li"] and out.classes == [[], [], ["a"]]


@pytest.mark.parametrize("page, tags", [
    ("<p a='<b>'>x</p><i>", ["p", "i"]), ("<p a='<b>x</p><i>", ["b", "i"]), ("<script>'<p>'</script x='>'><p>", ["script"]),
    ("<!-- <p> --><p><!x <p>", ["p"]), ("<p <b>< b></p", ["b"]), ("<STYLE a><p></Style ><style-x><p>", ["style", "style"])])
def test_cuts_inside_a_token(spark, page, tags):
    els = with_elements(spark.createDataFrame([(page,)], "html string")).first().els
    assert [e.tag for e in els[1:]] == tags
