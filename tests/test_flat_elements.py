"""Flat elements: the same tags, classes and attribute values as whole ones."""

import random
import re

from pyspark.sql import functions as F

from pagemill.functions import markup as M
from pagemill.functions.markup import (LINK_ATTRIBUTES, attribute, flat_attribute, with_elements,
                                       with_flat_elements)
from pagemill.operators.validate import error_phrase, with_verdict

PIECES = ["<a href=", "<a class='s-item__link x' ", '<li class="s-item">', "<a type=next href>", "<button type=\"next\" ARIA-disabled='true'>",
          'href="/itm/1?a=1&amp;b=2"', "href='/itm/2&quot;&eacute;&#39;'", 'href="x>y"', "HREF=/itm/3&amp;c", "&AMP;", "&lt;", '"', "'", ">", "<",
          "/>", "</a>", "</ul>", "text", " ", "\n", "\x1c", "\xa0", "<!-- <a href='n'> -->", "<script>'<a href=1>'</script>", "<script", "<style a>",
          "<br>", "<p>", "class=", "class", "=", "café", "<İ href=1>", 'data-x="<a href=2>"', "href=&amp;quot;", 'type=""', "<?x>", "<a\thref=q\tHref=r>"]


def _pages():
    deal = random.Random(7)
    return [None, "", *["".join(deal.choices(PIECES, k=deal.randint(1, 30))) for _ in range(3000)]]


def test_flat_elements_are_those_of_the_whole_parse(spark):
    pages = spark.createDataFrame([(i, p) for i, p in enumerate(_pages())], "i int, html string")

    def read(els, value):
        return F.transform(els, lambda e: F.struct(e["tag"].alias("tag"), e["classes"].alias("classes"), *[
            value(e, n).alias(n) for n in LINK_ATTRIBUTES]))

    whole = read(F.filter("els", lambda e: e["eid"] > 0), lambda e, n: attribute(e["attrs"], n))
    whole = F.filter(whole, lambda e: (F.size(e["classes"]) > 0) | F.coalesce(*[e[n] for n in LINK_ATTRIBUTES]).isNotNull())
    a = with_elements(pages).select("i", whole.alias("els")).collect()
    b = with_flat_elements(pages).select("i", read(F.col("els"), flat_attribute).alias("els")).collect()
    want = {r.i: r.els for r in a}
    assert [r for r in b if r.els != want[r.i]] == []
    assert sum(len(r.els or []) for r in b) > 3000


def test_search_pages_are_read_flat(spark):
    """The tree and the texts of a search page are not asked for."""
    from workload import queries as Q
    for df in (Q._links(spark, "/root/testdata/sf0.001"), Q._facts(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_flat") == 1 and "parse_page" not in plan


def test_tags_of_one_form_are_read_like_any_other():
    """A tag whose form is known gives what the general way of reading gives."""
    plain_re, settled_re = re.compile(M.PLAIN_TAG_PATTERN, re.I | re.S), re.compile(M.SETTLED_PATTERN)
    attribute_re, value_re = re.compile(M.ATTRIBUTE_PATTERN), re.compile(M.ATTRIBUTE_PATTERN, re.A)
    reference_re, deal, read = re.compile(M.REFERENCE_PATTERN), random.Random(3), 0
    names = [" class", " CLASS", " href", " type", " aria-disabled", "\nhref", " title", " class =", "\xa0href", "/href", " x", ""]
    values = ["a b", "", " class=", "/itm/1?a=1&amp;b=2", "&quot;", "&", "é", "x=y", "/", " s-item__link", "class=q"]
    for _ in range(20000):
        head = deal.choice(["a", "A", "li", "/a", "br", "script"]) + deal.choice(["", " target=_blank", " x", " class=k"]) + "".join(
            f'{deal.choice(names)}="{deal.choice(values)}"' for _ in range(deal.randint(1, 3))) + deal.choice(["", "", "/", " ", " type=next"])
        parts = head.split('"')
        form = M.tag_form(tuple(parts[::2]), plain_re, settled_re, attribute_re, value_re)
        got = form and M.form_values(parts[1::2], form)
        if not got:
            continue
        _, tag, attrs = plain_re.fullmatch(head).groups()
        if "&" in attrs:
            attrs = M.read_references(attrs, attribute_re, reference_re, settled_re)
        asked, held = M.plain_values(attrs, LINK_ATTRIBUTES, value_re)
        assert (form[0], head[form[1]:], got[0], form[3], got[1]) == (tag.lower(), attrs, M.class_names(attrs, attribute_re), asked, held), head
        read += 1
    assert read > 2000
    link = 'a target=_blank class="s-item__link" href="/itm/7?hash=1&amp;n=1"'.split('"')
    form = M.tag_form(tuple(link[::2]), plain_re, settled_re, attribute_re, value_re)
    assert M.form_values(link[1::2], form) == (["s-item__link"], ["/itm/7?hash=1&n=1", None, None])


def test_error_phrases_in_pages_of_any_characters(spark):
    """The helper finds what the search of the lower-cased page finds, and does not parse such a page."""
    phrases = ["Robot Check", None, "Ça va", "Kelvin", "robot"]
    bodies = ["", "xx", "ROBOT cHECK", "a robot", "KELVIN é robot", "kelvin robot", "ÇA VA", "rob ot", "é Robot check", "İrobot check"]
    rows = [(i, None if b == "xx" else b + '<p class="k">t</p>', phrases) for i, b in enumerate(bodies)] + [(99, "robot check<p class=k>", None)]
    pages = spark.createDataFrame(rows, "i int, html string, error_texts array<string>").select(
        "*", F.lit(1).alias("min_length"), F.lit("short").alias("verdict_rule"), F.lit("search").alias("page_type"),
        F.create_map(F.lit("search"), F.array(F.lit("p.k"))).alias("required"))
    want = {r.i: r.p for r in pages.select("i", error_phrase(F.col("html"), F.col("error_texts")).alias("p")).collect()}
    for flat in (False, True):
        for r in with_verdict(pages, flat=flat).select("i", "verdict", "is_valid", "els").collect():
            if r.i == 1:
                assert r.verdict == "Content too short" and r.els is None
            elif want[r.i] is None:
                assert r.verdict == "Content valid" and r.is_valid and r.els
            else:
                assert r.verdict == "Error page: " + want[r.i] and not r.is_valid and r.els is None
    assert sum(p is not None for p in want.values()) >= 5
    wide = with_verdict(pages.where("octet_length(html) = length(html)"))
    assert "_phrase" not in wide.columns and wide._jdf.queryExecution().analyzed().toString().count("octet_length") > 1
