"""Selectors over the element array of one page.

``els`` is the array built by :func:`pagemill.functions.markup.with_elements`
(or a slice / filter of it) and an element is one of its structs.  A selector is
a predicate on elements; document order is the array order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.markup import attribute, let
from pagemill.functions.text import strip

Predicate = Callable[[Column], Column]


def is_tag(*names: str) -> Predicate:
    return lambda e: e["tag"].isin(*names)


def has_class(name: str, tag: str | None = None) -> Predicate:
    """``tag.name`` or ``.name``."""
    if tag is None:
        return lambda e: F.array_contains(e["classes"], name)
    return lambda e: (e["tag"] == tag) & F.array_contains(e["classes"], name)


def has_all_classes(names: list[str], tag: str) -> Predicate:
    """E3"""
    wanted = F.array(*[F.lit(n) for n in names])
    return lambda e: (e["tag"] == tag) & (F.size(F.array_except(wanted, e["classes"])) == 0)


def class_has_substrings(parts: list[str], tag: str, need_all: bool) -> Predicate:
    """Substrings of one class value or of the whole class attribute."""
    def one(value: Column) -> Column:
        tests = [F.contains(value, F.lit(p)) for p in parts]
        out = tests[0]
        for t in tests[1:]:
            out = (out & t) if need_all else (out | t)
        return out

    return lambda e: (e["tag"] == tag) & (F.size(e["classes"]) > 0) & (
        F.exists(e["classes"], one) | one(F.array_join(e["classes"], " ")))


def has_attribute(name: str, value: str, tag: str) -> Predicate:
    """E8"""
    return lambda e: (e["tag"] == tag) & (
        F.coalesce(attribute(e["attrs"], name), F.lit("")) == value)


def both(*preds: Predicate) -> Predicate:
    def test(e: Column) -> Column:
        out = preds[0](e)
        for p in preds[1:]:
            out = out & p(e)
        return out

    return test


def either(*preds: Predicate) -> Predicate:
    """A selector list."""
    def test(e: Column) -> Column:
        out = preds[0](e)
        for p in preds[1:]:
            out = out | p(e)
        return out

    return test


def nth_child(n: int) -> Predicate:
    """Position among element siblings."""
    return lambda e: e["child_no"] == n


def last_child() -> Predicate:
    """E9"""
    return lambda e: F.coalesce(e["last_child"], F.lit(False))


def contains(outer: Column, inner: Column) -> Column:
    """E5: ``inner`` is a descendant of ``outer``."""
    return (inner["eid"] > outer["eid"]) & (inner["eid"] <= outer["last"])


def inside_any(outers: Column, strict: bool = True) -> Predicate:
    """E5: descendant of any element of ``outers`` (or that element itself)."""
    if strict:
        return lambda e: F.exists(outers, lambda o: contains(o, e))
    return lambda e: F.exists(
        outers, lambda o: (e["eid"] >= o["eid"]) & (e["eid"] <= o["last"]))


def below(els: Column, outer: Predicate, inner: Predicate) -> Column:
    """E5: elements matching ``inner`` below some element matching ``outer``."""
    return let(all_where(els, outer), lambda outs: all_where(
        els, both(inner, inside_any(outs))))


def below_first(els: Column, outer: Predicate, inner: Predicate) -> Column:
    """Elements matching ``inner`` below the first element matching ``outer``."""
    return let(first_where(els, outer), lambda top: all_where(
        els, lambda e: inner(e) & contains(top, e)))


def child_of(outer: Column) -> Predicate:
    """Direct child."""
    return lambda e: e["parent"] == outer["eid"]


def all_where(els: Column, pred: Predicate) -> Column:
    """E13"""
    return F.filter(els, pred)


def first(els: Column) -> Column:
    """E12"""
    return F.get(els, F.lit(0))


def nth(els: Column, n: int) -> Column:
    """0-based; null when the list is shorter."""
    return F.get(els, F.lit(n))


def last(els: Column) -> Column:
    return F.try_element_at(els, F.lit(-1))


def first_where(els: Column, pred: Predicate) -> Column:
    return first(all_where(els, pred))


def descendants(els: Column, outer: Column) -> Column:
    """Elements below ``outer``; ``els`` must be the whole page array."""
    return F.slice(els, outer["eid"] + 2, outer["last"] - outer["eid"])


def subtree(els: Column, outer: Column) -> Column:
    """``outer`` and the elements below it; ``els`` must be the whole page array."""
    return F.slice(els, outer["eid"] + 1, outer["last"] - outer["eid"] + 1)


def raw_text(texts: Column, el: Column) -> Column:
    """Text of the element and everything below it, in document order."""
    return F.array_join(F.slice(texts, el["t_start"] + 1, el["t_end"] - el["t_start"]), "")


def text(texts: Column, el: Column) -> Column:
    """E16 + C1"""
    return strip(raw_text(texts, el))
