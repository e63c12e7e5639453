"""Markup as columns: HTML text -> element array (operator E1).

A page is parsed where it is read: one Arrow-batched function turns the text
column into an element array and a text array, so there is no shuffle of tokens
and the same projection runs on a stream.  Everything after it - selectors,
fields, links, checks - is built-in expressions over those arrays.

The same tree was first built with ``aggregate``/``transform`` over a native
token array; folding a stack with interpreted
lambdas took more than twice as long per page as this helper.

``els`` is indexed by ``eid`` (entry 0 is the document) and numbered in document
order, so the descendants of an element are the slice ``eid+1 .. last`` and its
text is the slice ``t_start .. t_end`` of ``texts``.
"""

from __future__ import annotations

import html as html_std
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import bound_batches

# Groups: slash, tag name and attribute text of a tag (quoted values may hold
# '>'); text or a stray '<'; script or style with its body.  Comments and
# declarations fill no group.
TOKEN_PATTERN = (
    r"<!--.*?(?:-->|\Z)"
    r"|(<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z))"
    r"""|<(/?)([a-z][^\s/<>"']*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)>"""
    r"|<(/?)([a-z][^\s/<>]*)([^<>]*)>"
    r"|<[!?][^>]*>"
    r"|([^<]+|<)"
)
# What may stand between '<' and the first '>' of a tag that ends there: no open quote, no script or style.
# Its groups are those of the token pattern for a tag.
PLAIN_TAG_PATTERN = r"""(?!(?:script|style)\b)(/?)([a-z][^\s/<>"']*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)"""
ATTRIBUTE_PATTERN = r"""[\s/]([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?"""

# References in attribute values; a bare name with no semicolon is text there, as in '?a=1&copy=2'.
REFERENCE_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"

# Attributes in double quotes or without references, whose references are all ``&amp;`` in quotes: reading them changes nothing.
SETTLED_PATTERN = r"""(?:\s+[^\s=>"'/&<]+(?:=(?:"(?:[^"&']|&amp;)*"|[^\s"'>&]+(?=\s|\Z)))?)*\s*"""

# Elements that never have content.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link",
             "meta", "param", "source", "track", "wbr"]
# Script and style bodies are part of their token, so they nest nothing either.
EMPTY_TAGS = frozenset(VOID_TAGS + ["script", "style"])

# Containers that a stray inline end tag must not close.
BLOCK_TAGS = frozenset(["html", "body", "head", "div", "section", "article", "main", "aside",
                        "header", "footer", "nav", "table", "tbody", "thead", "tfoot", "tr",
                        "td", "th", "ul", "ol", "dl", "form"])

_INT, _STR = T.IntegerType(), T.StringType()
ELEMENT = T.StructType(
    [T.StructField(n, _INT) for n in ("eid", "parent", "child_no", "last", "t_start", "t_end")]
    + [T.StructField("last_child", T.BooleanType()), T.StructField("tag", _STR),
       T.StructField("classes", T.ArrayType(_STR)), T.StructField("attrs", _STR)])
# Attributes whose values a flat element holds where they are plain; the fields bear these names with an underscore in front.
LINK_ATTRIBUTES = ("href", "type", "aria-disabled")
FLAT_ELEMENT = T.StructType([T.StructField("tag", _STR), T.StructField("classes", T.ArrayType(_STR)), T.StructField("attrs", _STR)]
                            + [T.StructField("_" + n, _STR) for n in LINK_ATTRIBUTES])
PAGE = T.StructType([T.StructField("els", T.ArrayType(ELEMENT)),
                     T.StructField("texts", T.ArrayType(_STR)), T.StructField("phrase", _INT)])
FLAT_PAGE = T.StructType([T.StructField("els", T.ArrayType(FLAT_ELEMENT)), T.StructField("phrase", _INT)])

_ELEMENT_ARROW = [
    ("eid", pa.int32()), ("parent", pa.int32()), ("child_no", pa.int32()), ("last", pa.int32()),
    ("t_start", pa.int32()), ("t_end", pa.int32()), ("last_child", pa.bool_()), ("tag", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.string())]


class Columns:
    """Element columns of one Arrow batch, filled page after page; what a tag says is kept once for each distinct tag."""

    def __init__(self) -> None:
        self.parent, self.last, self.t_start, self.t_end, self.kind = [], [], [], [], []
        self.texts: list[str] = []
        # tag -> (slash, name, number, whether it opens, whether it is a block); number 0 is the document
        self.known: dict[str, tuple] = {}
        self.tags, self.classes, self.attrs = [""], [[]], [""]


def read_references(attrs: str, attribute_re, reference_re, settled_re) -> str:
    """Attribute text with the references of its values decoded.

    Only what would end a value, and the ampersand, stay references, which :func:`attribute` reads.
    """
    if settled_re.fullmatch(attrs):
        return attrs

    def value(found) -> str:
        quoted = found.group(2)
        if not quoted or "&" not in quoted:
            return found.group()
        inner = quoted[1:-1] if quoted[0] in "\"'" else quoted
        plain = reference_re.sub(lambda r: html_std.unescape(r.group()), inner)
        for sign, reference in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;")):
            plain = plain.replace(sign, reference)
        return f'{found.group()[:-len(quoted)]}"{plain}"'
    return attribute_re.sub(value, attrs)


def class_names(attrs: str, attribute_re) -> list[str]:
    """Class list from the attribute text of a tag."""
    start = attrs.find(' class="')
    if start >= 0 and "'" not in attrs[:start] and attrs.count('"', 0, start) % 2 == 0:
        return attrs[start + 8:attrs.find('"', start + 8)].split()
    if "class" in attrs.lower():
        for name, value in attribute_re.findall(attrs):
            if name.lower() == "class":
                return value.strip("\"'").split()
    return []


def tag_parts(found) -> tuple[str, str, str]:
    """(slash, name, attribute text) of a token that is no text; no name for what is no tag."""
    blob, slash, tag, attrs, slash2, tag2, attrs2, _ = found.groups(default="")
    if tag2:
        return slash2, tag2, attrs2
    if blob:
        tag = blob[1:7].rstrip(" >")
        return "", "script" if tag.lower() == "script" else "style", ""
    return slash, tag, attrs


def read_tag(parts: tuple[str, str, str], attribute_re, reference_re, settled_re, out: Columns) -> tuple:
    """(slash, name, number, whether it opens, whether it is a block) of a tag."""
    slash, tag, attrs = parts
    tag = tag.lower()
    number = -1
    if tag and not slash:
        if "&" in attrs:
            attrs = read_references(attrs, attribute_re, reference_re, settled_re)
        number = len(out.tags)
        out.tags.append(tag)
        out.classes.append(class_names(attrs, attribute_re) if attrs else [])
        out.attrs.append(attrs)
    return slash, tag, number, tag not in EMPTY_TAGS and attrs[-1:] != "/", tag in BLOCK_TAGS


def read_page(page: str, token_re, plain_re, attribute_re, reference_re, settled_re, out: Columns) -> None:
    """Append the elements and texts of one page.

    An end tag closes the innermost open element of its name and all inside it;
    it is ignored when there is none, or when an inline end tag would have to
    close a block.  Elements left open end with their container.

    The page is cut at each '<'.  Most cuts are a tag up to the first '>' and the text behind it; such a tag is
    read once a batch.  At any other the token pattern tells where it ends, and the cuts inside it are passed over.
    """
    base = len(out.kind)
    texts, last, t_end, known = out.texts, out.last, out.t_end, out.known
    add_parent, add_last, add_start, add_end, add_kind = (
        out.parent.append, last.append, out.t_start.append, t_end.append, out.kind.append)
    # open elements: number, name
    ids, names = [0], [""]
    eid = here = 0
    add_parent(-1)
    add_last(0)
    add_start(0)
    add_end(0)
    add_kind(0)
    cuts = iter(page.split("<"))
    text = next(cuts)
    at = len(text)  # where the present '<' is
    if text:
        texts.append(html_std.unescape(text) if "&" in text else text)
        here += 1
    done = 0  # what lies before belongs to a token that was read
    for cut in cuts:
        start = at
        at += len(cut) + 1
        if start < done:
            continue
        head, closed, text = cut.partition(">")
        read = known.get(head) if closed else None
        if read is None:
            plain = closed and plain_re.fullmatch(head)
            if plain:
                read = known[head] = read_tag(plain.groups(), attribute_re, reference_re, settled_re, out)
            else:
                found = token_re.match(page, start)
                done = page.find("<", found.end())
                done = len(page) if done < 0 else done
                text = page[found.end():done]
                if found.group(8):
                    read = ("", "", -1, False, False)
                    texts.append("<")
                    here += 1
                else:
                    read = read_tag(tag_parts(found), attribute_re, reference_re, settled_re, out)
        slash, tag, number, opens, block = read
        if slash:
            if names[-1] == tag:
                one = base + ids.pop()
                names.pop()
                last[one], t_end[one] = eid, here
                if text:
                    texts.append(html_std.unescape(text) if "&" in text else text)
                    here += 1
                continue
            depth = len(names) - 1
            while depth > 0 and names[depth] != tag:
                depth = depth - 1 if block or names[depth] not in BLOCK_TAGS else 0
            if depth > 0:
                for one in ids[depth:]:
                    last[base + one], t_end[base + one] = eid, here
                del ids[depth:], names[depth:]
        elif tag:
            eid += 1
            add_parent(ids[-1])
            add_last(eid)
            add_start(here)
            add_end(here)
            add_kind(number)
            if opens:
                ids.append(eid)
                names.append(tag)
        if text:
            texts.append(html_std.unescape(text) if "&" in text else text)
            here += 1
    for one in ids:
        last[base + one], t_end[base + one] = eid, here


def plain_values(attrs: str, wanted: tuple[str, ...], value_re) -> tuple[bool, list[str | None]]:
    """Whether ``attrs`` has any of the ``wanted`` names, and the value of each as :func:`attribute` gives it.

    A value with other references than ``&amp;`` is None, as an absent one is: :func:`attribute` reads it.
    """
    held: dict[str, str] = {}
    for name, value in value_re.findall(attrs):
        held.setdefault(name.lower(), value)
    out: list[str | None] = []
    for name in wanted:
        value = held.get(name)
        if value:
            value = value[1:-1] if value[0] in "\"'" else value
            if "&" in value:
                value = value.replace("&amp;", "&") if value.count("&") == value.count("&amp;") else None
        out.append(value)
    return any(name in held for name in wanted), out


def tag_form(shape: tuple[str, ...], plain_re, settled_re, attribute_re, value_re) -> tuple | None:
    """What the tags have in common that differ in nothing but double-quoted values; ``shape`` is what stands around these.

    A form is (name, where the attributes begin, classes, whether a wanted attribute is there, the values of these); a number stands
    for the quoted value of that place.  It is read from a tag with marks for values, by the functions that read any tag.  None where
    what the values say may decide how the tag is read.
    """
    marks = [f"\ue000{i}\ue001" for i in range(len(shape) - 1)]
    sample = shape[0] + "".join(f'"{m}"{s}' for m, s in zip(marks, shape[1:]))
    found = plain_re.fullmatch(sample) if all(s.isascii() for s in shape) else None
    if not found or found.group(1) or not settled_re.fullmatch(found.group(3)):
        return None
    attrs = found.group(3)
    places = {m: i for i, m in enumerate(marks)}
    names = class_names(attrs, attribute_re)
    asked, held = plain_values(attrs, LINK_ATTRIBUTES, value_re)
    return (found.group(2).lower(), found.start(3), places.get(names[0], names) if len(names) == 1 else names,
            asked, [places.get(v, v) for v in held])


def form_values(values: list[str], form: tuple) -> tuple[list[str], list[str | None]] | None:
    """Classes and wanted values of a tag of this form; None where its values hold what only the general way reads."""
    for value in values:
        if "&" in value and value.count("&") != value.count("&amp;") or value.endswith(" class="):
            return None
    _, _, names, _, held = form
    return (values[names].split() if isinstance(names, int) else names,
            [values[v].replace("&amp;", "&") if isinstance(v, int) else v for v in held])


def first_phrase(page: str, phrases: list[str | None] | None) -> int | None:
    """Place of the first of the lower-case ``phrases`` in a page of ASCII characters, whatever their case there."""
    if not phrases or not page.isascii():
        return None
    page = page.lower()
    for i, phrase in enumerate(phrases):
        if phrase is not None and phrase in page:
            return i
    return None


def read_flat(page: str, token_re, plain_re, known: dict[str, int], number_by_form, number_of, kinds: list[int]) -> None:
    """Append the number of each element of one page that has a class or a wanted attribute, in document order.

    The tags are those of :func:`read_page`, cut in the same way; which element is inside which is left out.
    """
    add = kinds.append
    at = done = 0
    cuts = iter(page.split("<"))
    at = len(next(cuts))
    for cut in cuts:
        start = at
        at += len(cut) + 1
        if start < done:
            continue
        head, closed, _ = cut.partition(">")
        number = known.get(head) if closed else None
        if number is None and closed:
            number = number_by_form(head)
            if number is not None:
                known[head] = number
        if number is None:
            plain = closed and plain_re.fullmatch(head)
            if plain:
                number = known[head] = number_of(plain.groups())
            else:
                found = token_re.match(page, start)
                done = page.find("<", found.end())
                done = len(page) if done < 0 else done
                number = -1 if found.group(8) else number_of(tag_parts(found))
        if number >= 0:
            add(number)


def _siblings(parent: np.ndarray, n_els: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Position of each element among its siblings, from 1, and whether it is the last of them."""
    starts = np.cumsum([0, *n_els[:-1]]) if n_els else np.zeros(0, np.int64)
    whose = np.where(parent < 0, -1, parent + np.repeat(starts, n_els))
    order = np.argsort(whose, kind="stable")
    edge = np.flatnonzero(np.diff(whose[order], prepend=-2))
    size = np.diff(edge, append=len(order))
    child_no, last_child = np.empty(len(order), np.int32), np.zeros(len(order), bool)
    child_no[order] = np.arange(len(order)) - np.repeat(edge, size) + 1
    last_child[order[edge + size - 1]] = True
    child_no[parent < 0], last_child[parent < 0] = 1, False
    return child_no, last_child


# The helper travels with the plan, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _offsets(sizes: list[int | None]) -> pa.Array:
    out, total = [], 0
    for n in sizes:
        out.append(None if n is None else total)
        total += n or 0
    return pa.array([*out, total], pa.int32())


@F.arrow_udf(returnType=PAGE)
def parse_page(pages: pa.Array, phrases: pa.Array) -> pa.Array:
    """Markup -> struct(els, texts, phrase); null for null. One Arrow batch at a time.

    A page of ASCII characters that holds one of its ``phrases`` is not parsed; ``phrase`` is the place of the first.
    """
    token_re = re.compile(TOKEN_PATTERN, re.I | re.S)
    plain_re = re.compile(PLAIN_TAG_PATTERN, re.I | re.S)
    attribute_re = re.compile(ATTRIBUTE_PATTERN)
    reference_re, settled_re = re.compile(REFERENCE_PATTERN), re.compile(SETTLED_PATTERN)
    out, n_els, n_texts, hits = Columns(), [], [], []
    for text, listed in zip(pages, phrases.to_pylist()):
        text = text.as_py()
        hits.append(None if text is None else first_phrase(text, listed))
        if text is None or hits[-1] is not None:
            n_els.append(None)
            n_texts.append(None)
            continue
        before, t_before = len(out.kind), len(out.texts)
        read_page(text, token_re, plain_re, attribute_re, reference_re, settled_re, out)
        n_els.append(len(out.kind) - before)
        n_texts.append(len(out.texts) - t_before)
    held = [n for n in n_els if n is not None]
    eids = np.concatenate([np.arange(n, dtype=np.int32) for n in [0, *held]])
    parent, kind = np.array(out.parent, np.int32), pa.array(out.kind, pa.int32())
    child_no, last_child = _siblings(parent, held)
    types = dict(_ELEMENT_ARROW)
    columns = {"eid": eids, "parent": parent, "child_no": child_no, "last": out.last, "t_start": out.t_start, "t_end": out.t_end,
               "last_child": last_child}
    columns = {n: pa.array(c, types[n]) for n, c in columns.items()}
    for name, known in (("tag", out.tags), ("classes", out.classes), ("attrs", out.attrs)):
        columns[name] = pa.array(known, types[name]).take(kind)
    element = pa.StructArray.from_arrays(
        [columns[n] for n, _ in _ELEMENT_ARROW], fields=[pa.field(n, t) for n, t in _ELEMENT_ARROW])
    els = pa.ListArray.from_arrays(_offsets(n_els), element)
    words = pa.ListArray.from_arrays(_offsets(n_texts), pa.array(out.texts, pa.string()))
    return pa.StructArray.from_arrays([els, words, pa.array(hits, pa.int32())], names=PAGE.names)


@F.arrow_udf(returnType=FLAT_PAGE)
def parse_flat(pages: pa.Array, phrases: pa.Array) -> pa.Array:
    """Markup -> struct(flat elements, phrase); null for null. One Arrow batch at a time.

    A page of ASCII characters that holds one of its ``phrases`` is not parsed; ``phrase`` is the place of the first.
    Most tags that are new to a batch differ from others in quoted values only, and are read by their common form.
    """
    token_re = re.compile(TOKEN_PATTERN, re.I | re.S)
    plain_re = re.compile(PLAIN_TAG_PATTERN, re.I | re.S)
    attribute_re = re.compile(ATTRIBUTE_PATTERN)
    reference_re, settled_re = re.compile(REFERENCE_PATTERN), re.compile(SETTLED_PATTERN)
    # The same classes of characters as in the expressions of attribute().
    value_re = re.compile(ATTRIBUTE_PATTERN, re.A)
    tags, classes, texts, values = [], [], [], []

    def number_by_form(head: str) -> int | None:
        parts = head.split('"')
        if len(parts) < 3 or len(parts) % 2 == 0 or "'" in head:
            return None
        shape = tuple(parts[::2])
        if shape not in forms:
            forms[shape] = tag_form(shape, plain_re, settled_re, attribute_re, value_re)
        form = forms[shape]
        read = form and form_values(parts[1::2], form)
        if not read:
            return None
        names, held = read
        if not names and not form[3]:
            return -1
        tags.append(form[0])
        classes.append(names)
        texts.append(head[form[1]:])
        values.append(held)
        return len(tags) - 1

    def number_of(parts: tuple[str, str, str]) -> int:
        slash, tag, attrs = parts
        if slash or not tag or not attrs:
            return -1
        if "&" in attrs:
            attrs = read_references(attrs, attribute_re, reference_re, settled_re)
        names = class_names(attrs, attribute_re)
        asked, held = plain_values(attrs, LINK_ATTRIBUTES, value_re)
        if not names and not asked:
            return -1
        tags.append(tag.lower())
        classes.append(names)
        texts.append(attrs)
        values.append(held)
        return len(tags) - 1

    known: dict[str, int] = {}
    forms: dict[tuple[str, ...], tuple | None] = {}
    kinds: list[int] = []
    sizes: list[int | None] = []
    hits: list[int | None] = []
    for text, listed in zip(pages.to_pylist(), phrases.to_pylist()):
        hits.append(None if text is None else first_phrase(text, listed))
        if text is None or hits[-1] is not None:
            sizes.append(None)
            continue
        before = len(kinds)
        read_flat(text, token_re, plain_re, known, number_by_form, number_of, kinds)
        sizes.append(len(kinds) - before)
    kind = pa.array(kinds, pa.int32())
    columns = [pa.array(tags, pa.string()), pa.array(classes, pa.list_(pa.string())), pa.array(texts, pa.string()),
               *[pa.array([v[i] for v in values], pa.string()) for i in range(len(LINK_ATTRIBUTES))]]
    element = pa.StructArray.from_arrays([c.take(kind) for c in columns], names=FLAT_ELEMENT.names)
    els = pa.ListArray.from_arrays(_offsets(sizes), element)
    return pa.StructArray.from_arrays([els, pa.array(hits, pa.int32())], names=FLAT_PAGE.names)


# Kept out of filter push-down and projection merging, which would run it twice
# or move it inside a lambda.
parse_page = parse_page.asNondeterministic()
parse_flat = parse_flat.asNondeterministic()


def _phrases(listed: Column | None) -> Column:
    return F.lit(None).cast("array<string>") if listed is None else F.transform(listed, F.lower)


def with_elements(pages: DataFrame, html: str = "html", phrases: Column | None = None) -> DataFrame:
    """Replace the markup column by ``els`` and ``texts`` (null where it is null).

    With ``phrases`` (an array) a column ``_phrase`` tells the place of the first of them that a page of ASCII characters holds,
    whatever the case; such a page is not parsed.  Other pages are not searched.
    A worker holds one batch of at most 4 MB of markup, however many pages a task reads.
    """
    bound_batches(pages.sparkSession)
    added = {"els": F.col("_page.els"), "texts": F.col("_page.texts")}
    if phrases is not None:
        added["_phrase"] = F.col("_page.phrase")
    return (pages.withColumn("_page", parse_page(F.col(html), _phrases(phrases))).drop(html)
            .withColumns(added).drop("_page"))


def with_flat_elements(pages: DataFrame, html: str = "html", phrases: Column | None = None) -> DataFrame:
    """Replace the markup column by ``els`` (null where it is null): the elements of :func:`with_elements` that have a class
    or one of ``LINK_ATTRIBUTES``, in document order, for selectors that ask neither for texts nor for what is inside what.

    An element is its tag, classes, attribute text and the plain values of these attributes; :func:`flat_attribute` reads them.
    ``phrases`` are those of :func:`with_elements`.
    """
    bound_batches(pages.sparkSession)
    added = {"els": F.col("_page.els")}
    if phrases is not None:
        added["_phrase"] = F.col("_page.phrase")
    return (pages.withColumn("_page", parse_flat(F.col(html), _phrases(phrases))).drop(html)
            .withColumns(added).drop("_page"))


def flat_attribute(e: Column, name: str) -> Column:
    """:func:`attribute` of a flat element."""
    return F.coalesce(e["_" + name], attribute(e["attrs"], name))


def page_elements(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """E1 as a table: one row per element, ``eid`` .. ``last`` being its interval."""
    return parsed.select(*keys, F.inline("els")).where(F.col("eid") > 0)


def attribute(attrs: Column, name: str) -> Column:
    """One attribute from an element's attribute text; null when absent, '' when it has no value."""
    names = F.transform(F.regexp_extract_all(attrs, F.lit(ATTRIBUTE_PATTERN), F.lit(1)), F.lower)
    values = F.regexp_extract_all(attrs, F.lit(ATTRIBUTE_PATTERN), F.lit(2))
    value = F.get(values, F.array_position(names, F.lit(name)).cast("int") - 1)
    bare = F.regexp_replace(value, r"""^["']|["']$""", "")
    # The parser leaves these references only; the ampersand last, so nothing is decoded twice.
    for sign, references in (('"', "&(quot|#34|#x22);"), ("'", "&(apos|#39|#x27);"), ("<", "&(lt|#60|#x3c);"),
                             (">", "&(gt|#62|#x3e);"), ("&", "&(amp|#38|#x26);")):
        bare = F.regexp_replace(bare, f"(?i){references}", sign)
    return F.when(F.contains(F.lower(attrs), F.lit(name)), bare)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body`` (a fold over nothing copies nothing)."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)
