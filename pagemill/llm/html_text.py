"""Main text of pages, with a host's repeated text found by a suffix array.

A page becomes a token stream of blocks.  Blocks inside the page's article are kept; the array decides on all
others, and a check of the zones that markup itself declares (menus, footers, forms, scripts, adverts, comments
of readers) follows.  The streams outside articles of a host's pages are concatenated and their suffixes sorted into
one array, spread over Spark's partitions; neighbours that share a long beginning across distinct pages are
repeated text.  Such runs are boilerplate and are cut out; unique runs stay, those of the same block too.  Copies of
one page on a host (mirrors, print views) count as one page, so what only they share is not boilerplate.  Suffixes inside an
article decide nothing, as repeated text stays there, so they are left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import bound_batches, list_array, stage

#: Words that a repeated substring has at least; a shorter block is compared whole, and counts with its neighbours only.
LONG = 6
#: A block counts as repeated if this share of its words is covered.
COVERED = 0.5
#: Pages of a host are copies if their long blocks are equal and shorter ones hold at most this share of their words.
SHORT_SHARE = 0.1

# Names in markup.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "object", "title", "select")
ZONES = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head"}
ROOTS = {"article", "main"}
BLOCKS = {"p", "div", "article", "main", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table",
          "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "figure", "figcaption", "address", "body", "html", "hr",
          "details", "summary", "fieldset", "center", "hgroup", "search", *(ZONES - {"button"})}
CLOSES_OWN = {"li", "td", "th", "tr", "dt", "dd"}
VOID = {"br", "hr", "img", "meta", "link", "input", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
# Whole class or id tokens.
BAD_NAMES = re.compile(
    r"ads?|advert(?:s|isement|ising)?|banner|sponsor(?:ed)?|promo|nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|footer|site-?header|page-?header"
    r"|cookies?(?:-?\w+)?|consent|notices?|gdpr|newsletter|subscribe|popup|modal|comments?|comment-list|disqus|share|social|related|widget|login|signup", re.I)
#: Elements that hold the page or its article, whatever their names say.
NEVER_BY_NAME = {"html", "body", *ROOTS}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # A quote opens a value only behind an equals sign, and only if it is closed.
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z)", re.I | re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)

#: Zones of blocks: outside the article, inside it, declared to be no main text (outside it too).
OPEN, INSIDE, DECLARED = 0, 1, 2
BLOCK = T.ArrayType(T.StructType().add("place", "integer").add("text", "string").add("zone", "integer"))


def _declared(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element's markup declares it to be no main text, and whether its names alone do.

    Names count as whole tokens.  Inside an article those of headings, and ids of sections, are anchors and say nothing.
    """
    named = False
    if tag in ZONES:
        return True, False
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if (name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true"
                    or name == "style" and NOT_SHOWN.search(value) or name == "role" and value.lower() in BAD_ROLES):
                return True, False
            if name in ("class", "id") and tag not in NEVER_BY_NAME and not (
                    in_article and (tag in HEADINGS or tag == "section" and name == "id")):
                named |= any(BAD_NAMES.fullmatch(token) for token in value.split())
    return False, named


def page_blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block in page order.

    Ends of elements that never began are ignored; elements never closed end with their parent.  Inside a
    block white space is one space.  What an inline element declares to be no main text leaves its
    block.  An element that holds an article is not declared by its names.  A page cut short is read as far as it goes.
    """
    out: list[tuple[str, int, tuple[int, ...]]] = []  # text, zone, elements by whose names alone it is declared
    kept: list[str] = []
    noise: list[str] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # name, declared, number if by names, article, head
    banned = roots = head = numbered = 0
    named: list[int] = []  # open elements declared by names
    lifted: set[int] = set()  # those of them that turned out to hold an article
    certain = False  # part of the noise is declared by more than names
    why: set[int] = set()

    def flush() -> None:
        nonlocal certain
        for parts, zone in ((kept, INSIDE if roots else OPEN), (noise, DECLARED)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((text, zone, tuple(why) if zone == DECLARED and not certain else ()))
                parts.clear()
        certain = False
        why.clear()

    def add(text: str) -> None:
        nonlocal certain
        if "&" in text:  # decoded piece by piece: a reference does not go on behind a tag
            text = entities.unescape(text)
        if banned or named:
            noise.append(text)
            if text.strip():
                certain |= banned > 0
                why.update(named)
        else:
            kept.append(text)

    def close(depth: int) -> None:
        nonlocal banned, roots, head
        for _, bad, number, root, top in stack[depth:]:
            banned -= bad
            if number and number in named:
                named.remove(number)
            roots -= root
            head -= top
        del stack[depth:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not head:
            add(page[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m.group(2):
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] != tag:
                depth = -1 if not block and stack[depth][0] in BLOCKS else depth - 1
            if depth >= 0:
                close(depth)
            continue
        if block:
            # A block ends an open paragraph, and an open element of its own kind in the same parent where kinds don't nest.
            ended = (tag, "p") if tag in CLOSES_OWN else ("p",)
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] not in ended and stack[depth][0] not in BLOCKS:
                depth -= 1
            if depth >= 0 and stack[depth][0] in ended:
                close(depth)
        (bad, by_name), root, top = _declared(tag, m.group(4), roots > 0), tag in ROOTS, tag == "head"
        banned += bad
        if root and not roots and not bad:
            lifted.update(named)
            named.clear()
        if by_name:
            numbered += 1
            named.append(numbered)
        roots += root
        head += top
        stack.append((tag, bad, numbered if by_name else 0, root, top))
    if at < len(page) and not head:
        add(page[at:])
    flush()
    return [(text, OPEN if why and lifted.issuperset(why) else zone) for text, zone, why in out]


@F.arrow_udf(returnType=BLOCK)
def blocks_of(pages: pa.Array) -> pa.Array:
    sizes, texts, zones = [], [], []
    for page in pages:
        found = page_blocks(page.as_py() or "")
        sizes.append(len(found))
        texts += [t for t, _ in found]
        zones += [z for _, z in found]
    place = np.concatenate([np.arange(n, dtype=np.int32) for n in [0, *sizes]])
    return list_array(sizes, pa.StructArray.from_arrays(
        [pa.array(place), pa.array(texts, pa.string()), pa.array(zones, pa.int32())], names=["place", "text", "zone"]))


blocks_of = blocks_of.asNondeterministic()


def _said(blocks: list[tuple[str, int]], long: int) -> int | None:
    """A number that copies of one page share: pages that say the same in all blocks of ``long`` words or more.

    Zones that markup declares are left out.  Where shorter blocks hold more than ``SHORT_SHARE`` of the words they have to
    be equal too; a page without words has none.
    """
    sizes = [(t, t.count(" ") + 1) for t, zone in blocks if zone != DECLARED]
    if not sizes:
        return None
    large = [(t, n) for t, n in sizes if n >= long]
    same = large if sum(n for _, n in large) >= (1 - SHORT_SHARE) * sum(n for _, n in sizes) else sizes
    digest = hashlib.blake2b("\n".join(t for t, _ in same).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "big", signed=True)


def streams_of(long: int):
    """Blocks of a page outside its article, and the number that its copies share."""
    @F.arrow_udf(returnType=T.StructType().add("blocks", BLOCK).add("said", "long"))
    def of(pages: pa.Array) -> pa.Array:
        sizes, rows, said = [], [], []
        for page in pages:
            found = page_blocks(page.as_py() or "")
            outside = [(k, t, z) for k, (t, z) in enumerate(found) if z != INSIDE]
            sizes.append(len(outside))
            rows += outside
            said.append(_said(found, long))
        blocks = list_array(sizes, pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int32())], names=["place", "text", "zone"]))
        return pa.StructArray.from_arrays([blocks, pa.array(said, pa.int64())], names=["blocks", "said"])
    return of.asNondeterministic()


def host_of(url: Column) -> Column:
    """Lower-case host name; addresses without one share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _runs(batches):
    """Runs of equal suffixes in a sorted stretch of the array: (suffix, low, high page).

    Runs on one page only are left out, but for the first and the last of the stretch, which the next one may continue.
    """
    names = ["suffix", "low", "high"]
    pending, is_first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_arrays(batch.columns, names=names)
        if pending is not None:
            table = pa.concat_tables([pending, table])
        suffix, low, high = table["suffix"].combine_chunks(), *(table[n].to_numpy() for n in names[1:])
        changes = pc.not_equal(suffix[1:], suffix[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
        runs = pa.Table.from_arrays([suffix.take(pa.array(starts)), pa.array(np.minimum.reduceat(low, starts)),
                                     pa.array(np.maximum.reduceat(high, starts))], names=names)
        pending, done = runs.slice(len(starts) - 1), runs.slice(0, len(starts) - 1)
        if done.num_rows:
            shared = np.asarray(done["low"]) < np.asarray(done["high"])
            shared[0] |= is_first
            is_first = False
            yield from done.filter(pa.array(shared)).combine_chunks().to_batches()
    if pending is not None:
        yield from pending.combine_chunks().to_batches()


def repeated_runs(outside: DataFrame, long: int = LONG) -> DataFrame:
    """(block, size, runs): the runs of words (start, end) of each block that lie in substrings of ``long`` words or more
    that two distinct pages of the host hold; blocks without such runs are left out.

    ``outside``: host, page, block (hash of host and text), text.  Equal blocks of a host are one entry of the token stream,
    with its smallest and largest page, so what a host repeats on every page is counted on the map side and enters once.
    The suffixes of the stream, each known by its first ``long`` words inside its block or by the whole of a shorter
    block, are sorted over all partitions; the block is part of the order, so a hot beginning spreads over several.  One
    beginning is one run of neighbours: it is shared if the run spans two pages.  Runs cut by the end of a partition are joined.
    """
    streams = outside.groupBy("host", "block", "text").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    words = F.split("text", " ")
    size = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(size - long, F.lit(0)))
    streams = stage(streams, "html-streams")
    suffixes = streams.select("host", "block", "low", "high", size.alias("size"), words.alias("words"), F.explode(starts).alias("at")).select(
        "block", "low", "high", "size", "at",
        F.concat_ws("\n", "host", F.array_join(F.slice("words", F.col("at") + 1, long), " ")).alias("suffix"))
    array = suffixes.select("suffix", "block", "low", "high").orderBy("suffix", "block")
    shared = (array.select("suffix", "low", "high").mapInArrow(_runs, "suffix string, low long, high long")
              .groupBy("suffix").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high"))
    # A block that two pages hold is repeated as a whole; of the others, hits that touch or overlap are one run.
    hit = suffixes.where("low = high").join(shared.select("suffix"), "suffix", "left_semi")
    order = Window.partitionBy("block").orderBy("at")
    apart = F.coalesce(F.col("at") > F.lag("at").over(order) + long, F.lit(False)).cast("int")
    run = hit.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order)).groupBy("block", "run").agg(
        F.min("at").alias("start"), F.least(F.max("at") + long, F.max("size")).alias("end"), F.max("size").alias("size"))
    partly = run.groupBy("block").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    whole = streams.where("low < high").select("block", size.alias("size"), F.array(F.struct(F.lit(0).alias("start"), size.alias("end"))).alias("runs"))
    return whole.unionByName(partly)


def in_long_stretches(found: DataFrame, long: int = LONG) -> DataFrame:
    """Rows of ``found`` (page, place, zone, block, size, runs) without short blocks that stand alone.

    A block of fewer than ``long`` words is no long substring by itself: it counts only where it and the blocks right beside
    it on its page, each repeated, hold ``long`` repeated words together.  Repeated rows of a page are one.
    """
    found = found.groupBy("page", "place", "block").agg(*[F.first(c).alias(c) for c in ("zone", "size", "runs")])
    order = Window.partitionBy("page").orderBy("place")
    stretch = Window.partitionBy("page", "_stretch")
    return (found.withColumn("_stretch", F.col("place") - F.dense_rank().over(order))
            .withColumn("_words", F.sum(_covered()).over(stretch))
            .where((F.col("size") >= long) | (F.col("_words") >= long)).drop("_stretch", "_words"))


def _covered() -> Column:
    return F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"])


def repeated_blocks(outside: DataFrame, long: int = LONG, share: float = COVERED) -> DataFrame:
    """(block): the blocks of which ``share`` of the words lie in repeated runs."""
    return repeated_runs(outside, long).where(_covered() >= share * F.col("size")).select("block")


def _without(text: Column, runs: Column) -> Column:
    """``text`` without the words of ``runs``, which are in order and apart."""
    words = F.split(text, " ")
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(words)))
    parts = F.zip_with(begins, ends, lambda a, b: F.slice(words, a + 1, F.greatest(b - a, F.lit(0))))
    return F.array_join(F.flatten(parts), " ")


def extract_text(pages: DataFrame, long: int = LONG, share: float = COVERED) -> DataFrame:
    """page_id, url, text, n_repeated: the blocks of each page without what the host repeats, joined by line feeds, and how
    many blocks outside articles are repeated for ``share`` of their words or more.

    A block of fewer than ``long`` words, such as a heading, goes only in a row of repeated blocks that hold as many together.
    Null and empty pages give the empty text.  Repeated rows each give their row; two rows with one page_id and
    url are one page, and so are copies of a page on its host, so their text is not repeated across pages.  Extra columns are
    left out.

    The first pass writes what lies outside articles, a small part of the pages, and the suffix array decides on all of
    it; the second builds the texts.  The markup is not shuffled; the blocks that may stay are, once.
    """
    bound_batches(pages.sparkSession)
    row = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    parsed = pages.select("page_id", "url", row.alias("page"), blocks_of(F.col("html")).alias("blocks"))
    # Repeated rows of one page say the same, so each place counts once.
    streams = pages.select(host_of(F.col("url")).alias("host"), row.alias("page"), streams_of(long)(F.col("html")).alias("stream"))
    outside = stage(streams.select(
        "host", "page", F.when(F.col("stream.said").isNull(), F.col("page")).otherwise(F.xxhash64("host", "stream.said")).alias("copy"),
        F.explode("stream.blocks").alias("b")).select(
        "host", "page", "copy", "b.place", "b.zone", F.xxhash64("host", "b.text").alias("block"), "b.text"), "html-outside")
    runs = repeated_runs(outside.select("host", F.col("copy").alias("page"), "block", "text"), long)
    gone = (in_long_stretches(outside.select("page", "place", "zone", "block").join(runs, "block"), long)
            .groupBy("page").agg(F.collect_set(F.when(F.col("zone") == OPEN, F.struct("place", "runs"))).alias("gone"),
                                 F.count_distinct(F.when(_covered() >= share * F.col("size"), F.col("place"))).alias("n_repeated")))
    # The check after it: what markup declares to be no main text goes too where the host says it once.
    stays = parsed.withColumn("blocks", F.filter("blocks", lambda b: b["zone"] != DECLARED))
    runs_at = lambda b: F.get(F.filter("gone", lambda g: g["place"] == b["place"]), F.lit(0))["runs"]
    left = F.transform("blocks", lambda b: F.when(b["zone"] == INSIDE, b["text"]).otherwise(
        F.coalesce(_without(b["text"], runs_at(b)), b["text"])))
    return stays.join(gone, "page", "left").select(
        "page_id", "url", F.array_join(F.filter(left, lambda t: t != ""), "\n").alias("text"),
        F.coalesce("n_repeated", F.lit(0)).cast("bigint").alias("n_repeated"))


def page_texts(pages: DataFrame) -> DataFrame:
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_repeated")
