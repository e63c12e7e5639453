"""A Merkle manifest of a table, stored as digest-to-children records, and proofs by descent from the root.

Every group (a language, say) is a binary tree over its rows in order, and the roots of the groups are the leaves of one
more tree.  A tree of any size is cut into pages of ``DIGITS`` levels: a page belongs to 2 ** DIGITS neighbouring nodes and
holds the records of all nodes above them, up to the one digest that names the page.  So a level of pages is built by one
grouping of bounded rows, and there are log(n) / DIGITS levels.

A proof starts at the root.  The page of the root's digest is looked up, and the binary digits of the wanted rank choose a
child at every record, while the child that was not chosen is collected; the digest that comes out names the next page.
Pages are looked up once for all ranks that go through them, so a step joins one row a page and no key is hot.  At the leaf,
the segments of the path are reversed, so that siblings come from the leaf upwards.

An entry of a path is ``L`` or ``R`` and a digest, the sibling on that side, or '' where a node is its run's only one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagemill.llm.common import bound_batches, drop_staged, stage

#: Levels of a page.
DIGITS = 10

NODE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("children", T.ArrayType(T.StringType()))])


def digest_of(*columns: str) -> Column:
    """SHA-256 in hex over the values of a row, each its length in bytes, ':' and itself, or '-' for null."""
    def part(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _grow(leaves: list[str], levels: int) -> tuple[str, list[dict]]:
    """The digest ``levels`` above all leaves, and the records in between."""
    records = []
    for _ in range(levels):
        above = []
        for i in range(0, len(leaves), 2):
            children = leaves[i:i + 2]
            above.append(_hash(*children))
            records.append({"digest": above[-1], "children": children})
        leaves = above
    return leaves[0], records


def _descend(records: dict[str, list[str]], digest: str, rank: int, levels: int) -> tuple[str, list[str]]:
    """The digest at ``rank`` below ``digest``, and the children not chosen, from the leaf upwards."""
    path = []
    for level in range(levels - 1, -1, -1):
        children, digit = records[digest], rank >> level & 1
        path.append(("R" + children[1] if digit == 0 else "L" + children[0]) if len(children) > 1 else "")
        digest = children[digit]
    return digest, path[::-1]


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for entry in path:
        digest = _hash(entry[1:] + digest if entry[:1] == "L" else digest + entry[1:])
    return digest


def ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (staged) with ``idx``, the place from 0 in its ``group`` by ``order``, and ``n``, the size of the group.

    One range sort by (group, order) spreads a group of any size over all tasks; a place is the place in the task's part
    of the group plus the rows of the group in earlier parts, which come from one count a part and group.
    The second table is the written one that the first reads.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def number(batches):
        done = 0
        for batch in batches:
            at = pa.array(range(done, done + batch.num_rows), pa.int64())
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*batch.schema.names, "_at"])

    in_order = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    placed = stage(in_order.mapInArrow(number, schema), "merkle-places")
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_in"), "_first",
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    joined = placed.join(counts, (F.col("_part") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "n"), placed


def _pages(nodes: DataFrame, digits: int) -> DataFrame:
    """Pages of ``digits`` levels over (tree, idx, digest, n): the page's digest, its records, and what the nodes carry."""
    carried = [c for c in ("row",) if c in nodes.columns]
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / (1 << digits)).cast("bigint").alias("seg"), "n").agg(
        F.array_sort(F.collect_list(F.struct("idx", "digest", *carried))).alias("entries"))
    schema = T.StructType([*grouped.schema.fields, T.StructField("digest", T.StringType()),
                           T.StructField("levels", T.IntegerType()), T.StructField("nodes", T.ArrayType(NODE))])

    def grow(batches):
        kind = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
        for batch in batches:
            digests, levels, records = [], [], []
            for n, entries in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                levels.append(min(digits, max(0, n - 1).bit_length()))
                digest, made = _grow([e["digest"] for e in entries], levels[-1])
                digests.append(digest)
                records.append(made)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(levels, pa.int32()), pa.array(records, kind)],
                                             names=schema.names)

    return grouped.mapInArrow(grow, schema)


@dataclass
class Tree:
    """Trees of one kind.  ``leaves`` has a row a page of leaves, ``layers`` the pages of each height by digest (digest, nodes),
    ``roots`` a row a tree (tree, digest, height, levels)."""
    leaves: DataFrame
    layers: list[DataFrame]
    roots: DataFrame
    digits: int

    def drop(self) -> None:
        for table in [self.leaves, *self.layers, self.roots]:
            drop_staged(table)


def build(leaves: DataFrame, digits: int = DIGITS) -> Tree:
    """Trees over (tree, idx, digest, n, row): idx is the place from 0 in the tree of n leaves, row is carried along.

    Trees may be of any number and size; a null tree is one like any other.  Equal pages, from equal rows, share one record.
    """
    bound_batches(leaves.sparkSession)
    bottom = pages = stage(_pages(leaves, digits), "merkle-leaves")
    layers, roots, upper = [], [], []
    while True:
        layers.append(stage(pages.where(F.size("nodes") > 0).select("digest", "nodes").dropDuplicates(["digest"]), "merkle-pages"))
        whole = F.col("n") <= 1 << digits
        roots.append(pages.where(whole).select("tree", "digest", F.lit(len(roots)).alias("height"), "levels"))
        nodes = pages.where(~whole).select("tree", F.col("seg").alias("idx"), "digest", F.ceil(F.col("n") / (1 << digits)).cast("bigint").alias("n"))
        if nodes.isEmpty():
            break
        pages = stage(_pages(nodes, digits), "merkle-upper")
        upper.append(pages)
    top = stage(functools.reduce(DataFrame.unionByName, roots), "merkle-roots")
    for table in upper:
        drop_staged(table)
    return Tree(bottom, layers, top, digits)


@dataclass
class Manifest:
    """``rows``: a tree for each group; ``groups``: the tree over their roots; ``root``: its digest, null for no rows."""
    rows: Tree
    groups: Tree
    root: str | None

    def drop(self) -> None:
        """Remove the written records."""
        self.rows.drop()
        self.groups.drop()


def manifest(rows: DataFrame, group: str, order: list[str], digits: int = DIGITS) -> Manifest:
    """Trees over the rows of each ``group`` by ``order`` and ``leaf``, and the tree over their roots by group (all ascending, null first).

    ``rows`` has the group, the order, ``leaf`` (a digest) and any more columns, which the pages of leaves carry as ``row``.
    Rows that tie in group, order and leaf are the same to the manifest, whichever comes first.
    """
    held = stage(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-rows")
    placed, places = ranked(held, group, [*order, "leaf", "_tie"])
    trees = build(placed.select(F.col(group).alias("tree"), "idx", F.col("leaf").alias("digest"), "n", F.struct(*rows.columns).alias("row")), digits)
    tops = stage(trees.roots.select(F.lit(0).alias("_one"), "tree", "digest"), "merkle-tops")
    placed, top_places = ranked(tops, "_one", ["tree"])
    over = build(placed.select(F.col("_one").alias("tree"), "idx", "digest", "n", F.struct("tree").alias("row")), digits)
    first = over.roots.select("digest").first()
    for table in (held, places, tops, top_places):
        drop_staged(table)
    return Manifest(trees, over, first.digest if first else None)


def _walk(records: dict[str, list[str]], digest: str, levels: int) -> list[tuple[str, list[str]]]:
    """(digest, path) of every rank below a page's digest, each found by its digits."""
    below = [digest]
    for _ in range(levels):
        below = [c for d in below for c in records[d]]
    return [_descend(records, digest, rank, levels) for rank in range(len(below))]


PATH = T.ArrayType(T.StringType())


def _requests(trees: Tree, tops: DataFrame) -> DataFrame:
    """One row a page of leaves: (tree, seg, digest, levels, subroot, path), the path leading from the page's digest to the root.

    ``tops`` (top, above) has the path of each tree's own root.  Pages are looked up by digest, one height at a time.
    """
    digits = trees.digits
    starts = trees.roots.join(tops, F.col("tree").eqNullSafe(F.col("top"))).select(
        "tree", F.lit(0).cast("bigint").alias("seg"), "digest", "levels", F.col("digest").alias("subroot"), F.col("above").alias("path"), "height")
    schema = T.StructType([f for f in starts.schema.fields if f.name != "height"])

    def step(batches):
        """From a page to all pages below it."""
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in schema.names]
            for page in batch.to_pylist():
                records = {r["digest"]: r["children"] for r in page["nodes"]}
                out = [(page["tree"], page["seg"] << digits | rank, digest, digits, page["subroot"], path + page["path"])
                       for rank, (digest, path) in enumerate(_walk(records, page["digest"], page["levels"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.names)

    wanted = None
    for height in range(len(trees.layers) - 1, -1, -1):
        here = starts.where(F.col("height") == height).drop("height")
        wanted = here if wanted is None else here.unionByName(wanted)
        if height:
            wanted = wanted.join(trees.layers[height], "digest").select(*schema.names, "nodes").mapInArrow(step, schema)
    return wanted


def _proofs(trees: Tree, requests: DataFrame, schema: T.StructType, row_of: Callable) -> DataFrame:
    """``row_of(row, leaf, path, subroot)`` for every leaf of the requested pages."""
    pages = trees.leaves.select(F.col("tree").alias("_tree"), F.col("seg").alias("_seg"), "entries")
    found = (requests.join(pages, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("seg") == F.col("_seg")))
             .join(trees.layers[0], "digest", "left")  # a tree of one leaf has no record
             .select("digest", "levels", "subroot", "path", "entries", "nodes"))
    mask = (1 << trees.digits) - 1
    kinds = to_arrow_schema(schema)

    def leaves(batches):
        for batch in batches:
            for page in batch.to_pylist():
                records = {r["digest"]: r["children"] for r in page["nodes"] or ()}
                out = []
                for entry in page["entries"]:
                    digest, path = _descend(records, page["digest"], entry["idx"] & mask, page["levels"])
                    if digest != entry["digest"]:
                        raise ValueError(f"the manifest leads to {digest}, the row is {entry['digest']}")
                    out.append(row_of(entry["row"], digest, path + page["path"], page["subroot"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], names=kinds.names)

    return found.mapInArrow(leaves, schema)


def prove(built: Manifest, schema: T.StructType, row_of: Callable, pages: DataFrame | None = None) -> DataFrame:
    """A row of ``schema`` for each leaf, made by ``row_of(row, leaf, path to the root, subroot)``.

    ``pages`` (tree, seg) asks for some pages of leaves only; seg is a rank divided by 2 ** digits.
    """
    tree = built.rows.roots.schema["tree"].dataType
    own = T.StructType([T.StructField("top", tree), T.StructField("above", PATH)])
    first = built.groups.roots.select(F.col("tree").alias("top"), F.array().cast(PATH).alias("above"))
    tops = _proofs(built.groups, _requests(built.groups, first), own, lambda row, leaf, path, subroot: (row["tree"], path))
    requests = _requests(built.rows, tops)
    if pages is not None:
        keys = pages.select(F.col("tree").alias("_t"), F.col("seg").alias("_s"))
        requests = requests.join(keys, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("seg") == F.col("_s")), "left_semi")
    return _proofs(built.rows, requests, schema, row_of)


REPORT = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in (
    "leaf", "subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())])


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, shown): ``shown`` is the leaf of the row with one more in n_chars, where the row is tampered with, else null."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "n_chars", "text", (F.col("n_chars") + 1).alias("more"))
    return rows.select("doc_id", "lang", digest_of("doc_id", "source", "lang", "n_chars", "text").alias("leaf"),
                       F.when(key % 7 == 0, digest_of("doc_id", "source", "lang", "more", "text")).alias("shown"))


def manifest_report(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every document's leaf, its proof against the root, and the root that its (in one of seven cases tampered) leaf leads to.

    Trees by ``lang``, leaves by doc_id; null ids and languages come first, null fields count as '-', null texts differ from
    empty ones.  Rows of one id in one language are ordered by leaf.  A row of null id is not tampered with, nor is a null n_chars, so
    they verify.  Repeated rows come out as often as they go in; an empty table gives no rows; extra columns are left out.
    """
    built = manifest(document_leaves(docs), "lang", ["doc_id"], digits)
    root = built.root

    def row_of(row, leaf, path, subroot):
        folded = fold(row["shown"] or leaf, path)
        return row["doc_id"], leaf, subroot, root, _hash(*[p[1:] for p in path]), folded, folded == root

    return prove(built, REPORT, row_of)
