"""N-gram Jaccard join with signature trees.

1. Each text becomes its set of hashed word shingles; texts with equal sets are one node of the join.
2. Shingles are dealt by hash, packed in arrays, and counted: a set of which fewer shingles occur elsewhere than the
   threshold asks for has no partner.  Only the others go on.
3. Their sets are cut into so many ranges of hash values that two sets within the threshold must agree in a whole range
   (a pair differs in at most ``min(n) * (1 - t) / t`` elements, and there are more ranges than that).  Each range's
   content is one signature.  There are spare ranges, so linked sets agree in several of them, and each set leaves out
   as many of its most frequent signatures: a pair that agrees in c of them still shares the rarest of these c while
   each side leaves out fewer than c.  So a passage that many texts hold does not make them all one cluster.
   Nodes that share one of the others are in one cluster; pairs across clusters cannot be linked.
4. Inside a cluster, cut into blocks of bounded size, trees over the nodes hold OR-combined bitmaps and size
   ranges.  A dual traversal of two trees drops pairs of tree nodes by the largest overlap they leave possible;
   what stays is counted exactly.  Pairs of blocks are dealt out in so many rounds that the copies of texts that
   one round shuffles stay a fixed multiple of the texts.
5. Links make components.  A task emits at most one link per node it holds, enough to connect what it found.

The classes of sizes grow by the threshold, so linked sets are in one class or in neighbours; a set has signatures
for its own class and for the one below.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import Shared, bound_batches, drop_staged, list_array, mix64, release, stage, text_of, trimmed, word_hashes
from pagemill.llm.graph import components

WORDS = 3
#: Link when ``100 * common >= THRESHOLD * all``.
THRESHOLD = 90
#: Nodes of a block.
BLOCK = 256
#: Nodes of a leaf, bits of a bitmap.
LEAF, BITS = 16, 4096
#: Columns of a counting matrix.
COLUMNS = 1 << 12
#: Bits of the filter that spares texts without a candidate the shuffle.
FILTER_BITS = 1 << 26
#: Ranges beyond the largest number of differing elements, as a share of it, and at least so many; for each, an empty
#: range or a frequent signature can be left out.
SLACK, SPARE = 0.25, 2
#: Copies of a text in one round of block pairs, on average.
COPIES = 8
#: Shingles and documents packed together for counting.
PACKED, PACKED_DOCS = 1 << 20, 1 << 15
#: Bytes of text hashed at a time.
CHUNK = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_PLACES = mix64(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; the whole sequence where it is shorter; '' has none."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append(text.encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= CHUNK:
            out += _sets(group, words)
            group, size = [], 0
    return out + _sets(group, words)


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    if not texts:
        return []
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    hashes, starts = word_hashes(data, _IS_WORD[data])
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends)
    n = len(hashes) - words + 1
    with np.errstate(over="ignore"):
        whole = sum((hashes[i:n + i] * _PLACES[i] for i in range(words)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.zeros(0, np.uint64)
        whole = mix64(whole)
        out, begin = [], 0
        for end in last.tolist():
            count = end - begin
            if count >= words:
                out.append(np.unique(whole[begin:end - words + 1]))
            elif count:
                out.append(mix64((hashes[begin:end] * _PLACES[:count]).sum(keepdims=True) + np.uint64(count)))
            else:
                out.append(np.zeros(0, np.uint64))
            begin = end
    return out


def size_class(n: int, threshold: int = THRESHOLD) -> tuple[int, int, int, int]:
    """(class, its last size, the class below, that one's last size); linked sizes are in one class or neighbours."""
    low, k, before = 1, 0, 0
    while True:
        nxt = low * 100 // threshold + 1
        if n < nxt:
            return k, nxt - 1, k - 1, before
        low, before, k = nxt, nxt - 1, k + 1


_CLASSES: dict[tuple[int, int], tuple[int, int, int, int]] = {}


def signatures(s: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int, np.ndarray]]:
    """(class, spare, hashes of the set's ranges) for its own class of sizes and the one below; none where only equal sets link.

    Linked sets still share a hash of one class if each leaves out ``spare`` of its own, the last in one order of all hashes.
    """
    n = len(s)
    found = _CLASSES.get((n, threshold))
    if found is None:
        found = _CLASSES[(n, threshold)] = size_class(n, threshold)
    own, last, below, before = found
    if not n or last * (100 - threshold) // threshold == 0:
        return []
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        out = []
        for k, size in ((own, last), (below, before)):
            differ = size * (100 - threshold) // threshold
            if k < 0 or not differ:
                continue
            parts = differ + 1 + max(SPARE, int(differ * SLACK))
            edges = (np.arange(1, parts, dtype=np.float64) * (2.0 ** 64 / parts)).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
            names = mix64(total[at[1:]] - total[at[:-1]] + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(k << 32)))
            full = at[1:] > at[:-1]
            # A partner agrees in ``parts - differ`` ranges at least; if fewer are empty, a full one is among them.
            spare = parts - differ - 1 - (parts - int(full.sum()))
            out.append((k, spare, names[full]) if spare >= 0 else (k, 0, names))
    return out


def set_name(s: np.ndarray) -> int:
    """One signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        value = mix64(mix64(s ^ np.uint64(0x9FB21C651E98DF25)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))
    return int(value.view(np.int64)[0])


PACK = ("bucket bigint, chunk bigint, slots binary, counts binary, hashes binary, "
        "doc_ids array<bigint>, rows array<bigint>, sizes array<bigint>, nodes array<bigint>")
BASE = "doc_id bigint, row bigint, n_shingles bigint, node bigint, shared bigint"
_PACK_NAMES = ["bucket", "chunk", "slots", "counts", "hashes", "doc_ids", "rows", "sizes", "nodes"]
_LONGS = pa.list_(pa.int64())
_PACK_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), _LONGS, _LONGS, _LONGS, _LONGS]


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PACK_TYPES)], names=_PACK_NAMES)


def _pack(words: int, buckets: int):
    """Chunks of documents: one row tells its documents, and one row for each bucket holds their hashes in it.

    A chunk's name follows from its rows, so a task that runs again gives the same chunks.
    """
    def chunk(ids: list, rows: list, sets: list[np.ndarray], names: list, fresh: list[bool]) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            place = np.arange(1, len(rows) + 1, dtype=np.uint64)
            name = int(mix64(mix64(np.array(rows, np.int64).view(np.uint64) + place).sum(keepdims=True)).view(np.int64)[0])
        used = [s if f else s[:0] for s, f in zip(sets, fresh)]
        hashes = np.concatenate(used)
        slots = np.repeat(np.arange(len(used), dtype=np.uint16), [len(s) for s in used])
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        low, slots = hashes[order].astype(np.uint32), slots[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        out = [(-1 - name % buckets, name, None, None, None, ids, rows, [len(s) for s in sets], names)]
        for b in np.flatnonzero(np.diff(ends)).tolist():
            here, counts = np.unique(slots[ends[b]:ends[b + 1]], return_counts=True)
            if 3 * len(here) > len(ids) and counts.max() < 256:  # one byte for each document of the chunk
                every = np.zeros(len(ids), np.uint8)
                every[here] = counts
                here, counts = None, every.tobytes()
            else:
                here, counts = here.tobytes(), counts.astype(np.uint32).tobytes()
            out.append((b, name, here, counts, low[ends[b]:ends[b + 1]].tobytes(), None, None, None, None))
        return _packs(out)

    def run(batches):
        seen: set[int] = set()  # nodes of this task; copies are counted once
        held: tuple[list, ...] = ([], [], [], [], [])
        total = 0
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            for doc, row, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets):
                name = set_name(s) if len(s) else None
                for column, value in zip(held, (doc, row, s, name, name is not None and name not in seen)):
                    column.append(value)
                seen.add(name)
                total += len(s)
                if total >= PACKED or len(held[0]) >= PACKED_DOCS:
                    yield chunk(*held)
                    held, total = ([], [], [], [], []), 0
        if held[0]:
            yield chunk(*held)
    return run


def _runs(batches, key: int):
    """Rows of sorted batches, one list for each value of column ``key``."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count_shared(batches):
    """For each chunk and document, how many of its hashes in a bucket another document has too."""
    for rows in _runs(batches, 0):
        if rows[0][0] < 0:
            yield _packs(rows)
            continue
        hashes = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows])
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(hashes), bool)
        twice[1:] |= same
        twice[:-1] |= same
        shared = np.zeros(len(hashes), np.int64)
        shared[order] = twice
        out, at = [], 0
        for bucket, name, slots, counts, data, *_ in rows:
            n = np.frombuffer(counts, np.uint8 if slots is None else np.uint32).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(shared[at:at + len(data) // 4])])
            at += len(data) // 4
            ends = np.cumsum(n)
            part = total[ends] - total[ends - n]
            out.append((bucket, name, slots, part.astype(np.uint8 if slots is None else np.uint32).tobytes(), None, None, None, None, None))
        yield _packs(out)


def _sum_shared(batches):
    """A row for each document of a chunk, with the sum over all buckets."""
    for rows in _runs(batches, 1):
        for about in (r for r in rows if r[5] is not None):
            total = np.zeros(len(about[5]), np.int64)
            for r in rows:
                if r[2] is not None:
                    total[np.frombuffer(r[2], np.uint16)] += np.frombuffer(r[3], np.uint32)
                elif r[3] is not None:
                    total += np.frombuffer(r[3], np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (about[5], about[6], about[7], about[8], total)],
                                             names=["doc_id", "row", "n_shingles", "node", "shared"])


def shingle_table(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n_shingles, node, shared (shingles that occur in other texts too) of ``rows`` (doc_id, text, row).

    Hashes travel packed, four bytes each, once; ``shared`` may be too large where two of them agree in 32 bits
    and the bucket, never too small.  Of copies in one task, one has the number.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select("doc_id", "text", "row").mapInArrow(trimmed(_pack(words, tasks)), PACK)
            .repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_count_shared), PACK)
            .repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(_sum_shared), BASE))


def _sign(words: int, threshold: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            signed = []
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), words)):
                signed += [] if node in seen else [(node, *x) for x in signatures(s, threshold)]
                seen.add(node)
            values = np.concatenate([x[3] for x in signed]) if signed else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in signed], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))),
                                              list_array([len(x[3]) for x in signed], pa.array(values.view(np.int64)))],
                                             names=["node", "class", "spare", "signatures"])
    return run


def _near(texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """node, low: each node of ``texts`` (node, text) with the smallest node of those that it shares a signature with.

    The most frequent signatures of a node are left out, as many as its class spares; any order of all signatures would
    do, so it does not matter that a node's second row counts again.
    """
    signed = stage(texts.select("node", "text").mapInArrow(
        trimmed(_sign(words, threshold)), "node bigint, class int, spare int, signatures array<bigint>"), "signed")
    each = signed.select("node", "class", "spare", F.explode("signatures").alias("signature"))
    often = stage(each.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("times"))
                  .where("low < high").select("signature", "times"), "shared-signatures")
    release(texts.sparkSession)
    frequent_first = Window.partitionBy("node", "class").orderBy(F.desc("times"), F.desc("signature"))
    kept = stage(each.join(often, "signature").withColumn("place", F.row_number().over(frequent_first))
                 .where("place > spare").select("node", "signature"), "kept-signatures")
    for table in (signed, often):
        drop_staged(table)
    release(texts.sparkSession)
    shared = stage(kept.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
                   .select("signature", "low"), "lowest")
    near = stage(kept.join(shared, "signature").where("node <> low").select("node", "low").distinct(), "near")
    for table in (kept, shared):
        drop_staged(table)
    release(texts.sparkSession)
    return near


class Tree:
    """Bitmaps and size ranges over sets in order of size; level 0 holds leaves."""

    def __init__(self, sets: list[np.ndarray], leaf: int = LEAF):
        self.sets, self.leaf = sets, leaf
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = np.zeros((n, BITS), bool)
        for i, s in enumerate(sets):
            bits[i, (s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
        # Elements that share a bit with another one of their set; a bitmap's overlap may hide so many.
        excess = sizes - bits.sum(1)
        cut = np.arange(0, n, leaf)
        self.levels = [(np.packbits(np.logical_or.reduceat(bits, cut), axis=1).view(np.uint64), np.minimum.reduceat(sizes, cut),
                        np.maximum.reduceat(sizes, cut), np.maximum.reduceat(excess, cut))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, over = self.levels[-1]
            cut = np.arange(0, len(low), 4)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(over, cut)))

    def leaves_against(self, other: Tree, threshold: int) -> list[tuple[int, int]]:
        """Pairs of leaves that a dual traversal from both roots cannot rule out."""
        out, todo = [], [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while todo:
            la, a, lb, b = todo.pop()
            x, y = self.levels[la], other.levels[lb]
            if x[2][a] * 100 < threshold * y[1][b] or y[2][b] * 100 < threshold * x[1][a]:
                continue
            overlap = int(np.bitwise_count(x[0][a] & y[0][b]).sum()) + min(int(x[3][a]), int(y[3][b]))
            if overlap * (100 + threshold) < threshold * int(x[1][a] + y[1][b]):
                continue
            if not la and not lb:
                out.append((a, b))
            elif la >= lb:
                todo += [(la - 1, k, lb, b) for k in range(4 * a, min(4 * a + 4, len(self.levels[la - 1][1])))]
            else:
                todo += [(la, a, lb - 1, k) for k in range(4 * b, min(4 * b + 4, len(other.levels[lb - 1][1])))]
        return out


def links(left: list[np.ndarray], right: list[np.ndarray] | None = None, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """All linked pairs (i, j) of two blocks of sets, or i < j inside one."""
    order_a = sorted(range(len(left)), key=lambda i: (len(left[i]), int(left[i][0]) if len(left[i]) else 0))
    a = [left[i] for i in order_a]
    if right is None:
        order_b, b = order_a, a
    else:
        order_b = sorted(range(len(right)), key=lambda i: (len(right[i]), int(right[i][0]) if len(right[i]) else 0))
        b = [right[i] for i in order_b]
    if not a or not b:
        return []
    tree_a = Tree(a)
    tree_b = tree_a if right is None else Tree(b)
    pairs = [(x, y) for x, y in tree_a.leaves_against(tree_b, threshold) if right is not None or x <= y]
    if not pairs:
        return []
    # Exact counts: elements that one set alone holds cannot be common; the others are columns of 0 and 1.
    sets = a if right is None else a + b
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1
    use = seen[column] > 1
    owner, column = owner[use], shared[column[use]]
    common = {p: 0 for p in pairs}
    shift = 0 if right is None else len(a)
    leaf = tree_a.leaf
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = (column >= start) & (column < start + COLUMNS)
        matrix = np.zeros((len(sets), min(COLUMNS, int(column.max()) + 1 - start)), np.float32)
        matrix[owner[here], column[here] - start] = 1.0
        x, y = matrix[:len(a)], matrix[shift:]
        if len(pairs) * leaf * leaf * 4 > len(a) * len(b):
            full = x @ y.T
            for p in pairs:
                common[p] = common[p] + full[p[0] * leaf:(p[0] + 1) * leaf, p[1] * leaf:(p[1] + 1) * leaf]
        else:
            for p in pairs:
                common[p] = common[p] + x[p[0] * leaf:(p[0] + 1) * leaf] @ y[p[1] * leaf:(p[1] + 1) * leaf].T
    size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    out = []
    for (p, q), n in common.items():
        if isinstance(n, int):
            continue
        total = size_a[p * leaf:(p + 1) * leaf, None] + size_b[None, q * leaf:(q + 1) * leaf] - n
        for i, j in zip(*(w.tolist() for w in np.nonzero((n * 100 >= threshold * total) & (n > 0)))):
            i, j = i + p * leaf, j + q * leaf
            if right is not None or i < j:
                out.append((order_a[i], order_b[j]))
    return out


def _spanning(nodes_a: list[int], nodes_b: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """So many of the links as connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in pairs:
        x, y = root(nodes_a[i]), root(nodes_b[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((nodes_a[i], nodes_b[j]))
    return out


def _join_blocks(words: int, threshold: int):
    """Rows come sorted by (cluster, block a, block b): each run of them is one task of the dual traversal."""
    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        _, a, b, *_ = rows[0]
        sides = ({}, {})
        for _, _, _, own, node, text in rows:
            sides[0 if own == a else 1][node] = text
        left, right = (dict(zip(s, shingle_sets(list(s.values()), words))) for s in sides)
        if a == b:
            names = list(left)
            return _spanning(names, names, links([left[x] for x in names], None, threshold))
        first, second = list(left), list(right)
        return _spanning(first, second, links([left[x] for x in first], [right[x] for x in second], threshold))

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += solve(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        if held and (out := solve(held)):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def _bitmap(batches):
    """One fixed-size bitmap of the rows' keys for each task."""
    bytes_of = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FILTER_BITS)
        np.bitwise_or.at(bytes_of, at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
    at = np.flatnonzero(bytes_of)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bytes_of[at].astype(np.int32))], names=["at", "byte"])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``row`` is in ``wanted`` (row, ...), with its columns; most others stay out of the shuffle."""
    return docs.where(_may_hold(wanted)("row")).join(wanted.hint("merge"), "row")


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone`` (row); only rows that may be are shuffled."""
    may_hold = _may_hold(gone)(key)
    return docs.where(~may_hold).unionByName(docs.where(may_hold).join(gone.hint("merge"), key == gone["row"], "left_anti"))


def _may_hold(wanted: DataFrame):
    """A test of keys: false for most that are not in ``wanted``, true for all that are.

    A bitmap of a fixed size, whatever the data; where it fills up, it tests less and stays right.
    """
    spark = wanted.sparkSession
    parts = wanted.select("row").mapInArrow(_bitmap, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    data = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in parts.toArrow().to_batches():
        data[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint8)
    shared = Shared(spark, data.tobytes())

    @F.arrow_udf(returnType="boolean")
    def may_hold(rows: pa.Array) -> pa.Array:
        flags = np.frombuffer(shared.value, np.uint8)
        at = rows.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(FILTER_BITS)
        return pa.array((flags[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1)

    return may_hold


def _rounds(wanted: DataFrame) -> int:
    """In how many rounds pairs of blocks are dealt out: a text goes to as many pairs as its cluster has blocks."""
    copies, texts = wanted.agg(F.sum("blocks"), F.count(F.lit(1))).first()
    return max(1, -(-(copies or 0) // (COPIES * max(1, texts))))


def _links_of(members: DataFrame, words: int, threshold: int, k: int, rounds: int) -> DataFrame:
    """a, b: links inside those pairs of blocks of ``members`` (cluster, blocks, own, node, text) whose turn is round ``k``."""
    spark = members.sparkSession
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    if rounds > 1:
        others = F.filter(others, lambda other: (F.col("own") + other) % rounds == k)
    paired = members.select("cluster", "own", "node", "text", F.explode(others).alias("other")).select(
        "cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stage(paired.repartition(tasks, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
                  .mapInArrow(trimmed(_join_blocks(words, threshold)), "a bigint, b bigint"), "links")
    release(spark)
    return found


def jaccard_components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    component_id: the smallest doc_id that links lead to.  Empty and null texts have no shingles and no links.  Rows
    with equal texts are linked, rows with one doc_id and different texts are rows of their own.  A null doc_id is
    never the smallest; a row whose component has no other id keeps null.  Extra columns are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    base = stage(shingle_table(rows, words), "shingles")
    release(spark)
    able = base.where("node is not null").groupBy("node").agg(
        F.min("row").alias("row"), F.max("shared").alias("shared"), F.max("n_shingles").alias("n")).where(
        F.col("shared") * 100 >= F.col("n") * threshold).select("row", "node")
    able = stage(able, "able")
    texts = stage(_texts_of(rows.select("row", "text"), able), "texts")
    release(spark)
    near = _near(texts, words, threshold)
    clusters = stage(components(near), "clusters")
    blocks = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    wanted = stage(clusters.join(blocks, "component").select(
        "node", F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")), "wanted")
    rounds = _rounds(wanted)
    members = texts.select("node", "text").join(wanted.hint("merge"), "node")
    if rounds > 1:
        members = stage(members, "members")
    found = [_links_of(members, words, threshold, k, rounds) for k in range(rounds)]
    linked = stage(components(reduce(DataFrame.unionByName, found)), "linked")
    named = base.select("doc_id", "n_shingles", "node").join(linked, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    smallest = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("members"))
    grouped = stage(smallest.where("members > 1").select("component", "smallest"), "groups")
    # What is returned reads the sets, the groups and the links' components.
    for table in (able, texts, near, clusters, wanted, *found, *([members] if rounds > 1 else [])):
        drop_staged(table)
    return named.join(grouped, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; columns as given.

    Rows that repeat the kept doc_id in its component are dropped too; rows with a null id are kept.
    """
    report = stage(jaccard_components(docs, words, threshold), "components")
    key = F.xxhash64(F.col("doc_id").cast("bigint"))
    gone = stage(report.where("doc_id <> component_id").select(key.alias("row"), "doc_id").distinct().select("row"), "gone")
    release(docs.sparkSession)
    kept = _without(docs, key, gone)
    twice = report.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.head(1):
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)
