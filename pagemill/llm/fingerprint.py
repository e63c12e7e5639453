"""Document fingerprints by locally consistent parsing.

Each level names phrases of the level below.  Runs of one symbol collapse first.  Deterministic coin
tossing then gives every symbol a label from it and its predecessor (twice the lowest bit in which they
differ, plus that bit), four times over, which leaves a handful of labels; their local maxima begin the phrases.
Where a phrase begins depends on a few symbols around it alone, so equal substrings get equal names inside, wherever
they stand.  The fingerprint is the smallest hashes of the names of the upper levels.

Texts are parsed many at a time in arrays; symbols of different texts never meet in a phrase.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import bound_batches, mix64

#: Levels of phrases at most.
LEVELS = 12
#: Level from which names count, in texts of any length; below, phrases are letters that all texts share.
FIRST_LEVEL = 2
#: Hashes kept.
KEEP = 64
#: Characters parsed at a time.
CHUNK = 1 << 19


def _label_table(width: int) -> np.ndarray:
    """Next label for each (label, predecessor) below ``width``."""
    a, b = np.meshgrid(np.arange(width), np.arange(width), indexing="ij")
    low = np.bitwise_count(((a ^ b) & -(a ^ b)) - 1)
    low[a == b] = 0
    return (2 * low + ((a >> low) & 1)).astype(np.uint8).ravel()


_TABLES = [_label_table(128), _label_table(16), _label_table(8)]
_WIDTHS = (128, 16, 8)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels after four rounds; ``first`` flags the first symbol of a text, whose predecessor is its complement."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[:1] = ~names[:1]
    before[first] = ~names[first]
    differ = names ^ before
    low = np.minimum(np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)), 63)
    labels = (2 * low + ((names >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for table, width in zip(_TABLES, _WIDTHS):
        code = labels.astype(np.uint16)
        code *= width
        code[1:] += labels[:-1]
        code[first] = code[first] // width * width + (labels[first] ^ 1)  # a predecessor that differs
        labels = table[code]
    return labels


def _level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of a level, and which of them begin a text."""
    n = len(names)
    # Runs of one symbol become one symbol that knows its length.
    new = np.ones(n, bool)
    new[1:] = names[1:] != names[:-1]
    new[first] = True
    starts = np.flatnonzero(new)
    if len(starts) < n:
        size = np.diff(np.append(starts, n)).astype(np.uint64)
        at = np.cumsum(new) - 1
        first = at[first]
        names = np.where(size > 1, mix64(names[starts] ^ (size << np.uint64(33))), names[starts])
        n = len(names)
    labels = _labels(names, first)
    begin = np.zeros(n, bool)
    begin[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    # A text's second and last symbols never begin a phrase, so no phrase depends on another text.
    begin[first[first + 1 < n] + 1] = False
    begin[first[1:] - 1] = False
    begin[first] = True
    starts = np.flatnonzero(begin)
    place = np.arange(n, dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, n))).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = mix64(names + place * np.uint64(0xA0761D6478BD642F))
        return mix64(np.add.reduceat(mixed, starts)), np.searchsorted(starts, first)


def fingerprints(texts: list[str], keep: int = KEEP) -> list[np.ndarray]:
    """The sorted smallest 32-bit hashes of each text's phrase names; for '' there is none.

    A text too short for the first counted level is named by its highest phrase.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    todo: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if text:
            todo.append(i)
            size += len(text)
        if todo and (size >= CHUNK or i == len(texts) - 1):
            _parse(texts, todo, keep, out)
            todo, size = [], 0
    if todo:
        _parse(texts, todo, keep, out)
    return out


def _parse(texts: list[str], which: list[int], keep: int, out: list[np.ndarray]) -> None:
    data = "".join(texts[i] for i in which).encode("utf-32-le", "surrogatepass")
    names = np.frombuffer(data, np.uint32).astype(np.uint64)
    sizes = np.array([len(texts[i]) for i in which])
    first = np.cumsum(sizes) - sizes
    gathered: list[tuple[np.ndarray, np.ndarray]] = []
    done = np.zeros(len(which), bool)  # texts that are one phrase already
    for level in range(1, LEVELS + 1):
        names, first = _level(names, first)
        counts = np.diff(np.append(first, len(names)))
        single = counts == 1
        use = np.repeat(~done & (single | (level >= FIRST_LEVEL)), counts)
        gathered.append((names[use], np.repeat(np.arange(len(first)), counts)[use]))
        done |= single
        if done.all():
            break
    value = np.concatenate([g[0] for g in gathered]) >> np.uint64(32)
    owner = np.concatenate([g[1] for g in gathered]).astype(np.uint64)
    both = np.unique((owner << np.uint64(32)) | value)
    begin = np.searchsorted(both, np.arange(len(which) + 1, dtype=np.uint64) << np.uint64(32))
    value = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for k, i in enumerate(which):
        out[i] = value[begin[k]:min(begin[k + 1], begin[k] + keep)].copy()


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimate of the share of phrase names in common: that of the smallest hashes of both; 1 for two empty ones."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    union = np.unique(np.concatenate([a, b]))[:keep]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, union[-1], "right")) / len(union)


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def half_replaced(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of another text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text in ``out`` (replaced if it exists); no shuffle."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf(returnType="string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([as_text(f) for f in fingerprints([t or "" for t in texts.to_pylist()])], pa.string())

    return docs.withColumn(out, of(F.col(text)))


REPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def _report(batches):
    """Rows sorted by block and place; each is told by the row behind it, a block's last by its guest."""
    held: list[tuple] = []  # (block, doc_id, text, guest)
    size = 0

    def emit(rows: list[tuple]) -> pa.RecordBatch | None:
        at = [i for i, (a, b) in enumerate(zip(rows, rows[1:])) if not a[3] and a[0] == b[0]]
        if not at:
            return None
        pairs = [(rows[i], rows[i + 1]) for i in at]
        edited = [half_replaced(a[2], b[2]) for a, b in pairs]
        own = fingerprints([r[2] for r in rows])
        changed = fingerprints(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([as_text(own[i]) for i in at]), pa.array([as_text(c) for c in changed]),
            pa.array([likeness(own[i], c) for i, c in zip(at, changed)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64())], names=REPORT.names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[2])
            if size >= 2 * CHUNK:
                if (out := emit(held)) is not None:
                    yield out
                held, size = held[-1:], len(held[-1][2])
    if (out := emit(held)) is not None:
        yield out


def edit_report(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near both, and the next document's, are.

    Rows are in descending order of doc_id (null last), rows with one id by text; "next" is the row behind in that order,
    and the first row after the last (a single row is its own next).  Null texts are empty; extra columns are left out.

    Texts are shuffled once, into ranges of ids.  A range ends with a copy of the row that begins the next one (its
    "guest"), so no row needs to look outside its task; the cuts are ids of the table, one for each range.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = blocks or 4 * tasks
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    shares = [i / n for i in range(1, n)] or [0.5]
    found = ids.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(10_000)).alias("cuts")).first()
    cuts = sorted({c for c in found.cuts or [] if c < found.top}) if found.top is not None else []
    # Block b holds the ids above cuts[b - 1] up to cuts[b]; the last goes up to the largest id, nulls go with the smallest.
    place = _bucket("doc_id", cuts)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("block", place)
    guest_of = F.when(F.col("doc_id") == F.lit(found.top), F.lit(0)) if found.top is not None else F.lit(0)
    if cuts:
        guest_of = F.when(F.col("doc_id").isin(cuts), F.col("block") + 1).otherwise(guest_of)
    seats = F.array_compact(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")),
                                    F.when(guest_of.isNotNull(), F.struct(guest_of.cast("int").alias("block"), F.lit(True).alias("guest")))))
    dealt = (rows.select("doc_id", "text", F.explode(seats).alias("seat"))
             .select(F.col("seat.block").alias("block"), "doc_id", "text", F.col("seat.guest").alias("guest"))
             .repartition(tasks, "block").sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), "text"))
    return dealt.mapInArrow(_report, REPORT)


def _bucket(column: str, cuts: list[int]):
    """How many cuts lie below the value, by a balanced tree of comparisons; 0 for null."""
    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) > F.lit(cuts[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))
    return tree(0, len(cuts))
