"""Word windows that repeat across documents, found by level-wise doubling.

A window of 2L words can repeat only if the windows of L words inside it do.  So windows are counted at one length, and those that
repeat there alone are extended to twice that length, and so on while any survive.  The first length is half of the one asked for,
and there one window stands for all: of the L-word windows inside a window of 2L words the one with the smallest hash is
taken, which is the same wherever the longer window stands.  About one in L / 2 places is counted so.

What meets at a hash is (hash, document), once a document, sorted, and read as a stream that remembers one document, so a window
that is everywhere needs no memory.  Windows that many documents hold (found in a sample, which decides only where rows go)
do not meet at all: their first document comes from a combined minimum, and their rows go to the tasks of their documents.

Windows are known by 64-bit hashes; a result would be wrong only where two different windows of a corpus share one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import bound_batches, drop_staged, mix64, stage, text_of, word_hashes

#: Bytes of text hashed together.
CHUNK = 1 << 20
#: One document in so many is looked at for windows that many documents hold,
SAMPLE = 64
#: which are those in this share of the sample, and this many of its documents at least;
HOT_SHARE = 0.005
HOT_LEAST = 32
#: the most frequent so many are sent to all tasks, the others meet at their hash like any window.
HOT_MOST = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Windows:
    """Hashes of the word windows of some texts, which follow one another in one array of words."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts), np.uint8)
        words, at = word_hashes(data, ~_SPACE[data])
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(at, np.cumsum(sizes) - sizes)  # each text's first word
        self.size = np.diff(np.append(self.first, len(words)))
        self.left = np.repeat(self.first + self.size, self.size) - np.arange(len(words))  # words from here to the text's end
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(words) - 1), _BASE)]), dtype=np.uint64)[:len(words)]
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])
            self.undo = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(words) - 1), _INVERSE)]), dtype=np.uint64)[:len(words)]

    def hashes(self, length: int) -> np.ndarray:
        """Of the window that begins at each word; meaningless where the text ends before (``left < length``)."""
        n = len(self.left)
        out = np.zeros(n, np.uint64)
        if n >= length:
            with np.errstate(over="ignore"):
                out[:n - length + 1] = mix64((self.sums[length:] - self.sums[:n - length + 1]) * self.undo[:n - length + 1])
        return out

    def least(self, length: int, inside: int) -> np.ndarray:
        """The smallest hash of the windows of ``inside`` words within the window of ``length`` at each word."""
        low, width, wanted = self.hashes(inside), 1, length - inside + 1
        while 2 * width <= wanted:
            low[:-width] = np.minimum(low[:-width], low[width:])
            width *= 2
        if wanted > width and len(low) > wanted - width:
            low[:width - wanted] = np.minimum(low[:width - wanted], low[wanted - width:])
        return low

    def candidates(self, length: int, half: int, known: list[np.ndarray] | None, sampled: bool) -> np.ndarray:
        """Flags of the words where a window of ``length`` begins that may repeat: its half windows are among those ``known`` of its text."""
        fits = self.left >= length
        if known is None:
            return fits
        values = self.least(length, half) if sampled else self.hashes(half)
        good = np.zeros(len(fits), bool)
        for first, size, of in zip(self.first, self.size, known):
            if len(of):
                good[first:first + size] = np.isin(values[first:first + size], of)
        if not sampled:
            good[:len(good) - (length - half)] &= good[length - half:]
        return fits & good


def _once(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value of each text once."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return text[new], values[new]


def _chunks(batches, columns: int = 2):
    """Lists of columns with about ``CHUNK`` bytes of text in the second."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:columns])):
            if rows and size + len(row[1]) > CHUNK:
                yield list(zip(*rows))
                rows, size = [], 0
            rows.append(row)
            size += len(row[1])
    if rows:
        yield list(zip(*rows))


def _known(lists) -> list[np.ndarray]:
    return [np.array(x or (), np.int64).view(np.uint64) for x in lists]


def _level_windows(chunk, length: int, half: int, sampled: bool) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of a level's windows in a chunk (ids, texts[, known hashes]), each once a text.

    With ``sampled`` they are the smallest windows of ``half`` words inside each window of ``length``; otherwise the windows of
    ``length`` words whose half windows are known to repeat.
    """
    windows = Windows(list(chunk[1]))
    if len(chunk) == 2:
        places = np.flatnonzero(windows.candidates(length, half, None, True))
        values = windows.least(length, half)[places]
        new = np.ones(len(places), bool)
        new[1:] = (values[1:] != values[:-1]) | (np.diff(places) != 1)
        places, values = places[new], values[new]
    else:
        places = np.flatnonzero(windows.candidates(length, half, _known(chunk[2]), sampled))
        values = windows.hashes(length)[places]
    text, values = _once(np.searchsorted(windows.first, places, "right") - 1, values)
    return np.array(chunk[0], np.int64)[text], values


MET = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("known", T.BooleanType())])
HIT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("hash", T.LongType())])
FIRST = T.StructType([T.StructField("hash", T.LongType()), T.StructField("doc", T.LongType())])


def _hot(docs: DataFrame, level: dict, sample: int, least: int) -> np.ndarray:
    """Sorted hashes that many documents of a sample hold."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    n, width = some.count(), len(docs.columns)

    def seen(batches):
        for chunk in _chunks(batches, width):
            doc, values = _level_windows(chunk, **level)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(doc)], names=FIRST.names)

    often = (some.mapInArrow(seen, FIRST).groupBy("hash").agg(F.count_distinct("doc").alias("n"))
             .where(F.col("n") >= max(2, least, HOT_SHARE * n)).orderBy(F.desc("n")).limit(HOT_MOST))
    return np.sort(np.array([r.hash for r in often.collect()], np.int64).view(np.uint64))


def _first_documents(docs: DataFrame, level: dict, hot: np.ndarray) -> np.ndarray:
    """The smallest document of each hot window."""
    width = len(docs.columns)

    def least(batches):
        for chunk in _chunks(batches, width):
            doc, values = _level_windows(chunk, **level)
            mine = np.isin(values, hot)
            doc, values = doc[mine], values[mine]
            order = np.lexsort((doc, values))
            doc, values = doc[order], values[order]
            new = np.ones(len(doc), bool)
            new[1:] = values[1:] != values[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(values[new].view(np.int64)), pa.array(doc[new])], names=FIRST.names)

    rows = docs.mapInArrow(least, FIRST).groupBy("hash").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).collect()
    first = {r.hash: r.doc for r in rows}
    return np.array([first[h] for h in hot.view(np.int64).tolist()], np.int64)


def _repeated(docs: DataFrame, level: dict, later: bool, sample: int, least: int) -> DataFrame:
    """(doc, hash) of the windows of a level that more than one document holds; with ``later`` of all but the smallest document."""
    hot = _hot(docs, level, sample, least)
    firsts = _first_documents(docs, level, hot) if later and len(hot) else None
    width = len(docs.columns)

    def emit(batches):
        for chunk in _chunks(batches, width):
            doc, values = _level_windows(chunk, **level)
            key, known = values, np.zeros(len(values), bool)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
                known = hot[place] == values
                if later:  # decided here: the smallest document's rows go
                    keep = ~known | (doc > firsts[place])
                    doc, key, known = doc[keep], key[keep], known[keep]
                # A known row goes anywhere; its hash comes back out of the key.
                key = np.where(known, key ^ mix64(doc.view(np.uint64)), key)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(known)], names=MET.names)

    def meet(batches):
        held = None  # the hash read last, its smallest document, and whether that was given out
        for batch in batches:
            key, doc, known = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            out_doc, out_hash = [doc[known]], [(key[known].view(np.uint64) ^ mix64(doc[known].view(np.uint64))).view(np.int64)]
            key, doc = key[~known], doc[~known]
            if len(key):
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                goes_on = held is not None and held[0] == key[0]
                begin = np.flatnonzero(new)
                first = doc[begin].copy()
                given = np.zeros(len(begin), bool)
                if goes_on:
                    first[0], given[0] = held[1], held[2]
                group = np.cumsum(new) - 1
                after = doc > first[group]
                shared = np.zeros(len(begin), bool)
                shared[group[after]] = True
                out_doc.append(doc[after])
                out_hash.append(key[after])
                if not later:
                    fresh = shared & ~given
                    out_doc.append(first[fresh])
                    out_hash.append(key[begin][fresh])
                held = (key[-1], first[-1], bool(given[-1] or shared[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_hash))], names=HIT.names)

    return docs.mapInArrow(emit, MET).repartition("key").sortWithinPartitions("key", "doc").mapInArrow(meet, HIT)


def _by_document(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc").agg(F.collect_set("hash").alias("hashes"))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))


def _kept_digest(words: list[bytes], removed: np.ndarray) -> tuple[int, str]:
    if removed.any():
        words = [words[i] for i in np.flatnonzero(~removed)]
    return int(removed.sum()), hashlib.sha256(b" ".join(words)).hexdigest()


REPORT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                       T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _removed(windows: Windows, length: int, known: list[np.ndarray]) -> list[np.ndarray]:
    """Flags of each text's words that a known window covers."""
    values = windows.hashes(length)
    flags = []
    for first, size, of in zip(windows.first, windows.size, known):
        change = np.zeros(size + 1, np.int32)
        if len(of) and size >= length:
            starts = np.flatnonzero(np.isin(values[first:first + size - length + 1], of))
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
        flags.append(np.cumsum(change[:size]) > 0)
    return flags


def _reports(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=REPORT.names)


def remove_repeats(docs: DataFrame, words: int = 50, sample: int = SAMPLE, hot_least: int = HOT_LEAST) -> DataFrame:
    """Each document without the words that a window of ``words`` words covers which a document of smaller id holds too.

    Windows are judged on the texts as given.  Repeats longer than ``words`` are covered by windows of that length, so
    doubling ends there; :func:`repeat_levels` goes on.  Null and empty texts have no words.  A null id is compared with
    nothing: its text stays, and removes nothing.  Rows of one id do not remove from each other; they lose what any smaller id
    holds.  Repeated rows come out as often as they go in; extra columns are left out.
    """
    bound_batches(docs.sparkSession)
    rows = _identified(docs)
    half = -(-words // 2)
    level = {"length": words, "half": half, "sampled": True}
    near = _by_document(_repeated(rows.where("doc_id is not null"), level, False, sample, hot_least))
    sifted_type = T.StructType([*REPORT.fields, T.StructField("text", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def sift(batches):
        """A text without repeated half windows is done; the others go on with theirs."""
        for batch in batches:
            done = []
            for text, hashes in zip(batch.column(1), batch.column(2)):
                words_of = text.as_py().split()
                done.append((len(words_of), 0, None if hashes.is_valid else hashlib.sha256(b" ".join(words_of)).hexdigest()))
            open_ = batch.column(2).is_valid()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))),
                 pa.array([t if o else None for t, o in zip(batch.column(1).to_pylist(), open_.to_pylist())], batch.column(1).type), batch.column(2)],
                names=sifted_type.names)

    joined = rows.join(near, rows["doc_id"] == near["doc"], "left").select("doc_id", "text", "hashes")
    sifted = stage(joined.mapInArrow(sift, sifted_type), "repeats-sifted")
    live = sifted.where("text is not null").select("doc_id", "text", "hashes")
    gone = _by_document(_repeated(live, level, True, sample, hot_least))

    def remove(batches):
        for ids, texts, lists in _chunks(batches, 3):
            out = []
            for doc_id, text, flags in zip(ids, texts, _removed(Windows(list(texts)), words, _known(lists))):
                of = text.split()
                out.append((doc_id, len(of), *_kept_digest(of, flags)))
            yield _reports(out)

    texts = live.select("doc_id", "text")
    cut = texts.join(gone, texts["doc_id"] == gone["doc"], "left").select("doc_id", "text", "hashes").mapInArrow(remove, REPORT)
    return sifted.where("text is null").select(*REPORT.names).unionByName(cut)


def repeat_levels(docs: DataFrame, words: int = 50, sample: int = SAMPLE, hot_least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, length, windows): at each length words, 2 words, 4 words ... the windows of a document that others hold too.

    Doubling goes on until no window survives.  Documents without a repeated window of ``words`` words are not listed.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = _identified(docs).where("doc_id is not null").distinct()
    half, length, sampled = -(-words // 2), words, True
    live = stage(rows, "repeats-texts")
    first = {"length": words, "half": half, "sampled": True}
    hits = _repeated(live, first, False, sample, hot_least)
    levels = []
    while True:
        near = _by_document(hits)
        narrowed = stage(live.select("doc_id", "text").join(near, live["doc_id"] == near["doc"]).select("doc_id", "text", "hashes"), "repeats-texts")
        drop_staged(live)
        live = narrowed
        found = stage(_repeated(live, {"length": length, "half": half, "sampled": sampled}, False, sample, hot_least), f"repeats-{length}")
        if found.isEmpty():
            break
        levels.append(found.groupBy(F.col("doc").alias("doc_id")).agg(F.count_distinct("hash").alias("windows"))
                      .select("doc_id", F.lit(length).alias("length"), "windows"))
        hits, half, length, sampled = found, length, 2 * length, False
    empty = spark.createDataFrame([], "doc_id bigint, length int, windows bigint")
    for level in levels:
        empty = empty.unionByName(level)
    return empty
