"""Benchmark decontamination with suffix arrays of the training texts.

Every Arrow batch of documents is one shard.  The shard's token stream gets a suffix array over
the suffixes that begin like some test suffix (two words); the others cannot match.  Each test suffix
is looked up by binary search, which gives all places where its window occurs verbatim; windows
that continue each other are joined into longest matches with their places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Shared, bound_batches, give_back, list_array, text_of

#: Words of a window.
WINDOW = 10
#: Bytes of test text in one index; a larger test set is searched in as many blocks.
BLOCK_BYTES = 8 << 20
MATCHES = "array<struct<item_id:string,item_word:int,doc_word:int,words:int>>"
FOUND = f"struct<n_words:bigint,matches:{MATCHES}>"

# Word bytes: digits, letters (upper case counts as lower) and every byte of other characters.
FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
             for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass
class Tests:
    """Windows of the test items of one block."""
    vocabulary: dict[bytes, int]
    pairs: np.ndarray      # sorted codes of the first two words of windows
    singles: np.ndarray    # flag for each word that is a whole one-word item
    windows: np.ndarray    # sorted distinct windows by (length, words): int32[n, WINDOW], 0 behind a short one
    sizes: np.ndarray      # words of each window
    owner: list[list[tuple[str, int]]]  # (item, first word) for each window


def index_tests(items: list[tuple[str, str]], window: int = WINDOW) -> Tests:
    """Null texts and texts without words give no window; shorter items are one window."""
    vocabulary: dict[bytes, int] = {}
    places: dict[tuple[int, ...], list[tuple[str, int]]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text or "")]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            places.setdefault(tuple(ids[i:i + window]), []).append((item, i))
    keys = sorted(places)
    windows = np.zeros((len(keys), window), np.int32)
    for row, key in enumerate(keys):
        windows[row, :len(key)] = key
    base = len(vocabulary) + 1
    singles = np.zeros(base, bool)
    singles[[k[0] for k in keys if len(k) == 1]] = True
    pairs = np.unique(np.array([k[0] * base + k[1] for k in keys if len(k) > 1], np.int64))
    return Tests(vocabulary, pairs, singles, windows, np.array([len(k) for k in keys], np.int64),
                 [places[k] for k in keys])


def _rows(x: np.ndarray) -> np.ndarray:
    """Rows of non-negative numbers as byte strings that sort alike."""
    return np.ascontiguousarray(x.astype(">u4")).view(f"S{4 * x.shape[1]}").ravel()


def search_shard(tokens: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(window, place in the shard) of each verbatim occurrence.  0 in ``tokens`` matches nothing."""
    none = np.zeros(0, np.int64)
    if not len(tests.sizes) or not len(tokens):
        return none, none
    width = tests.windows.shape[1]
    padded = np.concatenate([tokens, np.zeros(width, tokens.dtype)])
    base = len(tests.vocabulary) + 1
    here = none
    if len(tests.pairs):
        known = np.flatnonzero((tokens > 0) & (padded[1:len(tokens) + 1] > 0))
        codes = padded[known].astype(np.int64) * base + padded[known + 1]
        at = np.minimum(np.searchsorted(tests.pairs, codes), len(tests.pairs) - 1)
        here = known[tests.pairs[at] == codes]
    if tests.singles.any():
        here = np.union1d(here, np.flatnonzero(tests.singles[tokens]))
    if not len(here):
        return none, none
    suffixes = _rows(padded[here[:, None] + np.arange(width)])
    order = np.argsort(suffixes, kind="stable")
    array, here = suffixes[order], here[order]
    found, places = [], []
    lengths = np.unique(tests.sizes)
    for size in lengths:
        which = np.flatnonzero(tests.sizes == size)
        low = np.searchsorted(array, _rows(tests.windows[which]), "left")
        if size == width:
            high = np.searchsorted(array, _rows(tests.windows[which]), "right")
        else:  # all suffixes that begin with the short window: up to the next larger one
            after = tests.windows[which].copy()
            after[:, size - 1] += 1
            high = np.searchsorted(array, _rows(after), "left")
        n = high - low
        if n.any():
            first = np.repeat(low, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(which, n))
            places.append(here[first + step])
    return (np.concatenate(found), np.concatenate(places)) if found else (none, none)


def longest(hits: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Join windows that continue each other: (item, item word, document word, words)."""
    out: list[list] = []
    for diagonal, item, word, size in sorted((p - i, item, p, n) for item, i, p, n in hits):
        last = out[-1] if out else None
        if last and last[0] == diagonal and last[1] == item and word <= last[2] + last[3]:
            last[3] = max(last[3], word + size - last[2])
        else:
            out.append([diagonal, item, word, size])
    return sorted((item, word - diagonal, word, size) for diagonal, item, word, size in out)


def search_batch(texts: list[str], tests: Tests) -> tuple[list[int], list[list[tuple[str, int, int, int]]]]:
    """Words and longest matches of each text of a shard."""
    get = tests.vocabulary.get
    lists = [np.array([get(w, 0) for w in words_of(t)], np.int32) for t in texts]
    counts = [len(x) for x in lists]
    ends = np.cumsum(np.array(counts, np.int64) + 1)
    tokens = np.concatenate([x for ids in lists for x in (ids, np.zeros(1, np.int32))] or [np.zeros(0, np.int32)])  # a 0 behind each document
    which, places = search_shard(tokens, tests)
    hits: dict[int, list] = {}
    for doc, window, place in zip(np.searchsorted(ends, places, "right").tolist(), which.tolist(), places.tolist()):
        word = place - (int(ends[doc]) - 1 - counts[doc])
        hits.setdefault(doc, []).extend((item, i, word, int(tests.sizes[window])) for item, i in tests.owner[window])
    return counts, [longest(hits[d]) if d in hits else [] for d in range(len(texts))]


def _matcher(shared):
    @F.arrow_udf(returnType=FOUND)
    def match(texts: pa.Array) -> pa.Array:
        counts, found = search_batch(texts.to_pylist(), shared.value)
        rows = [r for f in found for r in f]
        struct = pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3)]],
            names=["item_id", "item_word", "doc_word", "words"])
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), list_array([len(f) for f in found], struct)], names=["n_words", "matches"])
    return match.asNondeterministic()


def test_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The test items in blocks of bounded size; a longer single item is a block of its own."""
    block, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        if block and size + len(text or "") > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, matches and n_hit (words inside an occurrence); existing such columns are replaced.

    The benchmark is the query set: its index is sent to the executors in blocks of ``block_bytes``, each
    searched against every document in the same pass over the texts.  No shuffle.  Null texts have no
    words; null item ids count as the empty string; repeated items count once by id.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    indexes = [Shared(spark, index_tests(b, window)) for b in test_blocks(benchmark, block_bytes)]
    if not indexes:
        indexes = [Shared(spark, index_tests([], window))]
    temporary = [f"_found_{i}" for i in range(len(indexes))]
    out = docs.withColumns({t: _matcher(x)(text_of(text)) for t, x in zip(temporary, indexes)})
    return out.withColumns({
        "n_words": F.col(f"{temporary[0]}.n_words"),
        "matches": F.flatten(F.array(*[F.col(f"{t}.matches") for t in temporary]))}).withColumn(
        "n_hit", hit_words(F.col("matches"))).drop(*temporary)


def hit_words(matches: Column) -> Column:
    """Words inside at least one match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["doc_word"].cast("bigint").alias("start"), (m["doc_word"] + m["words"]).cast("bigint").alias("end"))))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["end"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n")),
        lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any verbatim window of the benchmark; columns as given."""
    whole = docs.select(F.struct("*").alias("_row"), "text")
    return find_contamination(whole, benchmark).where("n_hit = 0").select("_row.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.withColumn("_items", items).select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest_match"))
