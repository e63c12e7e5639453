"""Periodic runs of words by longest common extensions over a difference cover.

A run is a maximal stretch of words that repeats with a smallest period ``q``.  The words of many texts form one
sequence of numbers in which each text ends with a number of its own, so nothing matches across texts.

* **Difference cover.**  Places whose residue modulo 73 is a power of two (modulo 73) are sampled: nine of 73.  For any two
  places a common shift below 73 leads both to sampled ones.
* **Sorting.**  Only the suffixes at sampled places are sorted: first by their next 73 words, then by prefix doubling, as a
  sampled place plus a multiple of 73 is sampled again.
* **Extension of two places.**  Words are compared one by one until both places are sampled; the rest is the minimum of the
  common prefixes between two ranks, read from a sparse table.
* **Harmonic grid.**  For each period ``q`` the places at multiples of ``q`` are compared with those ``q`` further on: n / q
  comparisons, n log n over all periods.  A stretch that holds three periods or more contains such a place, and how far it
  goes on to the left is found by halving, with the same extensions.
* A stretch found with several periods is a run of the smallest.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import bound_batches, text_of

#: Modulus of the cover; the powers of two modulo 73 are a perfect difference set.
MODULUS = 73
COVER = np.array(sorted({pow(2, k, MODULUS) for k in range(9)}))
#: Words handled together, and pairs of the grid compared at a time.
WORDS = 1 << 18
PAIRS = 1 << 19
#: A run holds four periods and six words at least.
LEAST_PERIODS = 4
LEAST_WORDS = 6


def _sync_table() -> np.ndarray:
    """The smallest shift that makes two places sampled, by both residues."""
    sampled = np.zeros(MODULUS, bool)
    sampled[COVER] = True
    shift = np.full((MODULUS, MODULUS), MODULUS, np.int64)
    for s in range(MODULUS - 1, -1, -1):
        hit = np.roll(sampled, -s)
        shift[np.ix_(hit, hit)] = s
    return shift


_SYNC = _sync_table()
_SLOT = np.full(MODULUS, -1, np.int64)
_SLOT[COVER] = np.arange(len(COVER))


class Extensions:
    """Common extensions of any two places of ``words`` (numbers from 0, the last one nowhere else)."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        # Behind the end stand numbers below all others, so that blocks of words are whole.
        self.words = np.concatenate([words.astype(np.int64) + 1, np.zeros(MODULUS + 1, np.int64)])
        self.at = at = (np.arange(-(-n // MODULUS))[:, None] * MODULUS + COVER).ravel()
        self.at = at = at[at < n]  # sampled places, in order
        if len(at):
            self._sort(at)

    def _number(self, place: np.ndarray) -> np.ndarray:
        """Which sample stands at a sampled place."""
        return place // MODULUS * len(COVER) + _SLOT[place % MODULUS]

    def _sort(self, at: np.ndarray) -> None:
        m = len(at)
        rank = _dense(self.words[at])
        tied = _tied(rank)
        for step in range(1, MODULUS):  # words of the first block; only ties look further
            if not len(tied):
                break
            rank = _refine(rank, self.words[at[tied] + step], tied)
            tied = tied[_tied(rank[tied])]
        levels = [rank]
        reach = MODULUS
        while len(tied):
            after = at[tied] + reach
            inside = after < self.n
            following = np.zeros(len(tied), np.int64)
            following[inside] = rank[self._number(after[inside])] + 1
            rank = _refine(rank, following, tied)
            tied = tied[_tied(rank[tied])]
            levels.append(rank)
            reach *= 2
        self.rank = rank
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        # Common prefixes of neighbours: whole blocks by the ranks of each round, the rest word by word.
        a, b = at[order[:-1]], at[order[1:]]
        same = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            size = MODULUS << level
            p, q = a + same, b + same
            equal = (p < self.n) & (q < self.n)
            equal[equal] = levels[level][self._number(p[equal])] == levels[level][self._number(q[equal])]
            same[equal] += size
        same += self._compare(a + same, b + same, np.full(len(a), MODULUS))
        table = [same.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(same):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def _compare(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from both places on, at most ``limit``, one by one."""
        same = np.zeros(len(a), np.int64)
        live = np.flatnonzero(limit > 0)
        step = 0
        while len(live):
            live = live[(a[live] + step < self.n) & (b[live] + step < self.n)]
            live = live[self.words[a[live] + step] == self.words[b[live] + step]]
            step += 1
            same[live] = step
            live = live[limit[live] > step]
        return same

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of the places ``a`` < ``b``."""
        limit = _SYNC[a % MODULUS, b % MODULUS]
        same = self._compare(a, b, limit)
        rest = np.flatnonzero((same == limit) & (b + limit < self.n))
        if len(rest):
            x = self.rank[self._number(a[rest] + limit[rest])]
            y = self.rank[self._number(b[rest] + limit[rest])]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            least = np.empty(len(rest), np.int64)
            for k in np.unique(level):
                of = level == k
                row = self.table[k]
                least[of] = np.minimum(row[low[of]], row[high[of] - (1 << int(k))])
            same[rest] += least
        return same


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks that leave room: how many values are smaller."""
    order = np.sort(values)
    return np.searchsorted(order, values).astype(np.int64)


def _refine(rank: np.ndarray, key: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Ranks after ordering the ``tied`` places of equal rank by ``key``."""
    rank = rank.copy()
    held = rank[tied]
    order = np.lexsort((key, held))
    r, k = held[order], key[order]
    index = np.arange(len(order))
    group = np.maximum.accumulate(np.where(np.r_[True, r[1:] != r[:-1]], index, 0))
    equal = np.maximum.accumulate(np.where(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])], index, 0))
    rank[tied[order]] = r + equal - group
    return rank


def _tied(rank: np.ndarray) -> np.ndarray:
    """Places whose rank another one has too."""
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    same = r[1:] == r[:-1]
    shared = np.zeros(len(r), bool)
    shared[1:] |= same
    shared[:-1] |= same
    return np.sort(order[shared])


def _grid(sizes: np.ndarray, starts: np.ndarray):
    """(place, period) pairs of all texts: multiples of each period, counted from the text's start, in bounded groups.

    Runs of a text of n words have periods up to n / 4.
    """
    long = np.flatnonzero(sizes >= LEAST_WORDS)
    if not len(long):
        return
    top = sizes[long] // LEAST_PERIODS
    text = np.repeat(long, top)
    period = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    pairs = (sizes[text] - 1) // period  # places k * period with a word one period further on
    done = np.cumsum(pairs)
    low = 0
    while low < len(text):
        base = done[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(done, base + PAIRS, "right")))
        count = pairs[low:high]
        which = np.repeat(np.arange(low, high), count)
        k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        yield starts[text[which]] + k * period[which], period[which], starts[text[which]]
        low = high


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text (numbers of words, from 0): rows of start, length, period, in that order.

    Every maximal stretch with smallest period q and at least max(6, 4 q) words is given once.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    top = max([int(t.max()) + 1 for t in texts if len(t)], default=0)
    words = np.concatenate([np.concatenate([t, [top + i]]) for i, t in enumerate(texts)]).astype(np.int64)
    ends = starts + sizes
    lce = None
    found = []
    for place, period, first in _grid(sizes, starts):
        # Most pairs differ at once; a run shows its first word again after a period.
        same = np.flatnonzero(words[place] == words[place + period])
        place, period, first = place[same], period[same], first[same]
        if not len(place):
            continue
        lce = lce or Extensions(words)
        right = lce.common(place, place + period)
        need = np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - period  # equal pairs of a run
        keep = right > need - period
        place, period, first, right, need = (x[keep] for x in (place, period, first, right, need))
        # How many pairs before the place are equal too, by halving: below the period unless the grid place before is in the run.
        low = np.zeros(len(place), np.int64)
        high = np.minimum(period, place - first)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            at = place[open_] - mid
            ok = lce.common(at, at + period[open_]) >= mid
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1
        whole = (low < period) & (low + right >= need)
        found.append(np.stack([place - low, low + right + period, period], 1)[whole])
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    if len(every):  # one stretch, several periods: the smallest
        new = np.r_[True, (every[1:, 0] != every[:-1, 0]) | (every[1:, 1] != every[:-1, 1])]
        every = every[new]
        every = every[np.lexsort((every[:, 2], every[:, 0]))]
    cut = np.searchsorted(every[:, 0], np.append(starts, ends[-1] + 1 if len(ends) else 0))
    return [every[cut[i]:cut[i + 1]] - np.array([starts[i], 0, 0]) for i in range(len(texts))]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of the words kept when each run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats, in one of ten texts as the checksum of the id decides."""
    n = len(words)
    if doc_id is None or not n:
        return words
    checksum = zlib.crc32(str(doc_id).encode())
    if checksum % 10:
        return words
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


REPORT = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in (
    "n_runs", "start", "length", "period", "exponent_milli")] + [
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])


def _summary(doc_id, words: list[bytes], runs: np.ndarray) -> tuple:
    best = (None, None, None, None)
    if len(runs):
        start, length, period = (int(x) for x in runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]])
        best = (start, length, period, 1000 * length // period)
        kept = [words[i] for i in np.flatnonzero(collapsed(len(words), runs))]
    else:
        kept = words
    listed = "".join(f"{s},{l},{q}\n" for s, l, q in runs.tolist())
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    number: dict[bytes, int] = {}
    return [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in texts]


def _groups(batches):
    """(ids, words of each text) with about ``WORDS`` words; a longer text alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = text.as_buffer().to_pybytes().split()  # bytes split at ASCII white space only
            if texts and size + len(words) > WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
    if texts:
        yield ids, texts


def run_report(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Runs of each document, and the text with every run cut down to its first period; no shuffle.

    With ``plant`` the texts are first changed by :func:`planted`.  Null and empty texts have no words and no runs; a null id
    plants nothing; repeated rows come out as often as they go in; extra columns are left out.
    """
    bound_batches(docs.sparkSession)

    def report(batches):
        for ids, texts in _groups(batches):
            if plant:
                texts = [planted(i, t) for i, t in zip(ids, texts)]
            rows = [_summary(*row) for row in zip(ids, texts, runs_of(_numbered(texts)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string())
                                              for k, c in enumerate(zip(*rows))], names=REPORT.names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(report, REPORT)


RUNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([
    T.StructField(c, T.LongType()) for c in ("start", "length", "period")])))])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs): every run of each text as start, length and period in words; [] where there is none."""
    bound_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def found(batches):
        for ids, texts in _groups(batches):
            lists = [[dict(zip(("start", "length", "period"), r)) for r in runs.tolist()] for runs in runs_of(_numbered(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, kind)], names=RUNS.names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(found, RUNS)
