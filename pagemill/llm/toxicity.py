"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored words.

A token that looks disguised (digits or signs among letters, letters drawn out, letters spaced out)
becomes a lattice of what each character may stand for, at a cost.  Viterbi search under a character
trigram model picks the likeliest word.  The model counts the letters of all documents.  Words, plain or
restored, are scored by whole word, beginning and ending; the weights and the final curve are learnt from labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Shared, bound_batches, give_back, text_of

#: Labelled documents that the classifier is fitted on, at most; chosen by a hash of the id.
MAX_LABELLED = 20_000
#: Features kept, those of the largest weight.
MAX_FEATURES = 50_000
#: Labelled documents of label 1 that hold a feature, at least.
LEAST_SEEN = 3
#: Standard deviations by which a weight is lowered.
CAUTION = 1.3
#: Characters counted together.
TOGETHER = 1 << 19
#: Features counted in a task before they go out.
COUNTED = 150_000
#: Words a worker remembers.
REMEMBERED = 250_000
THRESHOLD = 0.7
#: Characters of a token above which what never counts is taken out before it is decoded.
LONG = 64
#: Characters decoded at once; longer tokens are decoded in windows that overlap by half.
WINDOW = 128
#: Letters of a word found inside a run of spaced letters, and inside another token, at least: shorter ones stand there by chance.
INSIDE_SPACED, INSIDE = 3, 4

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûüœ"
SIZE = len(LETTERS) + 1  # 0: anything else
# What signs stand for, and separators inside spaced words.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
         "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "§": "s", "%": "o", "*": "aeiou", "#": "h", "^": "a"}
SEPARATORS = " .-_*~,/\\'’·•"
LOOK_COST, DROP_COST, KEEP_SIGN_COST, REPEAT_COST = 0.7, 0.3, 6.0, 0.2
SPACED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")
INNER = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W_][\d@$!|+€£]|[\d@$!|+€£][^\W\d_]|(?:^|_)[^\W_]_[^\W_](?:_|$)")
DRAWN = re.compile(r"(.)\1\1")
EDGE = re.compile(r"^\W+|\W+$")
GAP = re.compile(r"\s+")


def codes_of(texts: list[str]) -> np.ndarray:
    """Letter numbers of the texts, 0 for all other characters and between texts."""
    points = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    look = np.zeros(0x180, np.uint8)
    look[[ord(c) for c in LETTERS]] = np.arange(1, SIZE)
    return look[np.where(points < 0x180, points, 0)]


def _count_trigrams(batches):
    total = np.zeros(SIZE ** 3, np.int64)
    for batch in batches:
        group, size = [], 0
        for text in [*batch.column(0).to_pylist(), None]:
            if group and (text is None or size > TOGETHER):
                c = np.concatenate([np.zeros(2, np.int32), codes_of(group).astype(np.int32), np.zeros(1, np.int32)])
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE ** 3)
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])


class LetterModel:
    """Log probabilities of a letter after two others; unseen ones fall back to shorter contexts."""

    def __init__(self, trigrams: np.ndarray):
        t = trigrams.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        one = t.sum((0, 1)) + 1.0
        one /= one.sum()
        two = t.sum(0) + 8.0 * one
        two /= two.sum(1, keepdims=True)
        three = t + 8.0 * two[None]
        self.log = np.log(three / three.sum(2, keepdims=True)).astype(np.float32)
        self.number = {c: i + 1 for i, c in enumerate(LETTERS)}


def letter_model(docs: DataFrame, text: str = "text") -> LetterModel:
    """Counted over all documents; the table has a fixed size."""
    bound_batches(docs.sparkSession)
    rows = (docs.select(text_of(text).alias("text")).mapInArrow(_count_trigrams, "at long, n long")
            .groupBy("at").agg(F.sum("n").alias("n")).collect())
    table = np.zeros(SIZE ** 3, np.int64)
    for r in rows:
        table[r.at] = r.n
    return LetterModel(table)


def suspicious(token: str) -> bool:
    return " " in token or bool(INNER.search(token) or DRAWN.search(token))


def restore(token: str, model: LetterModel, best: int = 3) -> list[str]:
    """The likeliest readings of a token, best first.

    A state of the lattice is the last two letters; each keeps its ``best`` cheapest readings.
    """
    log, number = model.log, model.number
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for c in token:
        new: dict[tuple[int, int], list[tuple[float, str]]] = {}
        plain = number.get(c, 0)
        options = [(x, LOOK_COST) for x in LOOKS.get(c, "")]
        if plain:
            options.append((c, 0.0))
        drop = DROP_COST if not plain and (c in SEPARATORS or c in LOOKS or not c.isalnum()) else None
        if not options and drop is None:
            options.append((c, KEEP_SIGN_COST))
        for (a, b), paths in states.items():
            for cost, word in paths:
                for x, extra in options:
                    n = number.get(x, 0)
                    new.setdefault((b, n), []).append((cost + extra - float(log[a, b, n]), word + x))
                    if word[-1:] == x:
                        new.setdefault((a, b), []).append((cost + REPEAT_COST, word))
                if drop is not None:
                    new.setdefault((a, b), []).append((cost + drop, word))
        states = {}
        for key, paths in new.items():
            kept: dict[str, float] = {}
            for cost, word in sorted(paths):
                kept.setdefault(word, cost)
                if len(kept) == best:
                    break
            states[key] = [(cost, word) for word, cost in kept.items()]
    ends: dict[str, float] = {}
    for (a, b), paths in states.items():
        for cost, word in paths:
            total = cost - float(log[a, b, 0])
            if word and total < ends.get(word, math.inf):
                ends[word] = total
    return sorted(ends, key=lambda w: (ends[w], w))[:best]


def features(word: str) -> list[str]:
    return [f"={word}", *[f"^{word[:n]}" for n in range(3, min(7, len(word)))],
            *[f"${word[-n:]}" for n in range(4, min(7, len(word)))]]


def shrink(token: str) -> str:
    """A long token without the characters that every reading drops, and with at most two of one character in a row."""
    if len(token) <= LONG:
        return token
    return re.sub(r"(.)\1{2,}", r"\1\1", "".join(c for c in token if c.isalnum() or c in LOOKS), flags=re.S)


def plain_letters(word: str) -> str:
    """The word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def readings(token: str, model: LetterModel) -> tuple[list[str], list[str]]:
    """The words that a token of a lower-case text may be, and texts that may hold words anywhere.

    A token without look-alikes, signs between letters or drawn-out letters is itself.  Any other one, of whatever length, is
    decoded: whole where one window holds it, else in windows that overlap by half; words count anywhere in what comes out.
    """
    word = EDGE.sub("", token)
    words = [word] if word else []
    if word and (bare := plain_letters(word)) != word:
        words.append(bare)
    if not suspicious(word or token):
        return words, []
    short = shrink(word or token)
    if len(short) <= WINDOW:
        found = restore(short, model)
        return words + found, found
    return words, [r for at in range(0, len(short) - WINDOW // 2, WINDOW // 2) for r in restore(short[at:at + WINDOW], model)]


def whole_sizes(known) -> list[int]:
    """Lengths of the whole words among features."""
    return sorted({len(f) - 1 for f in known if f[0] == "="})


def features_of(token: str, model: LetterModel, sizes: list[int]):
    """Features of a token's readings, and the whole words of ``sizes`` letters that stand anywhere inside."""
    words, texts = readings(token, model)
    for word in words:
        yield from features(word)
    least = INSIDE_SPACED if " " in token else INSIDE
    for text in texts:
        yield from {f"={text[at:at + n]}" for n in sizes if n >= least for at in range(len(text) - n + 1)}


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a text, spaced words among them."""
    low = text.lower()
    tokens = set(low.split())
    if sum(len(t) == 1 for t in tokens) > 1:
        tokens.update(GAP.sub(" ", m.group()) for m in SPACED.finditer(low))
    return tokens


class Scorer:
    """Weights of features, and a curve over the two heaviest words of a document."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)):
        self.weights, self.curve, self.sizes = weights, curve, whole_sizes(weights)

    def word(self, token: str, model: LetterModel) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for f in features_of(token, model, self.sizes)), default=0.0)

    def heaviest(self, text: str, model: LetterModel, seen: dict[str, float]) -> tuple[float, float]:
        first = second = 0.0
        for token in tokens_of(text):
            value = seen.get(token)
            if value is None:
                value = self.word(token, model)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[token] = value
            if value > first:
                first, second = value, first
            elif value > second:
                second = value
        return first, second

    def score(self, first: float, second: float) -> float:
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * first + c * second))))


def weight(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Cautious log ratio of the shares of documents with and without the label that hold a feature."""
    ratio = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return max(0.0, ratio - CAUTION * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)))


def _feature_counter(shared):
    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in total], pa.string()), pa.array([int(k[1] == 1) * n for k, n in total.items()], pa.int64()),
             pa.array([int(k[1] != 1) * n for k, n in total.items()], pa.int64())], names=["feature", "pos", "neg"])

    def count(batches):
        model, total = shared.value, Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for t in tokens_of(text or "") for w in readings(t, model)[0] for f in features(w)}
                total.update((f, toxic) for f in found)
                if len(total) > COUNTED:
                    yield rows(total)
                    total = Counter()
        yield rows(total)
    return count


def _heaviest_left_out(shared_model, shared_counts, n_pos: int, n_neg: int):
    """Heaviest words of the labelled documents, each weighed without the document itself."""
    def run(batches):
        model, counts = shared_model.value, shared_counts.value
        sizes = whole_sizes(counts)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = []
                for token in tokens_of(text or ""):
                    best = 0.0
                    for f in features_of(token, model, sizes):
                        if f in counts:
                            pos, neg = counts[f]
                            pos, neg = (pos - 1, neg) if toxic == 1 else (pos, neg - 1)
                            if pos >= LEAST_SEEN - 1:
                                best = max(best, weight(pos, max(neg, 0), n_pos - (toxic == 1), n_neg - (toxic != 1)))
                    values.append(best)
                top = sorted(values, reverse=True)[:2] + [0.0, 0.0]
                rows.append((top[0], top[1], int(toxic == 1)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64() if i < 2 else pa.int64()) for i in range(3)],
                                             names=["first", "second", "toxic"])
    return run


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the penalty leaves the constant free."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, model: LetterModel, max_labelled: int = MAX_LABELLED) -> Scorer:
    """Fit on the rows whose remainder is not 1: at most ``max_labelled`` of them, by a hash of the id.

    A document with several labels counts as toxic if one says so; of rows that repeat an id the smallest text counts.  Labels
    without a document do not count.  Without labels of both kinds every score is low.
    """
    spark = docs.sparkSession
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 1))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # Bounded by ``max_labelled`` rows of two numbers.
    sample = (docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text")).select("text", "toxic"))
    sizes = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").distinct().groupBy("toxic").count().collect()
    n_pos = sum(r["count"] for r in sizes if r.toxic == 1)
    n_neg = sum(r["count"] for r in sizes if r.toxic != 1)
    if not n_pos or not n_neg:
        return Scorer({})
    shared_model = Shared(spark, model)
    counted = (sample.mapInArrow(_feature_counter(shared_model), "feature string, pos long, neg long")
               .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_SEEN))
    ratio = (F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
             - CAUTION * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5)))
    kept = counted.where(ratio > 0).orderBy(ratio.desc(), "feature").limit(MAX_FEATURES).collect()
    counts = {r.feature: (r.pos, r.neg) for r in kept}
    shared_counts = Shared(spark, counts)
    rows = sample.mapInArrow(_heaviest_left_out(shared_model, shared_counts, n_pos, n_neg), "first double, second double, toxic long").collect()
    data = np.array([(r.first, r.second, r.toxic) for r in rows], float).reshape(-1, 3)
    curve = fit_curve(data[:, :2], data[:, 2]) if len(data) else (-3.0, 0.0, 0.0)
    weights = {f: w for f, (pos, neg) in counts.items() if (w := weight(pos, neg, n_pos, n_neg)) > 0}
    return Scorer(weights, curve)


def score_documents(docs: DataFrame, labels: DataFrame, out: str = "score", text: str = "text",
                    max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with the score of each whole text in ``out`` (replaced if it exists); null and empty texts are scored too."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = letter_model(docs, text)
    scorer = train(docs.select("doc_id", F.col(text).alias("text")), labels, model, max_labelled)
    shared = Shared(spark, (model, scorer))

    @F.arrow_udf(returnType="double")
    def score(texts: pa.Array) -> pa.Array:
        letters, judge = shared.value
        scores = pa.array([judge.score(*judge.heaviest(t.as_py() or "", letters, shared.memo)) for t in texts], pa.float64())
        give_back()
        return scores

    return docs.withColumn(out, score.asNondeterministic()(text_of(text)))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row; null texts are empty, extra columns are left out, repeated rows repeat."""
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below ``threshold``; columns as given."""
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return score_documents(whole, labels, out="_score").where(F.col("_score") < threshold).select("_row.*")
