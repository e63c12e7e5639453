"""Personal data: expressions for the base kinds, then a skip-chain conditional random field.

Nodes are the tokens of a document that hold a digit or an ``@``.  A token's potential comes from
its shape; neighbours in the chain share a potential, and so do distant tokens that are equal or
similar (skip edges).  Loopy belief propagation makes the labels of a document agree: a token
that the expressions miss is labelled when it repeats, in another form, one that they found.
Tokens inside base spans are observed.  The potentials are counted over all documents; a token that repeats
an observed one counts with that one's label, as the expressions' silence does not say that it is something else.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Shared, bound_batches, give_back, list_array, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# Formats of the base kinds.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"[0-9@]\S*")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Belief a token needs to become a span.
CONFIDENT = 0.9
#: Messages have settled when none changes by more.
SETTLED = 1e-4
#: Rounds of message passing at most; evidence takes one, as each token is linked to an observed one of its key.
ROUNDS = 200
#: Rounds after which a message moves half the way, so that none swings for ever.
DAMPED = 50
#: Digits (or characters around an ``@``) that similar tokens share at least.
SIMILAR = 7
OUTER = ".,;:!?\"'()[]{}<>|*#$%&="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards, so long runs of letters cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each base span, in that order; code points, end exclusive."""
    out = [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    out.sort()
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or ``@``, without outer punctuation."""
    out = []
    for m in NODE.finditer(text):
        start, end = m.start(), m.end()
        if out and start < out[-1][1]:
            continue
        while start and not text[start - 1].isspace():
            start -= 1
        while end > start and text[end - 1] in OUTER:
            end -= 1
        while start < end and text[start] in OUTER:
            start += 1
        if end > start and (not out or start >= out[-1][1]):
            out.append((start, end))
    return out


#: Shapes: one number for each token, from bounded features.
N_SHAPES = 6 * 4 * 2 * 2 * 2 * 2 * 2


def shape(token: str) -> int:
    digits = len(_digits(token))
    letters = sum(c.isalpha() for c in token)
    size = 0 if digits < 3 else 1 if digits < 7 else 2 if digits < 9 else 3 if digits < 12 else 4 if digits < 17 else 5
    dots = min(3, token.count("."))
    out = size
    for value, n in ((dots, 4), ("@" in token, 2), (letters > 0, 2), ("-" in token, 2), (token[:1] == "+", 2), (letters > digits, 2)):
        out = out * n + int(value)
    return out


def similar_key(token: str) -> str:
    """Tokens with one key are linked: the last digits, or the letters and digits around an ``@``."""
    digits = _digits(token)
    if len(digits) >= SIMILAR:
        return digits[-SIMILAR:]
    plain = "".join(c for c in token.lower() if c.isalnum())
    return plain if "@" in token and len(plain) >= SIMILAR else ""


def observed(spans: list[tuple[int, int, int]], places: list[tuple[int, int]]) -> list[int]:
    """Label of each node: that of the base span it overlaps, or 0."""
    out, k = [], 0
    for start, end in places:
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        out.append(spans[k][1] + 1 if k < len(spans) and spans[k][0] < end else 0)
    return out


def partners(keys: list[str], labels: list[int]) -> list[int]:
    """For each unlabelled token the nearest observed one of its key, the one before if two are as near; else -1."""
    out = [-1] * len(keys)
    for order in (range(len(keys)), range(len(keys) - 1, -1, -1)):
        last: dict[str, int] = {}
        for i in order:
            if labels[i]:
                last[keys[i]] = i
            elif keys[i] and (at := last.get(keys[i], -1)) >= 0 and (out[i] < 0 or abs(at - i) < abs(out[i] - i)):
                out[i] = at
    return out


def skip_edges(keys: list[str], partner: list[int]) -> list[tuple[int, int]]:
    """Each token with the previous one of its key and with its partner: all tokens of a key are connected, without all
    pairs, and what was observed reaches every copy at once."""
    last, out = {}, []
    for i, key in enumerate(keys):
        if key:
            if key in last:
                out.append((last[key], i))
            if partner[i] >= 0 and partner[i] != last.get(key):
                out.append((partner[i], i))
            last[key] = i
    return out


class Potentials:
    """Log potentials: unary[shape, label], chain[label, label], skip[label, label]."""

    def __init__(self, counts: dict[tuple[str, int], int], strength: float = 1.0):
        unary = np.full((N_SHAPES, len(LABELS)), strength)
        chain = np.full((len(LABELS),) * 2, strength)
        skip = np.full((len(LABELS),) * 2, strength)
        for (what, at), n in counts.items():
            {"u": unary, "c": chain, "s": skip}[what].flat[at] += n
        prior = unary.sum(0) / unary.sum()
        self.unary = np.log(unary / unary.sum(1, keepdims=True))
        both = lambda x: np.log(((x + x.T) / (x + x.T).sum()) / np.outer(prior, prior))
        # What a pair tells beyond its labels' frequencies, bounded so that one pair never decides alone.
        self.chain = np.clip(both(chain), -1.0, 1.0)
        self.skip = np.clip(both(skip), -6.0, 6.0)


def beliefs(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], fixed: list[int], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product; observed nodes (label > 0) stay as they are."""
    n = len(unary)
    own = unary.copy()
    for i, label in enumerate(fixed):
        if label:
            own[i] = -30.0
            own[i, label] = 0.0
    if edges:
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        table = np.stack([e[2] for e in edges])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), unary.shape[1]))
        for done in range(rounds):
            total = own.copy()
            np.add.at(total, target, message)
            rest = total[source] - message[back]
            new = np.logaddexp.reduce(rest[:, :, None] + table, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = new if done < DAMPED else (new + message) / 2
            if moved <= SETTLED:
                break
        np.add.at(own, target, message)
    own -= own.max(1, keepdims=True)
    out = np.exp(own)
    return out / out.sum(1, keepdims=True) if n else out


def scan_text(text: str, potentials: Potentials | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all spans."""
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    if base and potentials:
        places = nodes(text)
        labels = observed(base, places)
        tokens = [text[s:e] for s, e in places]
        keys = [similar_key(t) for t in tokens]
        partner = partners(keys, labels)
        edges = skip_edges(keys, partner)
        if max(partner, default=-1) >= 0:
            graph = [(i, i + 1, potentials.chain) for i in range(len(places) - 1)]
            graph += [(i, j, potentials.skip) for i, j in edges]
            belief = beliefs(potentials.unary[[shape(t) for t in tokens]], graph, labels)
            for (start, end), p, at in zip(places, belief, partner):
                best = int(p.argmax())
                if at >= 0 and best and p[best] >= CONFIDENT:
                    out.append((start, best - 1, end, False))
    return sorted(out)


COUNTS = "what string, at int, n long"


def _count(batches):
    counts: Counter = Counter()
    width = len(LABELS)
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            places = nodes(text)
            if not places:
                continue
            labels = observed(base_spans(text), places)
            tokens = [text[s:e] for s, e in places]
            keys = [similar_key(t) for t in tokens]
            partner = partners(keys, labels)
            labels = [labels[at] if at >= 0 else label for label, at in zip(labels, partner)]
            counts.update(("u", shape(t) * width + label) for t, label in zip(tokens, labels))
            counts.update(("c", a * width + b) for a, b in zip(labels, labels[1:]))
            counts.update(("s", labels[i] * width + labels[j]) for i, j in skip_edges(keys, partner))
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
         pa.array(list(counts.values()), pa.int64())], names=["what", "at", "n"])


def learn_potentials(docs: DataFrame, text: str = "text") -> Potentials:
    """Count labels by shape and by pair over all documents; the table is bounded by shapes and labels."""
    bound_batches(docs.sparkSession)
    counted = docs.select(text_of(text).alias("text")).mapInArrow(_count, COUNTS).groupBy("what", "at").agg(F.sum("n").alias("n"))
    return Potentials({(r.what, r.at): r.n for r in counted.collect()})


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii", potentials: Potentials | None = None) -> DataFrame:
    """``docs`` with all spans in ``out`` (replaced if it exists); potentials are learnt from ``docs`` if not given.

    Null and empty texts have no spans.  One pass counts, one finds; texts are never shuffled.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = Shared(spark, potentials or learn_potentials(docs, text))

    @F.arrow_udf(returnType=SPANS)
    def spans_of(texts: pa.Array) -> pa.Array:
        sizes, rows = [], []
        for value in texts:
            found = scan_text(value.as_py() or "", shared.value)
            sizes.append(len(found))
            rows += found
        struct = pa.StructArray.from_arrays(
            [pa.array([KINDS[r[1]] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.bool_())],
            names=["kind", "start", "end", "base"])
        give_back()
        return list_array(sizes, struct)

    return docs.withColumn(out, spans_of.asNondeterministic()(text_of(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    return find_pii(docs.select("doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))


def mask_spans(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap are covered as one, under the first kind."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))
    body = F.aggregate(spans, start, lambda acc, s: F.when(
        s["start"] >= acc["done"],
        F.struct(F.concat(acc["out"], F.substring(text, acc["done"] + 1, s["start"] - acc["done"]),
                          F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("done")))
        .otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["done"], s["end"]).alias("done"))))
    return F.concat(body["out"], F.substring(text, body["done"] + 1, F.char_length(text)))


def mask_pii(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked in ``text`` and ``n_chars`` set anew; null texts stay null."""
    found = find_pii(docs.select(F.struct("*").alias("_row"), "text"), out="_pii")
    text = mask_spans(F.col("text"), F.col("_pii"))
    masked = {"text": text, "n_chars": F.char_length(text)}
    clean = F.size("_pii") == 0
    return found.select(*[
        F.when(clean, F.col("_row")[f.name]).otherwise(masked[f.name]).cast(f.dataType).alias(f.name) if f.name in masked
        else F.col("_row")[f.name].alias(f.name) for f in docs.schema.fields])
