"""Secret scan: keyword prefilter, regular expressions anchored at the hits, checksum validation.

One Aho-Corasick pass over the text (letters in lower case) finds every keyword.  An expression
runs only at a hit.  Kinds with an embedded checksum are kept only if it is right.  Runs of hex
digits have no keyword; they are found by their own expression.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import bound_batches, list_array, text_of, worker_cache

#: In the order in which spans of one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE = KINDS[:3]
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))

# Formats of the secrets.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
GITHUB = r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
NPM = r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
XPRV = r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def crc_matches(body: str, check: str) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of the part before."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_matches(text: str) -> bool:
    """Whether the last four bytes are the double SHA-256 of the rest."""
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    data = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:] if data else False


#: kind -> (expression, flags, test of a match).
RULES = {
    "assign": (ASSIGN, re.IGNORECASE | re.ASCII, lambda m: len(m.group(2)) >= 6),
    "access": (ACCESS, re.ASCII, lambda m: m.end() - m.start() >= 20),
    "github": (GITHUB, re.ASCII, lambda m: crc_matches(m.group(1), m.group(2))),
    "npm": (NPM, re.ASCII, lambda m: crc_matches(m.group(1), m.group(2))),
    "xprv": (XPRV, re.ASCII, lambda m: base58_matches(m.group())),
}


def scanner():
    """The automaton and compiled expressions, built once a worker."""
    cache = worker_cache("secrets")
    if not cache:
        automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                automaton.add_word(word, (kind, len(word)))
        automaton.make_automaton()
        cache["automaton"] = automaton
        cache["rules"] = {k: (re.compile(p, f), ok) for k, (p, f, ok) in RULES.items()}
        cache["hex"] = re.compile(HEX, re.ASCII)
    return cache["automaton"], cache["rules"], cache["hex"]


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret, in that order; code points, end exclusive.

    A match that fails its test uses up its characters, as a failing match of a search would.
    """
    automaton, rules, hex_run = scanner()
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only
    found, free = [], dict.fromkeys(rules, 0)
    hits = [(end - size + 1, kind) for end, (kind, size) in automaton.iter(low)]
    for start, kind in sorted(hits):
        if start < free[kind]:
            continue
        pattern, ok = rules[kind]
        match = pattern.match(text, start)
        if match:
            free[kind] = match.end()
            if ok(match):
                found.append((start, KINDS.index(kind), match.end()))
    found += [(m.start(), 2, m.end()) for m in hex_run.finditer(text)]
    found.sort()
    return found


@F.arrow_udf(returnType=SPANS)
def secret_spans(texts: pa.Array) -> pa.Array:
    sizes, rows = [], []
    for text in texts:
        spans = scan_text(text.as_py() or "")
        sizes.append(len(spans))
        rows += spans
    kinds = pa.array([KINDS[k] for _, k, _ in rows], pa.string())
    start, end = (np.array([r[i] for r in rows], np.int32) for i in (0, 2))
    return list_array(sizes, pa.StructArray.from_arrays([kinds, pa.array(start), pa.array(end)],
                                                        names=["kind", "start", "end"]))


secret_spans = secret_spans.asNondeterministic()


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the spans of all secrets in ``out`` (an existing column of that name is replaced).

    Null and empty texts have none.  Each row is scanned whole in the task that reads it; no shuffle.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, secret_spans(text_of(text)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans, by document."""
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"))
