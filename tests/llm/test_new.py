"""Substring dedup, Merkle manifest and periodic runs against brute force; awkward rows of every kind."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import merkle, repeats, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def words_of(text):
    return WORD.findall(text or "")


# --- substring dedup ---------------------------------------------------------

def brute_removed(rows, size):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[p:p + size])
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[p:p + size])] < i:
                gone.update(range(p, p + size))
        out[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def brute_levels(rows, size):
    out = {}
    while True:
        holders = defaultdict(set)
        for i, t in rows:
            w = words_of(t)
            for p in range(len(w) - size + 1 if i is not None else 0):
                holders[tuple(w[p:p + size])].add(i)
        found = Counter(i for ids in holders.values() if len(ids) > 1 for i in ids)
        if not found:
            return out
        out.update({(i, size): n for i, n in found.items()})
        size *= 2


def awkward_texts(seed, n=60):
    """Null and repeated ids, null and empty texts, odd white space, passages that many rows share."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(pool), " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzé\x85\xa0") for _ in range(rng.randrange(25))), "\t\x0b"])
                 for _ in range(rng.randrange(5))]
        rows.append((rng.choice([None, *range(40)]), rng.choice([None, *["  ".join(parts)] * 5])))
    return rows + rows[:3] + [(50, "x" * 100_000), (51, "a " * 5000), (52, "a " * 5000)]


CLASH = "doc_id bigint, text string, hashes string, key int, n_words int, known string, kept_sha256 string"


@pytest.mark.parametrize("size, least", [(3, 1), (7, 1000), (10, 2)])
def test_repeats(spark, size, least):
    rows = awkward_texts(size)
    df = spark.createDataFrame([(i, t, "h", 1, 2, "k", "s") for i, t in rows], CLASH)
    got = Counter(tuple(r) for r in repeats.remove_repeats(df, size, sample=1, hot_least=least).collect())
    assert got == brute_removed(rows, size)
    levels = {(r.doc_id, r.length): r.windows for r in repeats.repeat_levels(df, size, 1, least).collect()}
    assert levels == brute_levels(rows, size) and max(n for _, n in levels) > size


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], CLASH)
    assert repeats.remove_repeats(empty).count() == 0 and repeats.repeat_levels(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c", "h", 1, 2, "k", "s")], CLASH)
    assert [tuple(r) for r in repeats.remove_repeats(one).collect()] == [(1, 3, 0, sha("a b c"))]


# --- Merkle manifest ---------------------------------------------------------

def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return sha(*[field(v) for v in (doc_id, source, lang, None if n_chars is None else n_chars + more, text)])


def brute_tree(leaves):
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            paths[k].append("" if other >= len(nodes) else ("R" if p % 2 == 0 else "L") + nodes[other])
            at[k] = p // 2
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in groups}
    root, above = brute_tree([trees[g][0] for g in groups])
    out = Counter()
    for g, upper in zip(groups, above):
        for (_, _, leaf, row), path in zip(sorted(by[g], key=lambda x: x[:3]), trees[g][1]):
            path = path + upper
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            digest = leaf_of(row, 1) if tampered else leaf
            for step in path:
                digest = sha(step[1:], digest) if step[:1] == "L" else sha(digest, step[1:])
            out[row[0], leaf, trees[g][0], root, sha(*[s[1:] for s in path]), digest, digest == root] += 1
    return out


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, root int, tree string, idx string, n string"


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "l", 1, "t", "i", "n") for r in rows], DOCS)


@pytest.mark.parametrize("digits, n", [(1, 23), (2, 90), (10, 40)])
def test_manifest(spark, digits, n):
    rng = random.Random(digits)
    rows = [(rng.choice([None, *range(n)]), rng.choice(["s", None]), rng.choice([None, "", "de", "z", "é"]), rng.choice([None, 3, 99]),
             rng.choice([None, "", "tëxt", str(i), "y" * 70_000 if i < 2 else ""])) for i in range(n)]
    rows += rows[:4] + rows[:1] * 5
    got = Counter(tuple(r) for r in merkle.manifest_report(doc_frame(spark, rows), digits).collect())
    assert got == brute_manifest(rows)
    assert {verified for *_, verified in got} == {True, False}


def test_manifest_of_little(spark):
    assert merkle.manifest_report(doc_frame(spark, [])).count() == 0
    one = [(8, None, None, None, None)]
    assert Counter(tuple(r) for r in merkle.manifest_report(doc_frame(spark, one)).collect()) == brute_manifest(one)


def test_manifest_proves_some_pages(spark):
    rows = [(i, "s", "de", 1, str(i)) for i in range(20)]
    built = merkle.manifest(merkle.document_leaves(doc_frame(spark, rows)), "lang", ["doc_id"], 2)
    wanted = spark.createDataFrame([("de", 3), ("xx", 0)], "tree string, seg bigint")
    schema = "doc_id bigint, path array<string>"
    from pyspark.sql import types as T
    got = merkle.prove(built, T._parse_datatype_string(schema), lambda row, leaf, path, subroot: (row["doc_id"], path), wanted).collect()
    assert sorted(r.doc_id for r in got) == [12, 13, 14, 15]
    for r in got:
        assert merkle.fold(leaf_of(rows[r.doc_id]), r.path) == built.root
    built.drop()


# --- periodic runs -----------------------------------------------------------

def brute_runs(t):
    found = {}
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, l, q) for (s, l), q in found.items())


def periodic(rng, n, letters):
    t = [rng.randrange(letters) for _ in range(n)]
    if n > 10 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 3 + 1)
        t = t[:a] + [t[a + (i - a) % p] for i in range(a, n)]
    return t


def test_runs():
    rng = random.Random(1)
    for _ in range(150):
        texts = [periodic(rng, rng.choice([0, 1, 5, 6, 7, 20, 100, 300, 700]), rng.choice([1, 2, 3, 10])) for _ in range(rng.randrange(1, 6))]
        got = runs.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(t) for t in texts]


def test_extensions():
    rng = random.Random(2)
    words = np.array(periodic(rng, 900, 2) + periodic(rng, 600, 1) + [99], np.int64)
    pairs = sorted(rng.sample(range(len(words)), 2) for _ in range(3000))
    a, b = np.array(pairs).T
    got = runs.Extensions(words).common(a, b)
    for x, y, n in zip(a, b, got):
        want = 0
        while y + want < len(words) and words[x + want] == words[y + want]:
            want += 1
        assert n == want


def brute_report(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4),
            sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_report(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in periodic(rng, rng.randrange(200), 4))) for i in range(120)]
    rows += [(None, "a " * 30), (None, None), (200, ""), (201, " \x0b\t"), (202, None), (203, "x" * 100_000), (204, "la\x85la " * 900), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id bigint, text string, runs string, start int")
    assert Counter(tuple(r) for r in runs.run_report(df).collect()) == Counter(brute_report(i, t) for i, t in rows)
    listed = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.find_runs(df).where("doc_id >= 200").collect()}
    assert listed == {200: [], 201: [], 202: [], 203: [], 204: [(0, 900, 1)]}
    assert runs.run_report(df.limit(0)).count() == 0
