"""The best sum of scores against every way to cut a text into pieces."""

import random

import duckdb

from pagemill.llm import pieces


def ways(s, v):
    """(score, ids) of all segmentations; a character that is no piece is written as its bytes."""
    if not s:
        yield 0.0, []
        return
    for n in range(1, min(len(s), v.longest) + 1):
        if s[:n] in v.pieces:
            piece, cost = v.pieces[s[:n]]
            first = cost, [piece]
        elif n == 1:
            first = v.unknown, [v.byte_ids[b] for b in s[0].encode()]
        else:
            continue
        for score, ids in ways(s[n:], v):
            yield first[0] + score, first[1] + ids


def test_ids_have_the_best_sum_of_all_segmentations():
    rng, v = random.Random(4), pieces.load_vocabulary()
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) > 40").fetchall()]
    parts = ["", " ", "two  spaces", "naïve café", "日本語 text", "a\nb\tc", "🙂🙂 ok", "ÿĀ ɐ"]
    for text in rng.sample(texts, min(len(texts), 60)):
        at = rng.randrange(len(text) - 14)
        parts.append(text[at:at + 13])
    for part in parts:
        marked = part.replace(" ", pieces.SPACE)
        best = max(score for score, _ in ways(marked, v))
        right = [ids for score, ids in ways(marked, v) if score == best]
        assert pieces.viterbi(marked, v) in right, part
        assert pieces.viterbi(marked, v, every=1) in right and pieces.viterbi_short(marked, v) in right, part
