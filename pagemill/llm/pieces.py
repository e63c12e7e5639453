"""SentencePiece encoding and decoding by streaming Viterbi.

Ids are those of a given vocabulary with scores; the best segmentation has the largest sum of
scores.  The search keeps a window of the longest piece's length; whenever all surviving
backpointer paths meet in one boundary, the ids before it are committed and forgotten.  A mark of
a space that follows another character is always such a boundary, as no piece crosses it, so
committed chunks repeat: those of a batch of texts are told apart by a hash, and each distinct one is searched
once, many of one length in a step.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Shared, bound_batches, give_back, list_array, mix64, powers, text_of

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: What a character outside the vocabulary costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Characters between two looks for a common boundary.
COMMIT_EVERY = 64
#: Chunks remembered while texts are encoded one by one; then the table starts anew.
REMEMBERED = 100_000
#: Characters of texts whose chunks are searched together.
TOGETHER = 1 << 19
DEFAULT_MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    prefixes: dict[str, tuple[int, float] | None]  # each prefix of a piece -> the piece, if it is one
    byte_ids: list[int]
    texts: list[bytes]  # what each id stands for
    longest: int
    unknown: float
    chunked: bool       # no piece has a space mark behind another character


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Pieces and scores of a model file; read on the driver, its size is the file's."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, texts = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            texts.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            pieces[name] = (i, model.get_score(i))
            texts.append(name.replace(SPACE, " ").encode())
    return make_vocabulary(pieces, byte_ids, texts)


def make_vocabulary(pieces: dict[str, tuple[int, float]], byte_ids: list[int], texts: list[bytes]) -> Vocabulary:
    prefixes: dict[str, tuple[int, float] | None] = {}
    for name, found in pieces.items():
        for n in range(1, len(name)):
            prefixes.setdefault(name[:n], None)
        prefixes[name] = found
    crossing = re.compile(f"[^{SPACE}]{SPACE}")
    return Vocabulary(pieces, prefixes, byte_ids, texts, max(map(len, pieces), default=1),
                      min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY,
                      not any(crossing.search(p) for p in pieces))


def viterbi(s: str, v: Vocabulary, every: int = COMMIT_EVERY) -> list[int]:
    """Ids of the best segmentation of ``s``; the earlier start wins a tie.

    ``best`` and ``back`` hold the places from the last committed boundary on: (score, start, id).
    Id -1 is a character that is written as its bytes.
    """
    out: list[int] = []
    done, n, prefixes = 0, len(s), v.prefixes
    best: list[float | None] = [0.0]
    back: list[tuple[int, int]] = [(0, 0)]
    for i in range(n):
        here = i - done
        score = best[here]
        if score is None:
            continue
        j, alone = i + 1, False
        while j <= n:
            found = prefixes.get(s[i:j], False)
            if found is False:
                break
            if found is not None:
                alone |= j == i + 1
                _offer(best, back, j - done, score + found[1], i, found[0])
            j += 1
        if not alone:
            _offer(best, back, here + 1, score + v.unknown, i, -1)
        if here >= every and not here % every:
            meet = _common(best, back, i + 1, done, v.longest)
            if meet > done:
                out += _trace(s, back, done, meet, v)
                best, back, done = best[meet - done:], back[meet - done:], meet
    return out + _trace(s, back, done, n, v)


def viterbi_short(s: str, v: Vocabulary) -> list[int]:
    """``viterbi`` for a chunk that fits its window: nothing has to be committed before the end."""
    n, get, unknown = len(s), v.prefixes.get, v.unknown
    best, starts, pieces = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        score, alone = best[i], False
        for j in range(i + 1, n + 1):
            found = get(s[i:j], False)
            if found is False:
                break
            if found is not None:
                if j == i + 1:
                    alone = True
                total = score + found[1]
                if best[j] is None or total > best[j]:
                    best[j], starts[j], pieces[j] = total, i, found[0]
        if not alone and (best[i + 1] is None or score + unknown > best[i + 1]):
            best[i + 1], starts[i + 1], pieces[i + 1] = score + unknown, i, -1
    out: list[int] = []
    while n:
        start = starts[n]
        if pieces[n] >= 0:
            out.append(pieces[n])
        else:
            out += [v.byte_ids[b] for b in reversed(s[start:n].encode("utf-8", "surrogatepass"))]
        n = start
    return out[::-1]


class PrefixTable:
    """The prefixes of all pieces by a 64-bit hash of their code points: two arrays of slots, the second for what collides."""

    SLOTS = 20

    def __init__(self, v: Vocabulary):
        names = list(v.prefixes)
        keys = np.array([self.hash_of(n) for n in names], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two prefixes share a hash")
        values = np.array([-1 if v.prefixes[n] is None else v.prefixes[n][0] for n in names], np.int32)
        self.score = np.zeros(max(len(v.texts), 1), np.float64)
        for i, score in v.pieces.values():
            self.score[i] = score
        self.tables = []
        multiplier = 0x9E3779B97F4A7C15
        while len(keys):
            slot = self.slots(keys, multiplier)
            _, first = np.unique(slot, return_index=True)
            key, value = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, -2, np.int32)
            key[slot[first]], value[slot[first]] = keys[first], values[first]
            self.tables.append((multiplier, key, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
            multiplier = (multiplier * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * 0x5851F42D4C957F2D + ord(c) + 1) % (1 << 64)
        return h

    @staticmethod
    def grow(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return h * np.uint64(0x5851F42D4C957F2D) + codes + np.uint64(1)

    @classmethod
    def slots(cls, h: np.ndarray, multiplier: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * np.uint64(multiplier)) >> np.uint64(64 - cls.SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1 for a prefix that is none, -2 for no prefix."""
        (multiplier, key, value), *others = self.tables
        slot = self.slots(h, multiplier)
        out = np.where(key[slot] == h, value[slot], np.int32(-2))
        for multiplier, key, value in others:
            rest = np.flatnonzero(out == -2)
            if not len(rest):
                break
            slot = self.slots(h[rest], multiplier)
            out[rest] = np.where(key[slot] == h[rest], value[slot], np.int32(-2))
        return out


def viterbi_many(codes: np.ndarray, v: Vocabulary, table: PrefixTable) -> tuple[np.ndarray, np.ndarray]:
    """``viterbi`` for many chunks of one length (rows of code points): ids one chunk after another, and how many each has."""
    m, n = codes.shape
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0.0
    start, piece = np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
    for i in range(n):
        live, h, alone = np.arange(m), np.zeros(m, np.uint64), np.zeros(m, bool)
        for j in range(i + 1, n + 1):
            h = table.grow(h, codes[live, j - 1].astype(np.uint64))
            found = table.find(h)
            whole = found >= 0
            rows, ids = live[whole], found[whole]
            if j == i + 1:
                alone[rows] = True
            total = best[i, rows] + table.score[ids]
            better = total > best[j, rows]
            rows = rows[better]
            best[j, rows], start[j, rows], piece[j, rows] = total[better], i, ids[better]
            alive = found > -2
            live, h = live[alive], h[alive]
            if not len(live):
                break
        total = best[i] + v.unknown
        better = ~alone & (total > best[i + 1])
        best[i + 1, better], start[i + 1, better], piece[i + 1, better] = total[better], i, -1
    # All backpointer paths at once, from the ends.  A character outside the vocabulary is 256 + its code, negated.
    rows, end, steps = np.arange(m), np.full(m, n), []
    while len(rows):
        begin = start[end, rows]
        ids = piece[end, rows]
        steps.append((rows, np.where(ids < 0, -256 - codes[rows, begin].astype(np.int32), ids)))
        rows, end = rows[begin > 0], begin[begin > 0]
    owner, ids = np.concatenate([r for r, _ in steps]), np.concatenate([x for _, x in steps])
    order = np.lexsort((np.repeat(-np.arange(len(steps)), [len(r) for r, _ in steps]), owner))
    owner, ids = owner[order], ids[order]
    unknown = ids < 0
    if unknown.any():
        char = -256 - ids
        n_bytes = np.where(unknown, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
        step = np.arange(int(n_bytes.sum())) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
        owner, ids, char, n_bytes = (np.repeat(x, n_bytes) for x in (owner, ids, char, n_bytes))
        bits = char >> (6 * (n_bytes - 1 - step)) & 0x3F | 0x80
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n_bytes] | char >> (6 * (n_bytes - 1))
        ids = np.where(ids < 0, np.array(v.byte_ids)[np.where(step > 0, bits, lead) & 0xFF], ids)
    return ids.astype(np.int32), np.bincount(owner, minlength=m)


def encode_many(texts: list[str], v: Vocabulary, table: PrefixTable) -> tuple[list[int], np.ndarray]:
    """Ids of a batch of texts, one text after another, and how many each has; each distinct chunk is searched once."""
    plain = [i for i, t in enumerate(texts) if t and SPACE not in t and v.chunked]
    single = {i: np.frombuffer(encode(t, v, {}), "<i4") for i, t in enumerate(texts) if t and (SPACE in t or not v.chunked)}
    sizes, flat = [0] * len(texts), np.zeros(0, np.int32)
    if plain:
        codes = np.frombuffer("".join(SPACE + texts[i].replace(" ", SPACE) for i in plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum([0, *[len(texts[i]) + 1 for i in plain[:-1]]])
        mark = codes == ord(SPACE)
        new = mark.copy()
        new[1:] &= ~mark[:-1]
        new[begin] = True
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(codes)))
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        with np.errstate(over="ignore"):
            names = mix64(np.add.reduceat(mix64(codes.astype(np.uint64)) * powers(int(lengths.max()))[place], starts) + lengths.astype(np.uint64))
        _, first, which = np.unique(names, return_index=True, return_inverse=True)
        size = lengths[first]
        counts, parts, order = np.zeros(len(first), np.int64), [], []
        for n in np.unique(size).tolist():
            group = np.flatnonzero(size == n)
            order.append(group)
            if n > COMMIT_EVERY:
                found = [viterbi("".join(map(chr, codes[starts[first[g]]:starts[first[g]] + n])), v) for g in group]
                parts.append(np.array([x for f in found for x in f], np.int32))
                counts[group] = [len(f) for f in found]
            else:
                ids, counts[group] = viterbi_many(codes[starts[first[group]][:, None] + np.arange(n)], v, table)
                parts.append(ids)
        # Where each distinct chunk's ids lie, then all chunks in the order of the texts.
        group, known = np.concatenate(order), np.concatenate(parts)
        at = np.zeros(len(first), np.int64)
        at[group] = np.cumsum(counts[group]) - counts[group]
        n = counts[which]
        total = np.cumsum(n)
        flat = known[np.repeat(at[which] - total + n, n) + np.arange(int(total[-1]))]
        ends = np.append(total, total[-1])[np.searchsorted(starts, np.append(begin[1:], len(codes))) - 1]
        for i, k in zip(plain, np.diff(np.concatenate([[0], ends])).tolist()):
            sizes[i] = k
    if single:
        pieces, at = [], 0
        for i in range(len(texts)):
            if i in single:
                pieces.append(single[i])
                sizes[i] = len(single[i])
            else:
                pieces.append(flat[at:at + sizes[i]])
                at += sizes[i]
        flat = np.concatenate(pieces)
    return sizes, flat


def _offer(best: list, back: list, at: int, score: float, start: int, piece: int) -> None:
    while len(best) <= at:
        best.append(None)
        back.append((0, 0))
    if best[at] is None or score > best[at]:
        best[at], back[at] = score, (start, piece)


def _common(best: list, back: list, at: int, done: int, longest: int) -> int:
    """The last boundary that every path which can still grow has in common.

    Paths grow from ``at`` on, or have ended there or beyond with a piece begun before ``at``.
    """
    ends = {k for k in range(max(done, at - longest + 1), min(done + len(best), at + longest + 1)) if best[k - done] is not None}
    ends = {k for k in ends if k >= at}
    while len(ends) > 1:
        last = max(ends)
        ends.remove(last)
        if last == done:
            return done
        ends.add(back[last - done][0])
    return min(ends, default=done)


def _trace(s: str, back: list, done: int, end: int, v: Vocabulary) -> list[int]:
    out: list[int] = []
    while end > done:
        start, piece = back[end - done]
        if piece >= 0:
            out.append(piece)
        else:
            out += [v.byte_ids[b] for b in reversed(s[start:end].encode("utf-8", "surrogatepass"))]
        end = start
    return out[::-1]


CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def encode(text: str, v: Vocabulary, seen: dict[str, bytes]) -> bytes:
    """Ids as little-endian int32.  A space mark inside the text is written as its bytes.  '' has no ids."""
    if not text:
        return b""
    parts, mark = [], np.array([v.byte_ids[b] for b in SPACE.encode()], "<i4").tobytes()
    for k, part in enumerate(text.split(SPACE)):
        if k:
            parts.append(mark)
        s = (SPACE if not k else "") + part.replace(" ", SPACE)
        if not s:
            continue
        for chunk in CHUNK.findall(s) if v.chunked else [s]:
            ids = seen.get(chunk)
            if ids is None:
                if len(chunk) > COMMIT_EVERY:
                    ids = np.array(viterbi(chunk, v), "<i4").tobytes()
                else:
                    found = viterbi_short(chunk, v)
                    ids = pack(f"<{len(found)}i", *found)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[chunk] = ids
            parts.append(ids)
    return b"".join(parts)


def decode(ids, v: Vocabulary) -> str:
    """The text; control ids stand for nothing, the space before the first piece goes."""
    data = b"".join(map(v.texts.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _encode_batch(texts: list[str], shared: Shared) -> tuple[list[int], np.ndarray]:
    """Ids of a batch one after another, and how many each text has; about ``TOGETHER`` characters are searched at a time."""
    v, memo = shared.value, shared.memo
    if not memo:
        memo["prefixes"] = PrefixTable(v)
    sizes, parts, rows, size = [], [], [], 0
    for text in [*texts, None]:
        if rows and (text is None or size > TOGETHER):
            n, ids = encode_many(rows, v, memo["prefixes"])
            sizes += n
            parts.append(ids)
            rows, size = [], 0
        if text is not None:
            rows.append(text)
            size += len(text)
    give_back()
    return sizes, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _encoder(shared: Shared):
    @F.arrow_udf(returnType="array<int>")
    def encode_texts(texts: pa.Array) -> pa.Array:
        sizes, ids = _encode_batch(texts.to_pylist(), shared)
        return list_array(sizes, pa.array(ids))
    return encode_texts.asNondeterministic()


def decode_many(ids: np.ndarray, sizes: list[int], v: Vocabulary) -> list[str]:
    """``decode`` for lists of ids that lie one after another."""
    length = np.array([len(t) for t in v.texts], np.int64)
    begin = np.cumsum(length) - length
    letters = np.frombuffer(b"".join(v.texts), np.uint8)
    n = length[ids]
    total = np.cumsum(n)
    data = letters[np.repeat(begin[ids] - total + n, n) + np.arange(int(total[-1]) if len(total) else 0)].tobytes()
    ends = np.append(0, total)[np.cumsum([0, *sizes])].tolist()
    parts = (data[a:b] for a, b in zip(ends, ends[1:]))
    return [(p[1:] if p[:1] == b" " else p).decode("utf-8", "replace") for p in parts]


def _decode_batch(ids: np.ndarray, sizes: list[int], v: Vocabulary):
    """Texts of lists of ids, some at a time."""
    at = 0
    for part in (sizes[a:a + 256] for a in range(0, len(sizes), 256)):
        yield from decode_many(ids[at:at + sum(part)], part, v)
        at += sum(part)


def _decoder(shared: Shared):
    @F.arrow_udf(returnType="string")
    def decode_ids(lists: pa.Array) -> pa.Array:
        sizes = [n or 0 for n in pc.list_value_length(lists).to_pylist()]
        return pa.array(_decode_batch(pc.list_flatten(lists).to_numpy(zero_copy_only=False), sizes, shared.value), pa.string())
    return decode_ids.asNondeterministic()


def _both_ways(shared: Shared):
    """Ids, and what they decode to as a digest, by one worker."""
    @F.arrow_udf(returnType="ids array<int>, decoded_sha256 string, exact boolean")
    def both(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        sizes, ids = _encode_batch(given, shared)
        digests, exact = [], []
        for text, back in zip(given, _decode_batch(ids, sizes, shared.value)):
            digests.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            exact.append(back == text)
        return pa.StructArray.from_arrays([list_array(sizes, pa.array(ids)), pa.array(digests, pa.string()), pa.array(exact, pa.bool_())],
                                          names=["ids", "decoded_sha256", "exact"])
    return both.asNondeterministic()


def share_vocabulary(spark, model: str = DEFAULT_MODEL) -> Shared:
    """The vocabulary as a broadcast; its size is that of the model file."""
    return Shared(spark, load_vocabulary(model))


def encode_documents(docs: DataFrame, text: str = "text", out: str = "ids", model: str = DEFAULT_MODEL,
                     shared=None) -> DataFrame:
    """``docs`` with the ids of each whole text (null: none); an existing column ``out`` is replaced."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, _encoder(shared or share_vocabulary(docs.sparkSession, model))(text_of(text)))


def decode_documents(docs: DataFrame, ids: str = "ids", out: str = "decoded", model: str = DEFAULT_MODEL,
                     shared=None) -> DataFrame:
    """``docs`` with the text that ``ids`` stand for."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, _decoder(shared or share_vocabulary(docs.sparkSession, model))(F.col(ids)))


def encode_and_decode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` with the ids of each whole text, the digest of the text they decode to, and whether it is the text (null: empty).

    Existing columns ``ids``, ``decoded_sha256`` and ``exact`` are replaced.  One worker goes both ways.
    """
    bound_batches(docs.sparkSession)
    result = ["ids", "decoded_sha256", "exact"]
    both = _both_ways(share_vocabulary(docs.sparkSession, model))(text_of())
    whole = docs.select(F.struct("*").alias("_row"), both.alias("_both"))
    return whole.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in result], *[F.col("_both")[c].alias(c) for c in result])


def round_trip(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_ids, ids, the decoded text's digest, and whether it is the text."""
    return encode_and_decode(docs.select("doc_id", "text"), model).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "decoded_sha256", "exact")
