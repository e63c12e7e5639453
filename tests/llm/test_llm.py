"""Each operator against a brute-force version, round trips, and rows of every awkward kind."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, decontaminate, fingerprint, graph, html_text, jaccard, pieces, pii, secrets, sharding, toxicity

DOC = "doc_id bigint, text string, lang string, spans string, score double, ids string, row string, n_hit string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, equal texts, and columns whose names clash."""
    base = prose(1)
    edited = base.split()
    edited[30] = "changed"
    rows = [(1, None), (2, ""), (3, base), (4, base), (4, base), (None, "no id here"), (5, " ".join(edited)), (6, "x" * 50_000),
            (7, prose(2, 4000)), (8, "▁ ▁ tab\tline\n\nİ ſecret"), (9, "one two"), (10, "one two"), (11, prose(3) + " you 1d10t idiot")]
    return spark.createDataFrame([(i, t, None, "s", 0.5, "z", "r", "h") for i, t in rows], DOC)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spans_digest(spans, kinds):
    return sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, kinds.index(k), k, b) for k, a, b in spans)))


def brute_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return ([("assign", *m.span()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
            + [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
            + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24])


def test_secrets():
    rng = random.Random(5)
    parts = ["password", "PassWd", "ſecret", "secret", "api_key", "APIkey", "token", " = ", ":", "=", '"', "'", "abc123", "a", "AKIA", "ABCDEFGH12345678",
             "0123456789abcdef", "deadbeef", " ", "İ", "\n", "xyz-./"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        got = [(secrets.KINDS[k], a, b) for a, k, b in secrets.scan_text(text) if k < 3]
        assert sorted(got) == sorted(brute_secrets(text)), text
    body = "A" * 30
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = secrets.BASE62[d] + check
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan_text(f"x ghp_{body}{check} y")] == ["github"]
    assert secrets.scan_text(f"x ghp_{body}AAAAAA y") == []


def test_chat(spark):
    texts = ["<|im_end|>", "\\", "\\<|", "<\\|", "<|im_start|>user\n\\n", "", None, "plain\nlines", "\\\\|<", "<" * 3 + "|"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "assistant", "odd\nrole<|\\", None, "assistant"]
    rows = [(7, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))] + [(8, 0, "user", "hi"), (8, 1, "assistant", "yes"), (8, 1, "assistant", "yes"), (None, 0, "user", "q")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in chats.withColumn("turns", chat.read_chats(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[7].turns] == [(r or "", t or "") for r, t in zip(roles, texts)]
    assert not got[7].valid and not got[8].valid and got[None].conv_id is None
    digest = {r.conv_id: r for r in chat.digest_chats(chats).collect()}
    loss = "".join(t or "" for r, t in zip(roles, texts) if r == "assistant")
    assert digest[7].loss_sha256 == sha(loss) and digest[7].loss_chars == len(loss) and digest[8].n_turns == 3
    plan = chat.digest_chats(chats)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprint_queries(spark, docs):
    rows = fingerprint.edit_report(docs, blocks=5).collect()
    order = sorted(((d.doc_id, d.text or "") for d in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want[(i, len(text), sha(text[:len(text) - half] + after[:half]))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert len({r.fingerprint for r in rows if r.doc_id in (3, 4)}) == 1
    assert fingerprint.edit_report(docs.limit(0)).count() == 0


def test_fingerprint_is_local():
    text, other = prose(11, 900), prose(12, 900)
    alone, among = fingerprint.fingerprints([text])[0], fingerprint.fingerprints(["", "a", other, text, "aa", text])
    assert all(np.array_equal(alone, x) for x in (among[3], among[5])) and len(among[0]) == 0
    moved = fingerprint.fingerprints(["shifted by this " + text])[0]
    assert fingerprint.likeness(alone, moved) > 0.85 and fingerprint.likeness(alone, fingerprint.fingerprints([other])[0]) < 0.2


def test_fingerprint_counts_the_same_levels_at_every_length():
    for size in (300, 1490, 1499, 5000):
        for seed in range(4):
            text = prose(20 + seed, size)[:size]
            cut, longer = fingerprint.fingerprints([text, text + " some more"])
            assert fingerprint.likeness(cut, longer) > 0.7, (size, seed)


def test_html_blocks():
    page = ("<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; more</h1>"
            "<p><b>first <br> line<p>second<button>x</button> part<!-- c --><script>var a='</p>'</script></p>"
            "<form>f</form><div class=comments>nice</div></article><footer>end</footer>")
    blocks = html_text.page_blocks(page)
    assert [t for t, z in blocks if z == html_text.INSIDE] == ["Head & more", "first line", "second part"]
    assert html_text.page_blocks("") == [] and html_text.page_blocks("cut <p") == [("cut", html_text.OPEN)]


@pytest.mark.parametrize("page", [
    "<article class='overflow-hidden'><p>story</p></article>", "<article><p title='hidden gems' data-hidden='x'>story</p></article>",
    "<html class='cookie-consent'><body class='has-sidebar sidebar'><article>story</article></body></html>",
    "<div class='content-sidebar-wrap'><article>story</article></div>", "<div class='sidebar'><div id=share><main>story</main></div></div>",
    "<article><section id='social'>story</section></article>", "<article><h2 id='comments' class='share'>story</h2></article>",
    "<article><p id='market-share'>story</p></article>"])
def test_html_names_do_not_take_articles(page):
    assert html_text.page_blocks(page) == [("story", html_text.INSIDE)]


@pytest.mark.parametrize("page, text", [
    ("<p title=it's>hello</p>", "hello"), ('<a href="x>link</a>', "link"), ("<p title=it's>a</p><p title=it's>a</p>", "a"),
    ("<p title='a > b'>hello</p>", "hello"), ("a &<b>amp;</b> c", "a &amp; c"), ("<p>a &amp;amp; b&nbsp;&#x2F;</p>", "a &amp; b /"),
    ("<article>x <svg width=1><title>t</title><text>label</text></svg> <math><mi>y</mi></math></article>", "x label y")])
def test_html_broken_markup(page, text):
    assert {t for t, _ in html_text.page_blocks(page)} == {text}


def test_html_short_blocks_go_with_neighbours_only(spark):
    """Whole texts against brute force: a block goes where a stretch of repeated ones around it holds six words."""
    rng = random.Random(11)
    short = ["Summary", "Yes.", "Read on", "About us", "Back to the top"]
    long = ["this host repeats the same long line", "all rights are reserved by this host"]
    pages = {}
    for page in range(30):
        pages[page] = [rng.choice(short) if rng.random() < 0.5 else rng.choice(long) if rng.random() < 0.3 else prose(1000 + page * 20 + k, 12)
                       for k in range(rng.randrange(4, 12))] + [prose(3000 + page, 12)]
    owners = {}
    for page, blocks in pages.items():
        for b in blocks:
            owners.setdefault(b, set()).add(page)
    want = {}
    for page, blocks in pages.items():
        left, again = [], [len(owners[b]) > 1 for b in blocks]
        for k, b in enumerate(blocks):
            i, j = k, k
            while i >= 0 and again[i]:
                i -= 1
            while j < len(blocks) and again[j]:
                j += 1
            if not again[k] or len(b.split()) < 6 and sum(len(x.split()) for x in blocks[i + 1:j]) < 6:
                left.append(b)
        want[page] = "\n".join(left)
    rows = [(p, f"http://h.example/{p}", "".join(f"<p>{b}</p>" for b in blocks)) for p, blocks in pages.items()]
    df = spark.createDataFrame(rows + rows[:2], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got == want and any("Summary" in t for t in got.values())


def test_html_empty_table_and_clashing_names(spark):
    schema = "page_id bigint, url string, html string, blocks string, gone string, page string, host string"
    assert html_text.page_texts(spark.createDataFrame([], schema)).count() == 0
    one = html_text.page_texts(spark.createDataFrame([(1, None, "<article>" + "word " * 60000 + "</article>", "a", "b", "c", "d")], schema)).first()
    assert one.n_chars == 5 * 60000 - 1 and one.n_repeated == 0


def test_html_names_declare():
    for mark in ("hidden", "HIDDEN=''", "aria-hidden=true", "style='display: none'", "class='x ad'", "id=comments", "role=navigation"):
        assert html_text.page_blocks(f"<div {mark}>gone</div><p>stays</p>") == [("gone", html_text.DECLARED), ("stays", html_text.OPEN)], mark
        assert html_text.page_blocks(f"<article><div {mark}>gone</div>stays</article>") == [("gone", html_text.DECLARED), ("stays", html_text.INSIDE)], mark
    wrapped = html_text.page_blocks("<div class=sidebar>list<article>story</article>more</div><div class=sidebar>other</div>")
    assert wrapped == [("list", html_text.OPEN), ("story", html_text.INSIDE), ("more", html_text.OPEN), ("other", html_text.DECLARED)]


def test_html_repeats(spark):
    shared = "this host repeats the same long line on each page"
    rows = [(i, f"http://h.example/{i}", f"<div>{shared}</div><div>only page {prose(i, 9)}</div>") for i in range(4)]
    rows += [(9, None, None), (10, "http://other.example", f"<p>{shared}</p>"), (11, "http://h.example/11", "<article><p>" + shared + "</p></article>")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"only page {prose(i, 9)}" for i in range(4))
    assert got[9] == "" and got[10] == shared and got[11] == shared


def test_html_copies_keep_their_text(spark):
    """Copies of a page keep their text, boilerplate goes, and of a block that is partly repeated the rest stays."""
    line = "this host repeats the same long line on each page"
    story = "".join(f"<div>{prose(70 + i, 20)}</div>" for i in range(3))
    text = "\n".join(prose(70 + i, 20) for i in range(3))
    rows = [(1, "http://h.example/a", f"<div>{line}</div>{story}<div>1 May</div>"), (2, "http://h.example/print/a", f"<div>{line}</div>{story}<div>2 May</div>"),
            (3, "http://h.example/c", f"<div>{line}</div><div>{prose(80, 30)}</div>"), (4, "http://h.example/d", f"<div>{line} {prose(81, 9)}</div>"),
            (5, "http://h.example/e", f"<div>{prose(82, 5)} {line} {prose(83, 2)}</div>")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: text + "\n1 May", 2: text + "\n2 May", 3: prose(80, 30), 4: prose(81, 9), 5: prose(82, 5) + " " + prose(83, 2)}


def test_html_suffix_array(spark):
    """Repeated blocks against brute force; one beginning fills several partitions of the sorted array."""
    rng = random.Random(5)
    hot = "one two three four five six"
    rows = [(f"h{rng.randrange(2)}", page, f"{hot} {rng.randrange(90)}" if rng.random() < 0.4 else
             " ".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 5, 6, 9, 14])))) for page in range(60) for _ in range(5)]

    def grams(text):
        words = text.split()
        return [tuple(words[i:i + 6]) for i in range(max(1, len(words) - 5))]

    owners = {}
    for host, page, text in rows:
        for g in grams(text):
            owners.setdefault((host, g), set()).add(page)
    want = set()
    for host, _, text in rows:
        words, covered = text.split(), set()
        for i, g in enumerate(grams(text)):
            if len(owners[host, g]) > 1:
                covered.update(range(i, i + len(g)))
        if 2 * len(covered) >= len(words):
            want.add((host, text))
    outside = spark.createDataFrame(rows, "host string, page long, text string").withColumn("block", F.xxhash64("host", "text"))
    gone = html_text.repeated_blocks(outside)
    got = [(r.host, r.text) for r in outside.select("host", "text", "block").distinct().join(gone, "block").collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len({(h, t) for h, _, t in rows})

    def cut(n):
        keys = ["a", "a", "b", "c", "c", "c", "d"]
        table = pa.table({"suffix": keys, "low": pa.array([1, 2, 3, 4, 4, 5, 6]), "high": pa.array([1, 2, 3, 4, 4, 5, 6])})
        # As Spark sends them: columns that are never null say so.
        table = table.cast(pa.schema([pa.field(f.name, f.type, f.name != "suffix") for f in table.schema]))
        return [tuple(r.values()) for b in html_text._runs(table.to_batches(max_chunksize=n)) for r in b.to_pylist()]

    for n in (1, 2, 3, 7):
        assert cut(n) == [("a", 1, 2), ("c", 4, 5), ("d", 6, 6)]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([("a", " ".join(prose(7, 4000).split()[:12])), ("b", "ONE two"), ("c", ""), ("d", None),
                                   ("e", " ".join(prose(2, 4000).split()[100:130]))], "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    items = {r.item_id: words(r.text) for r in bench.collect()}
    for limit in (1 << 20, 5):  # one block, and one for each item
        for row in decontaminate.find_contamination(docs, bench, block_bytes=limit).collect():
            w, hit, names = words(row.text), set(), set()
            for name, x in items.items():
                for i in range(max(1, len(x) - 9) if x else 0):
                    gram = x[i:i + 10]
                    for p in range(len(w) - len(gram) + 1):
                        if w[p:p + len(gram)] == gram:
                            hit.update(range(p, p + len(gram)))
                            names.add(name)
            assert (row.n_words, row.n_hit, {m.item_id for m in row.matches}) == (len(w), len(hit), names)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {None, 1, 2, 3, 4, 5, 6, 8, 11}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_pii():
    rng = random.Random(9)
    parts = ["a.b", "@", "x-y.com", ".", "1", "255", "300", "4465758382889437", " ", "-", "+", "(", ")", "+1 (743) 555-3824", "12", "\n", "é", "9"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
        for kind, rule, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
            for m in re.finditer(rule, text):
                digits = re.sub("[^0-9]", "", m.group())
                if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                    want.append((kind, *m.span()))
        assert sorted((pii.KINDS[k], a, b) for a, k, b in pii.base_spans(text)) == sorted(want), text


def test_pii_repeats_get_the_label(spark):
    text = "call +1 (743) 555-3824 now, or 1-743-555-3824 later; order 12 of 2024"
    rows = [(i, text) for i in range(30)] + [(99, "nothing here but 1-743-555-0000"), (100, None)]
    found = {r.doc_id: r.pii for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s.kind, s.base) for s in found[0]][:1] == [("phone", True)]
    assert all(text[s.start:s.end] == "1-743-555-3824" for s in found[0] if not s.base)
    assert found[99] == [] and found[100] == []


def test_pii_variants_are_found(spark):
    """A variant of a known number is found, and so is its 20th copy, also where the shape is common as something else."""
    once = "call +1 (743) 555-3824 now, or 1-743-555-3824 later; order 12 of 2024"
    copies = "call +1 (743) 555-3824 now" + ", or 1-743-555-3824 later" * 20
    rows = [(i, once) for i in range(30)] + [(40, copies), (42, "1-743-555-0000 only")]
    rows += [(50 + i, f"part 1-{200 + i}-555-{1000 + i} in stock") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: [(s.kind, r.text[s.start:s.end]) for s in r.pii if not s.base] for r in pii.find_pii(table).collect()}
    assert found[0] == [("phone", "1-743-555-3824")] and found[40] == [("phone", "1-743-555-3824")] * 20
    assert all(found[i] == [] for i in found if i >= 42)
    masked = {r.doc_id: r.text for r in pii.mask_pii(table).collect()}
    assert masked[0] == "call [PHONE] now, or [PHONE] later; order 12 of 2024" and "555" not in masked[40]


def test_beliefs_match_enumeration():
    rng = np.random.default_rng(3)
    unary, table = np.log(rng.random((3, 5))), np.log(rng.random((5, 5)))
    got = pii.beliefs(unary, [(0, 1, table), (1, 2, table)], [0, 0, 0])
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + table[:, :, None] + table[None, :, :])
    assert np.allclose(got[1], joint.sum((0, 2)) / joint.sum())


def test_toxicity(spark):
    bad = ["idiot", "moron", "scum"]
    rows = [(i, prose(i, 30) + (f" {bad[i % 3]} {prose(i + 1, 5)}" if i % 4 == 0 else "")) for i in range(240)]
    hidden = {1001: "you 1d10t", 1002: "such a m0r0n here", 1003: "pure s c u m today", 1004: "idiiioot", 1005: "a i.d.i.o.t"}
    rows += [(i, f"{prose(i, 12)} {t} {prose(i + 7, 12)}") for i, t in hidden.items()] + [(2000, None), (2001, ""), (2002, prose(5, 5000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in range(240) if got[i].held_out]
    assert all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert all(got[i].predicted for i in hidden), {i: got[i].score for i in hidden}
    assert not any(got[i].predicted for i in (2000, 2001, 2002))
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def letters():
    table = np.zeros(toxicity.SIZE ** 3, np.int64)
    c = np.concatenate([np.zeros(2, np.int64), toxicity.codes_of([prose(s, 200) + " idiot" for s in range(20)]), np.zeros(1, np.int64)])
    np.add.at(table, (c[:-2] * toxicity.SIZE + c[1:-1]) * toxicity.SIZE + c[2:], 1)
    return toxicity.LetterModel(table)


def test_toxicity_has_no_size_switch(letters):
    """A disguised word inside a token is found at every length, in every kind of gap, and nothing is found in clean tokens."""
    judge = toxicity.Scorer({"=idiot": 5.0})
    for k in range(0, 16):
        for hidden in ("idiooot", "1d1ot", "i.d.i.o.t"):
            token = "gammazeta" * k + hidden + "etabeta" * k
            assert judge.heaviest(token, letters, {})[0] == 5.0, (k, hidden)
        assert judge.heaviest("gammazeta" * k + "et4beta" * k, letters, {})[0] == 0.0, k
    for text in ("i  d  i  o  t", "i\td\ti\to\tt", "i\nd\ni\no\nt", "so i d i o t ends", "i_d_i_o_t", "ïdïöt"):
        assert judge.heaviest(text, letters, {})[0] == 5.0, text
    assert judge.heaviest("a b c plain snake_case words", letters, {})[0] == 0.0


def brute_readings(token, model, best):
    """Every path through the lattice, by enumeration."""
    ends = {}

    def walk(at, a, b, cost, word):
        if at == len(token):
            total = cost - float(model.log[a, b, 0])
            if word and total < ends.get(word, 1e9):
                ends[word] = total
            return
        c = token[at]
        plain = model.number.get(c, 0)
        options = [(x, toxicity.LOOK_COST) for x in toxicity.LOOKS.get(c, "")] + ([(c, 0.0)] if plain else [])
        dropped = not plain and (c in toxicity.SEPARATORS or c in toxicity.LOOKS or not c.isalnum())
        if not options and not dropped:
            options.append((c, toxicity.KEEP_SIGN_COST))
        for x, extra in options:
            n = model.number.get(x, 0)
            walk(at + 1, b, n, cost + extra - float(model.log[a, b, n]), word + x)
            if word[-1:] == x:
                walk(at + 1, a, b, cost + toxicity.REPEAT_COST, word)
        if dropped:
            walk(at + 1, a, b, cost + toxicity.DROP_COST, word)

    walk(0, 0, 0, 0.0, "")
    return ends


def test_toxicity_lattice(letters):
    rng = random.Random(9)
    for _ in range(150):
        token = "".join(rng.choice("idot1034@.*aa!-x7ß") for _ in range(rng.randrange(1, 8)))
        every = brute_readings(token, letters, 3)
        got = toxicity.restore(token, letters)
        if got:
            assert abs(every[got[0]] - min(every.values())) < 1e-4, token
        else:
            assert not every


def test_toxicity_long_tokens(spark):
    """Insults drawn out, spaced out or buried in tokens of any length are found wherever they stand."""
    bad = ["idiot", "moron", "scum"]
    rows = [(i, prose(i, 30) + (f" {bad[i % 3]} {prose(i + 1, 5)}" if i % 4 == 0 else "")) for i in range(240)]
    before, after = " ".join("gammazetathetakappadeltalambda"), " ".join("etabetalambdaiotazetagammaalpha")
    hidden = {1001: "idi" + "o" * 70 + "t", 1002: "m" * 200 + "o" * 300 + "ron", 1003: f"{before} i d i o t {after}",
              1004: f"{after} {before} {before} m o r o n", 1005: f"s c u m {after} {before}", 1006: "gammazeta1" * 12 + "idiooot" + "etabeta2" * 14,
              1007: "i" + ".-" * 20 + "d" + ".-" * 20 + "iot", 1008: "k a p p a i d i o t b e t a"}
    clean = {1101: f"{before} {after}", 1102: "a" * 500, 1103: "gammazeta1" * 40, 1104: "x " * 80}
    rows += [(i, f"{prose(i, 12)} {t} {prose(i + 7, 12)}") for i, t in (hidden | clean).items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert all(got[i].predicted for i in hidden), {i: got[i].score for i in hidden}
    assert not any(got[i].predicted for i in clean), {i: got[i].score for i in clean}


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, 7).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    weighted = sharding.assign_shards(spark.range(8000), "id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert 2.7 < {r.shard: r["count"] for r in weighted}[1] / {r.shard: r["count"] for r in weighted}[0] < 3.3
    many = sharding.number_in_shard(spark.range(200_000).select(F.lit(0).alias("shard"), "id", (F.col("id") * 22_517_998_136).alias("p")), ["id"], "p")
    assert [tuple(r) for r in many.where("slot <> id").limit(3).collect()] == []


def test_pieces(spark, docs):
    assert all(r.exact for r in pieces.round_trip(docs).collect())
    v = pieces.load_vocabulary()
    table = pieces.PrefixTable(v)
    texts = ["", " ", "  a  b ", "a▁b", "日本語 text é", "\u0000", "x" * 500, prose(4, 300), "tab\t\nnew"]
    sizes, ids = pieces.encode_many(texts, v, table)
    assert ids.tobytes() == b"".join(pieces.encode(t, v, {}) for t in texts) and pieces.decode_many(ids, sizes, v) == texts
    small = pieces.make_vocabulary({c: (i, -float(s)) for i, (c, s) in enumerate({"a": 3, "b": 3, "ab": 4, "ba": 4, "aba": 5, "bb": 9}.items())}, [0] * 256, [b""] * 6)
    rng = random.Random(2)
    for _ in range(60):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 200)))
        assert pieces.viterbi(s, small, every=3) == pieces.viterbi_short(s, small)


def brute_components(rows, n, threshold):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return Counter((d, len(s), low.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("n,threshold,block", [(3, 90, 256), (5, 80, 4)])
def test_jaccard(spark, docs, n, threshold, block):
    rng, rows = random.Random(n), [(r.doc_id, r.text) for r in docs.collect()]
    for family in range(6):
        base = prose(100 + family, rng.choice([8, 25, 120, 400])).split()
        for k in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 40 * 2)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
            rows.append((1000 + family * 50 + k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table, n, threshold, block).collect())
    assert got == brute_components(rows, n, threshold)
    kept = jaccard.one_of_each(table, n, threshold)
    want = {c for _, _, c in got if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_jaccard_common_passage(spark, monkeypatch):
    """A passage that all texts hold does not make one cluster of them, whose blocks would all meet."""
    passage, rng, rows = prose(7, 30), random.Random(7), []
    for k in range(400):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(60, 140))]
        rows += [(2 * k, f"{passage} {' '.join(words)}"), (2 * k + 1, f"{passage} {' '.join(words[:-1])}")]
    sizes, real = [], jaccard.stage

    def stage(df, name):
        out = real(df, name)
        if name == "wanted":
            sizes.extend(r["count"] for r in out.groupBy("cluster").count().collect())
        return out

    monkeypatch.setattr(jaccard, "stage", stage)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table, 5, 80).collect())
    assert got == brute_components(rows, 5, 80)
    assert len(sizes) > 350 and max(sizes) <= 8


def test_jaccard_rounds(spark, monkeypatch):
    """Blocks of a large cluster meet in rounds: no shuffle holds more than a fixed number of copies of its texts."""
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(words[:k] + [f"v{k}"] + words[k + 1:])) for k in range(40)]
    monkeypatch.setattr(jaccard, "COPIES", 3)
    names, real = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: names.append(name) or real(df, name))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table, 3, 80, 4).collect())
    assert got == brute_components(rows, 3, 80)
    assert names.count("links") == 4  # ten blocks


def test_jaccard_empty(spark, docs):
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    assert {r.node: r.component for r in graph.components(chain).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert graph.components(chain.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (5, 4), (4, 5), (5, 4)], "x bigint, y bigint")
    assert {r.node: r.component for r in graph.components(odd).collect()} == {4: 4, 5: 4}


def test_components_of_random_graphs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
        root = list(range(60))
        for _ in root:
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        ends = {x for p in pairs if p[0] != p[1] for x in p}
        got = graph.components(spark.createDataFrame(pairs, "x bigint, y bigint")).collect()
        assert {r.node: r.component for r in got} == {x: root[x] for x in ends}
        assert len(got) == len(ends)



def test_pipeline(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) < docs.count() and len({r.doc_id for r in out}) == len(out)
    assert all(pii.base_spans(r.text) == [] for r in out)
    v = pieces.load_vocabulary()
    assert all(pieces.decode(r.ids, v) == r.text for r in out)


def test_pipeline_decodes(spark, docs):
    import corpus_pipeline
    out = corpus_pipeline.pieces_stage(spark, docs, "").collect()
    assert len(out) == docs.count() and all(r.exact and r.decoded_sha256 == sha(r.text or "") for r in out)
