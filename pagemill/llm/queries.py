"""The operators over the given tables, and SQL where SQL can express them."""

from __future__ import annotations

from pagemill.llm import chat, decontaminate, fingerprint, html_text, jaccard, merkle, pieces, pii, repeats, runs, secrets, sharding, toxicity
from pagemill.llm.common import table


def op1_secrets(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest_chats(chat.format_chats(turns.unionByName(chat.control_example(spark))))


def op3_fingerprint(spark, sf_dir):
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op4_html(spark, sf_dir):
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_pieces(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op10_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_runs(spark, sf_dir):
    return runs.run_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_chat, op3_fingerprint, op4_html, op5_decontaminate, op6_pii,
                                   op7_toxicity, op8_sharding, op9_pieces, op10_jaccard, op11_repeats, op12_merkle, op13_runs)}

ORACLE = {
    "op2_chat": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
    SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe,
        replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS safe_role,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
        sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe) + length('<|im_end|>') + 1) AS formatted_chars,
        bool_and(CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
            WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role = 'assistant'
            ELSE false END) AND max_by(role, k) = 'assistant' AS valid
    FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars, valid FROM g""",
    "op5_decontaminate": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
    SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
    FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM words, sizes WHERE len(w) >= n),
hits AS (
    SELECT doc_id, p, places.n AS n, item_id FROM places JOIN grams ON places.n = grams.n AND array_to_string(w[p:p + places.n - 1], ' ') = g),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id),
starts AS (SELECT DISTINCT doc_id, p - i AS diagonal, p, n, item_id FROM (
    SELECT h.doc_id, h.p, h.n, h.item_id, k.i FROM hits h JOIN (
        SELECT item_id, n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM items JOIN (SELECT DISTINCT item_id, n FROM grams) USING (item_id)) k
    ON h.item_id = k.item_id AND h.n = k.n JOIN words d ON d.doc_id = h.doc_id
    WHERE array_to_string(d.w[h.p:h.p + h.n - 1], ' ') = array_to_string(k.w[k.i:k.i + h.n - 1], ' '))),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run FROM starts),
long AS (SELECT doc_id, max(m) AS longest_match FROM (SELECT doc_id, max(p) - min(p) + max(n) AS m FROM runs GROUP BY doc_id, item_id, diagonal, run) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_match, 0) AS INTEGER) AS longest_match
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN long USING (doc_id)""",
    "op11_repeats": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (
    SELECT doc_id, list(DISTINCT q) AS places
    FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM windows JOIN firsts USING (g) WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)""",
    "op12_merkle": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS c, CAST(n_chars + 1 AS VARCHAR) AS more, source, text FROM documents),
e AS (
    SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, i, 1)) AS BIGINT))),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) AS crc
    FROM d),
leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(c) || ':' || c, '-') || tail) AS leaf,
        CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen(more) || ':' || more, '-') || tail) END AS shown FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaves),
level AS (
    SELECT lang, 0 AS k, list(leaf ORDER BY r) AS l FROM placed GROUP BY lang
    UNION ALL
    SELECT lang, k + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM level WHERE len(l) > 1),
subs AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM level WHERE len(l) = 1),
top AS (
    SELECT 0 AS k, list(subroot ORDER BY r) AS l FROM subs
    UNION ALL
    SELECT k + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM top WHERE len(l) > 1),
above AS (
    SELECT lang, subroot, coalesce(list((CASE WHEN (r >> k) & 1 = 1 THEN 'L' ELSE 'R' END) || coalesce(l[xor(r >> k, 1) + 1], '') ORDER BY k)
        FILTER (WHERE len(l) > 1), []) AS path FROM subs, top GROUP BY lang, subroot),
own AS (
    SELECT p.doc_id, p.lang, p.leaf, p.shown, p.r, coalesce(list((CASE WHEN (p.r >> k) & 1 = 1 THEN 'L' ELSE 'R' END) || coalesce(l[xor(p.r >> k, 1) + 1], '')
        ORDER BY k) FILTER (WHERE len(l) > 1), []) AS path
    FROM placed p JOIN level v ON v.lang IS NOT DISTINCT FROM p.lang GROUP BY ALL),
whole AS (
    SELECT o.doc_id, o.leaf, o.shown, a.subroot, o.path || a.path AS path, (SELECT l[1] FROM top WHERE len(l) = 1) AS root
    FROM own o JOIN above a ON a.lang IS NOT DISTINCT FROM o.lang),
folded AS (
    SELECT *, list_reduce(list_prepend(coalesce(shown, leaf), path), lambda x, s: sha256(
        CASE WHEN s[1] = 'L' THEN substr(s, 2) || x ELSE x || substr(s, 2) END)) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) AS proof_sha256, folded_root,
    folded_root = root AS verified FROM folded""",
}
