"""What each query must return, as SQL over the same tables.

The SQL never looks at markup: it restates from the keys what was rendered.
"""

from __future__ import annotations

# Stated here and not taken from the package, so that a wrong rule row shows.
_MARKET_LIST = "['AU','CA','DE','ES','FR','GB','IT','MX','NL','US']"
_SUFFIX = """WHEN 'AU' THEN '.com.au' WHEN 'CA' THEN '.ca' WHEN 'DE' THEN '.es' WHEN 'ES' THEN '.es' WHEN 'FR' THEN '.fr'
    WHEN 'GB' THEN '.co.uk' WHEN 'IT' THEN '.it' WHEN 'MX' THEN '.com.mx' WHEN 'NL' THEN '.nl' WHEN 'US' THEN '.com'"""


def _market(key: str) -> str:
    return f"{_MARKET_LIST}[CAST({key} % 10 AS INTEGER) + 1]"


def _base_url(market: str) -> str:
    return f"('https://www.marketplace' || CASE {market} {_SUFFIX} END)"


# All listings; ``live`` pages have a body, ``ok`` ones pass every check.
LISTINGS = f"""
l0 AS (SELECT p_partkey AS k, {_market('p_partkey')} AS market, lower(p_type) AS search_term,
              CAST(p_partkey // 240 + 1 AS INTEGER) AS page_num, CAST(p_partkey % 240 AS INTEGER) AS pos,
              p_name, p_brand AS b, p_type AS kind, CAST(p_size AS VARCHAR) AS size, s_name AS seller,
              CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
              make_timestamp((1700000000 + p_partkey) * 1000000) AS captured_at
       FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)),
l1 AS (SELECT *, {_base_url('market')} || '/itm/' || k AS url,
              k % 53 <> 0 AS live, k % 53 <> 0 AND k % 47 <> 0 AS money,
              k % 53 <> 0 AND k % 59 <> 0 AND k % 47 <> 0 AS ok,
              k % 53 <> 0 AND (k % 13 <> 0 OR k % 11 = 0) AS has_ship,
              k % 53 <> 0 AND k % 13 <> 0 AND k % 11 <> 0 AS has_box,
              (k // 10) % 2 = 0 AS strong, seller || ' Town' AS town,
              CASE WHEN market = 'FR' THEN CASE WHEN k % 20 < 10 THEN 'Lieu où se trouve l''objet : ' ELSE '' END
                   WHEN market = 'IT' THEN CASE WHEN k % 3 <> 0 THEN 'Oggetto che si trova a:' ELSE '' END
                   WHEN market IN ('DE','ES','MX') THEN
                        CASE k % 3 WHEN 0 THEN 'Located in:' WHEN 1 THEN 'Ubicado en: ' ELSE '' END
                   ELSE CASE WHEN k % 3 <> 0 THEN 'Located in: ' ELSE '' END END AS loc_prefix,
              'US $' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS price
       FROM l0),
l2 AS (SELECT *,
   CASE WHEN k % 41 <> 0 THEN p_name || ' No.' || k || ' & more' END AS title,
   CASE WHEN k % 3 <> 0 THEN kind || ' edition' END AS subtitle,
   CASE WHEN k % 43 <> 0 THEN price END AS current_price,
   CASE WHEN k % 2 = 0 AND (market <> 'MX' OR k % 8 < 4) THEN 'US $9' || size END AS was_price,
   CASE WHEN market = 'MX' THEN CASE WHEN k % 8 < 4 AND k % 4 = 0 THEN '(' || size || '% off)'
                                     WHEN k % 8 < 4 AND k % 4 = 2 THEN 'Save big' END
        WHEN k % 4 = 0 OR (k % 4 = 1 AND market <> 'NL') THEN size || '%' END AS discount,
   CASE WHEN k % 7 <> 0 THEN size || ' available' END AS availability,
   CASE WHEN k % 7 <> 0 AND k % 3 <> 1 THEN (k % 97) || ' sold' END AS sold_count,
   CASE market
     WHEN 'US' THEN CASE WHEN has_box THEN (CASE WHEN strong THEN 'Free ' || size || ' ' ELSE '' END)
                                           || 'Tipx Standard ' || seller END
     WHEN 'AU' THEN CASE WHEN has_box AND strong THEN 'Free ' || size
                         WHEN has_box THEN 'Tipx Standard ' || seller || '. cv' END
     WHEN 'FR' THEN CASE WHEN has_box AND strong THEN 'Free ' || size ELSE 'No shipping info found' END
     WHEN 'IT' THEN CASE WHEN has_box AND strong THEN 'Free ' || size
                         WHEN has_box THEN 'Tipx Standard ' || seller || '. . hidden See details cv'
                         WHEN NOT has_ship THEN 'No shipping info found' END
     WHEN 'NL' THEN CASE WHEN has_box THEN (CASE WHEN strong THEN 'Free ' || size || ' ' ELSE '' END)
                         || 'Tipx Standard ' || seller || '. hidden cv ' || loc_prefix || town END
     WHEN 'CA' THEN CASE WHEN has_box THEN (CASE WHEN strong THEN 'Free ' || size || ' ' ELSE '' END)
                         || 'Tipx Standard ' || seller || '. hidden cv'
                         || CASE WHEN k % 3 = 0 THEN ' ' || town ELSE '' END END
     WHEN 'GB' THEN CASE WHEN has_box THEN (CASE WHEN strong THEN 'Free ' || size || ' ' ELSE '' END)
                         || 'Tipx Standard ' || seller || '. hidden cv'
                         || CASE WHEN k % 3 = 0 THEN ' ' || town ELSE '' END END
     ELSE CASE WHEN has_box THEN (CASE WHEN strong THEN 'Free ' || size || ' ' ELSE '' END)
                         || 'Standard ' || seller || '. hidden'
               WHEN has_ship AND market <> 'MX' THEN 'No shipping info found' END
   END AS shipping,
   CASE WHEN has_box AND (market NOT IN ('AU','CA','GB','IT') OR k % 3 <> 0) THEN town END AS location,
   CASE WHEN k % 17 <> 0 AND market <> 'NL' AND (market <> 'IT' OR k % 20 < 10)
        THEN size || ' days returns accepted Seller pays.' END AS returns,
   CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'New.' ELSE 'Used.' END
        || CASE WHEN market = 'NL' THEN ' Opened ' || kind ELSE '' END END AS condition,
   CASE WHEN (market NOT IN ('US','IT') OR k % 3 = 0) AND (market <> 'NL' OR k % 3 <> 0) THEN b END AS brand,
   CASE WHEN (market NOT IN ('US','IT') OR (k + 1) % 3 = 0) AND (market <> 'NL' OR (k + 1) % 3 <> 0)
        THEN kind END AS type,
   CASE WHEN market <> 'FR' AND k % 19 <> 0 THEN seller ELSE '' END AS store_name,
   CASE WHEN market = 'FR' OR k % 19 = 0 THEN '' WHEN market = 'US' THEN (k % 100) || '% positive feedback'
        ELSE size || ' items' END AS store_feedback,
   CASE WHEN market <> 'FR' AND k % 19 <> 0 AND k % 6 <> 0 THEN (k % 1000) || ' items sold' ELSE '' END AS store_sales
   FROM l1),
ok AS (SELECT * FROM l2 WHERE ok),
done AS (SELECT * FROM ok WHERE title IS NOT NULL AND current_price IS NOT NULL)"""

FIELDS = ("title, subtitle, current_price, was_price, discount, availability, sold_count, shipping, "
          "location, returns, condition, brand, type, store_name, store_feedback, store_sales")

SEARCHES = f"""
s0 AS (SELECT o_orderkey AS okey, {_market('o_orderkey')} AS market, lower(o_orderpriority) AS search_term,
              CAST(row_number() OVER (PARTITION BY o_orderkey % 10, o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS page_num,
              o_orderkey % 97 - 90 AS state, make_timestamp((1600000000 + o_orderkey) * 1000000) AS captured_at
       FROM orders),
s1 AS (SELECT *, state NOT IN (2, 3, 4) AS L, state NOT IN (1, 2, 3, 4, 6) AS H,
              state IN (2, 3, 5, 6) AS B, state IN (3, 5, 6) AS D FROM s0),
k0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey - l_partkey % 10 + l_orderkey % 10 AS item,
              CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos
       FROM lineitem),
facts AS (SELECT market, search_term, page_num, okey,
                 (SELECT count(*) FROM k0 WHERE l_orderkey = okey) AS n_links,
                 CASE market WHEN 'US' THEN H OR NOT D WHEN 'FR' THEN NOT D AND H
                      WHEN 'NL' THEN L OR (B AND NOT D) WHEN 'GB' THEN L
                      ELSE H OR (NOT D AND L) END AS has_next FROM s1),
links AS (SELECT s1.market, s1.search_term, s1.page_num, k0.pos, s1.captured_at, k0.item,
                 {_base_url('s1.market')} || '/itm/' || k0.item AS url
          FROM s1 JOIN k0 ON okey = l_orderkey)"""

_CAP = """CASE WHEN market IN ('AU','CA','DE') THEN 7 WHEN market = 'ES' THEN 0 WHEN market = 'US' THEN 100000
               WHEN market IN ('FR','NL') THEN 40 END"""

FIRST_LINKS = """
f0 AS (SELECT *, row_number() OVER (PARTITION BY market, search_term, url ORDER BY page_num, pos) AS copy FROM links),
placed AS (SELECT market, search_term, page_num, pos, item, CAST(item AS VARCHAR) AS item_id,
                  row_number() OVER (PARTITION BY market, search_term ORDER BY page_num, pos) AS seq
           FROM f0 WHERE copy = 1)"""

_SPACE = (r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_TOKENS = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<[a-z][^>]*>"""
_PAGE_TAGS = f"""
t0 AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TOKENS}', 0)) AS tok,
              generate_subscripts(regexp_extract_all(html, '{_TOKENS}', 0), 1) AS i FROM pages),
t1 AS (SELECT page_id, i, tok, lower(regexp_extract(tok, '^<([A-Za-z][^\\s/>]*)', 1)) AS tag
       FROM t0 WHERE tok NOT LIKE '<!%')"""
_HREF = """CASE WHEN tok LIKE '% href=%' THEN replace(regexp_extract(tok, ' href="([^"]*)"', 1), '&amp;', '&') END"""


def _listing(select: str) -> str:
    return f"WITH {LISTINGS} {select}"


def _search(select: str, extra: str = "") -> str:
    return f"WITH {SEARCHES}{',' + extra if extra else ''} {select}"


def _rule(markets: list[str], column: str) -> str:
    names = ",".join(f"'{m}'" for m in markets)
    return _listing(f"SELECT market, url, {column} FROM ok WHERE market IN ({names})")


_BOX_PARTS = """CASE WHEN has_box THEN {ship}
     WHEN live AND k % 17 <> 0 THEN {ret} ELSE '' END"""
_STRONG = "(CASE WHEN strong THEN 'Free ' || size || (CASE WHEN market = 'FR' THEN '..' ELSE '' END) || '|' ELSE '' END)"
_DETAILS = "(CASE WHEN market = 'IT' THEN 'Vedi i dettagli' ELSE 'See details' END || CASE WHEN market = 'FR' THEN '|Afficher plus' ELSE '' END)"
_RET = "size || ' days|returns' || chr(10) || '  accepted|.|Seller pays .|'"

_RAW_VERDICT = """CASE WHEN length(html) < 1500 THEN 'Content too short'
      WHEN contains(lower(html), 'sorry, the page you requested was not found') THEN 'Error page: Sorry, the page you requested was not found'
      WHEN contains(lower(html), 'this listing was ended') THEN 'Error page: This listing was ended'
      WHEN contains(lower(html), 'security measure') THEN 'Error page: Security Measure'
      WHEN contains(lower(html), 'robot check') THEN 'Error page: Robot Check'
      ELSE 'Missing element: div.x-item-title' END"""
_LISTING_VERDICT = """CASE WHEN k % 53 = 0 THEN 'Content too short'
      WHEN k % 59 = 0 THEN CASE WHEN market = 'US' THEN 'Error page: ' ELSE 'Error page detected: ' END || 'Robot Check'
      WHEN k % 47 = 0 THEN CASE WHEN market = 'US' THEN 'Missing element: ' ELSE 'Missing required element: ' END || 'div.x-price-section'
      WHEN market = 'US' THEN 'Content valid' ELSE 'Page content valid' END"""
_NEXT_RULE = """CASE {m} WHEN 'US' THEN 'href_or_open_button' WHEN 'FR' THEN 'button_then_href' WHEN 'GB' THEN 'link'
    WHEN 'NL' THEN 'link_or_open_button' WHEN 'JP' THEN NULL ELSE 'link_then_button' END"""

_TERMS = f"""
r0 AS (SELECT o_orderkey AS request, {_market('o_orderkey')} AS market,
              [lower(o_orderpriority), 'lot ' || o_custkey, '', 'café ~a*b&c'] AS terms,
              CASE WHEN o_orderkey % 3 < 2 OR o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS INTEGER) END AS max_items
       FROM orders),
r1 AS (SELECT request, market, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS term_no,
              unnest(terms) AS search_term, max_items FROM r0)"""

_REACH = """
ends AS (SELECT market, search_term, least(coalesce(min(page_num) FILTER (WHERE NOT (has_next AND n_links > 0)), max(page_num)),
                max(page_num)) AS last_page FROM facts GROUP BY ALL),
reached AS (SELECT facts.* FROM facts JOIN ends USING (market, search_term) WHERE page_num <= last_page)"""

_ASKED = """,
asked0 AS (SELECT r.market, r.search_term, r.page_num, k0.pos, k0.item, row_number() OVER (
             PARTITION BY r.market, r.search_term, k0.item ORDER BY r.page_num, k0.pos) AS copy
           FROM reached r JOIN k0 ON r.okey = k0.l_orderkey),
asked AS (SELECT a.market, a.search_term, a.page_num, a.item, d.url, d.title, row_number() OVER (
            PARTITION BY a.market, a.search_term ORDER BY a.page_num, a.pos) AS seq
          FROM asked0 a JOIN done d ON d.k = a.item WHERE copy = 1)"""

ORACLE: dict[str, str] = {
    "q_capture_scan": _search(
        """SELECT market, 'search' AS page_type, count(*) AS pages FROM s0 WHERE okey % 13 <> 3 GROUP BY ALL
           UNION ALL SELECT market, 'product', count(*) FROM l0 WHERE k % 17 <> 5 GROUP BY market""", LISTINGS),
    "q_search_terms": f"WITH {_TERMS} SELECT request, term_no, search_term, max_items FROM r1",
    "q_search_requests": f"""WITH {_TERMS} SELECT DISTINCT market, search_term, CAST(n AS INTEGER) AS page_num,
        {_base_url('market')} || '/sch/i.html?_nkw=' ||
        CASE WHEN search_term LIKE 'caf%' THEN 'caf%C3%A9+~a%2Ab%26c' ELSE replace(search_term, ' ', '+') END
        || '&_pgn=' || n || '&_ipg=240' AS url FROM r1, range(1, 4) t(n)""",
    "q_market_dim": f"""SELECT p_partkey, m AS market,
        CASE WHEN m = 'JP' THEN 'unknown market' ELSE {_base_url('m')} END AS base_url,
        CASE WHEN m <> 'JP' THEN 1500 END AS min_length, {_NEXT_RULE.format(m='m')} AS next_page_rule
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 37 = 0 THEN 'JP' ELSE {_market('p_partkey')} END AS m FROM part)""",
    "q_store_slug": f"""SELECT market, replace(p_name, ' ', '_') AS term_slug,
        replace('products_' || market || '_' || p_name || '.json', ' ', '_') AS file_name, count(*) AS products
        FROM (SELECT {_market('p_partkey')} AS market, p_name FROM part) GROUP BY ALL""",
    "q_upsert_new": _search(
        """SELECT market, search_term, page_num, url FROM once WHERE NOT in_batch
           UNION ALL SELECT market, search_term, page_num, url FROM once b WHERE in_batch AND NOT EXISTS
             (SELECT 1 FROM once s WHERE NOT s.in_batch AND s.market = b.market
              AND s.search_term = b.search_term AND s.url = b.url)""",
        """once AS (SELECT market, search_term, '/itm/' || item AS url, okey % 4 = 0 AS in_batch, min(page_num) AS page_num
           FROM s1 JOIN k0 ON okey = l_orderkey GROUP BY ALL)"""),
    "q_snapshot_changed": _listing(
        """SELECT market, CASE WHEN market = 'NL' THEN 0 ELSE count(*) END AS rows,
                  market = 'NL' OR bool_or(k % 30 = 7 OR k % 40 = 3) AS changed, true AS self_equal, false AS then_equal
           FROM done GROUP BY market"""),
    "q_snapshot_sync": _listing("SELECT market, search_term, url, title FROM done WHERE market <> 'NL'"),
    "q_attr_references": """SELECT p_partkey, '/itm/' || p_partkey || '?q=café' || chr(160) || '"''<&copy=1&amp;€€' AS href FROM part""",
    "q_quarantine": _listing(
        f"""SELECT market, url, {_LISTING_VERDICT} AS reason, strftime(captured_at, '%Y%m%d_%H%M%S') AS quarantined_at
            FROM l2 WHERE NOT ok UNION ALL
            SELECT market, url, 'incomplete product', strftime(captured_at, '%Y%m%d_%H%M%S')
            FROM ok WHERE title IS NULL OR current_price IS NULL"""),
    "q_store_envelope": _listing(
        """SELECT market, search_term, part, count(*) AS in_part, arg_min(url, seq) AS first_url,
                  arg_max(title, seq) AS last_title, max(total) AS total_products,
                  CAST(50 AS BIGINT) AS requested_items, max(total) AS actual_items_found,
                  strftime(max(captured_at), '%Y-%m-%dT%H:%M:%S') AS last_updated
           FROM (SELECT *, (seq - 1) // 40 AS part FROM (SELECT *,
                 row_number() OVER (PARTITION BY market, search_term ORDER BY page_num, pos, url) AS seq,
                 count(*) OVER (PARTITION BY market, search_term) AS total FROM done)) GROUP BY market, search_term, part"""),
    "q_store_read": _listing(
        f"SELECT market, replace(search_term, ' ', '_') AS term_slug, url, {FIELDS} FROM done"),
    "q_envelope_source": _listing(
        f"SELECT market, replace(search_term, ' ', '_') AS term_slug, url, {FIELDS} FROM done"),
    "q_validate": _search(
        f"""SELECT 'US' AS market, 'product' AS page_type, 'page ' || page_id AS url, {_RAW_VERDICT} AS verdict,
                   false AS is_valid, {_RAW_VERDICT} IN ('Error page: Robot Check', 'Error page: Security Measure') AS blocked FROM pages
            UNION ALL SELECT market, 'product', url, {_LISTING_VERDICT}, ok, k % 53 <> 0 AND k % 59 = 0 FROM l2
            UNION ALL SELECT market, 'search', {_base_url('market')} || '/sch/i.html?_nkw=' || replace(search_term, ' ', '+')
                   || '&_pgn=' || page_num || '&_ipg=240',
                   CASE WHEN market = 'US' THEN 'Content valid' ELSE 'Page content valid' END, true, false FROM s0""", LISTINGS),
    "q_capture_outcome": """
        WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
               CASE WHEN event_type = 'view' THEN 'success' WHEN event_type IN ('click', 'error') THEN 'retry'
                    WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'retry' ELSE 'final' END AS c,
               CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Connection reset'
                    ELSE 'bad certificate' END END AS err FROM events),
        g AS (SELECT user_id, count(*) AS logged, min(n) FILTER (WHERE c = 'success') AS good,
                     min(n) FILTER (WHERE c = 'final') AS fin, max(n) AS last,
                     arg_max(err, n) FILTER (WHERE n <= 3 AND err IS NOT NULL) AS last_error FROM e GROUP BY user_id),
        o AS (SELECT *, CASE WHEN good <= 3 AND (fin IS NULL OR good < fin) THEN 'success' WHEN fin <= 3 THEN 'failed'
                     WHEN last >= 3 THEN 'exhausted' ELSE 'pending' END AS outcome FROM g)
        SELECT user_id, logged, least(coalesce(least(good, fin), last), last, 3) AS attempts_used, outcome,
               CASE WHEN outcome = 'success' THEN good END AS success_attempt, last_error FROM o""",
    "q_complete_products": _listing("SELECT market, url, title, current_price FROM done"),
    "q_page_elements": f"WITH {_PAGE_TAGS} SELECT page_id, tag, count(*) AS n FROM t1 GROUP BY ALL",
    "q_sel_tag_class": _listing("SELECT k AS item, CAST(money AND k % 2 = 0 AS BIGINT) AS n FROM l2"),
    "q_sel_class_all": _listing(
        "SELECT k AS item, CAST(live AND k % 17 <> 0 AND k % 20 < 10 AS BIGINT) AS n FROM l2"),
    "q_sel_class_substr": _listing(
        "SELECT k AS item, CAST(money AND k % 2 = 0 AS BIGINT) + CAST(has_box AND strong AS BIGINT) AS n FROM l2"),
    "q_sel_descendant": _listing("SELECT k AS item, CASE WHEN live THEN title END AS text FROM l2"),
    "q_sel_child": _listing(
        """SELECT k AS item, CASE WHEN live AND k % 5 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'New' ELSE 'Used' END
           || '. Opened ' || kind END AS text FROM l2"""),
    "q_sel_direct": _listing(
        """SELECT k AS item, CASE WHEN live AND k % 7 <> 0 THEN 1 + CAST(k % 3 <> 1 AS BIGINT) ELSE 0 END AS n FROM l2"""),
    "q_sel_attr": _search(
        "SELECT okey AS o_orderkey, CAST(L AS BIGINT) AS links, CAST(B AS BIGINT) AS buttons FROM s1"),
    "q_sel_position": _listing(
        """SELECT k AS item, CASE WHEN has_box THEN loc_prefix || town END AS second,
                  CASE WHEN has_box THEN loc_prefix || town END AS last,
                  CAST(CASE WHEN has_box THEN 5 WHEN live AND k % 17 <> 0 THEN 1 END AS BIGINT) AS firsts FROM l2"""),
    "q_sel_list": _listing(
        """SELECT k AS item, CASE WHEN NOT live OR k % 3 = 1 THEN NULL WHEN k % 3 = 0 THEN 'x' || b ELSE '-' END AS text FROM l2"""),
    "q_sel_contains": _listing(
        "SELECT k AS item, CASE WHEN market = 'IT' AND has_box AND k % 3 <> 0 THEN loc_prefix || town END AS text FROM l2"),
    "q_sel_first": _listing("SELECT k AS item, CASE WHEN money THEN current_price END AS text FROM l2"),
    "q_sel_all": f"""WITH {_PAGE_TAGS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS n,
        {_HREF} AS href FROM t1 WHERE tag = 'a'""",
    "q_sel_nth": _listing("SELECT k AS item, CASE WHEN live THEN sold_count END AS text FROM l2"),
    "q_attr_read": _search(
        """SELECT okey AS o_orderkey, CASE WHEN D THEN 'true' END AS disabled,
                  CASE WHEN H THEN '?p=2' ELSE '' END AS href FROM s1"""),
    "q_subtree_text": _listing(
        """SELECT k AS item, CASE WHEN live AND k % 19 <> 0 THEN size || ' items' || (k % 100) || '% positive feedback'
           || (k % 1000) || CASE WHEN k % 6 <> 0 THEN 'items sold' ELSE '' END END AS text FROM l2"""),
    "q_excl_class": _listing("SELECT k AS item, " + _BOX_PARTS.format(
        ship=f"{_STRONG} || 'Tipx|Standard ' || seller || '.|.|See details|' || loc_prefix || town",
        ret=f"{_RET} || {_DETAILS}") + " AS parts FROM l2"),
    "q_excl_descendant": _listing("SELECT k AS item, " + _BOX_PARTS.format(
        ship=f"{_STRONG} || 'Standard ' || seller || '.|.|hidden|See details|cv|' || loc_prefix || town",
        ret=f"{_RET} || 'hidden|' || {_DETAILS}") + " AS parts FROM l2"),
    "q_grandparent": _listing(
        "SELECT k AS item, CASE WHEN has_box THEN 7 + CAST(strong AS BIGINT) ELSE 0 END AS n FROM l2"),
    "q_fallback": _listing(
        """SELECT k AS item, CASE WHEN live AND (k % 3 <> 0 OR (market <> 'IT' AND (market <> 'FR' OR k % 20 >= 10)))
           THEN b END AS text FROM l2"""),
    "q_field_title": _listing("SELECT market, url, title, subtitle FROM ok"),
    "q_field_price": _listing("SELECT market, url, current_price, was_price FROM ok"),
    "q_field_discount": _listing("SELECT market, url, discount FROM ok"),
    "q_field_quantity": _listing("SELECT market, url, availability, sold_count FROM ok"),
    "q_shipping_us": _rule(["US"], "shipping"),
    "q_shipping_uk_ca": _rule(["CA", "GB"], "shipping"),
    "q_shipping_es_mx": _rule(["DE", "ES", "MX"], "shipping"),
    "q_shipping_fr": _rule(["FR"], "shipping"),
    "q_shipping_it": _rule(["IT"], "shipping"),
    "q_shipping_au": _rule(["AU"], "shipping"),
    "q_shipping_nl": _rule(["NL"], "shipping"),
    "q_location_last": _rule(["US"], "location"),
    "q_location_first": _rule(["NL"], "location"),
    "q_location_marker": _rule(["CA", "GB"], "location"),
    "q_location_es_mx": _rule(["DE", "ES", "MX"], "location"),
    "q_location_fr": _rule(["FR"], "location"),
    "q_location_it": _rule(["IT"], "location"),
    "q_location_au": _rule(["AU"], "location"),
    "q_returns": _listing("SELECT market, url, returns FROM ok"),
    "q_condition": _listing("SELECT market, url, condition FROM ok"),
    "q_brand_type": _listing("SELECT market, url, brand, type FROM ok"),
    "q_store_info": _listing("SELECT market, url, store_name, store_feedback, store_sales FROM ok"),
    "q_product_fields": _listing(f"SELECT market, url, {FIELDS} FROM done"),
    "q_strip": f"SELECT doc_id, {_strip('text')} AS text FROM documents",
    "q_collapse": f"SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS text FROM documents",
    "q_trailing_dot": """SELECT doc_id, CASE WHEN suffix(text, '.') THEN substr(text, 1, length(text) - 1)
        ELSE text END AS text FROM documents""",
    "q_trailing_dots": "SELECT doc_id, rtrim(text || '...', '.') AS text FROM documents",
    "q_dot_space": "SELECT doc_id, replace(replace(text, '.', ' .'), ' .', '.') AS text FROM documents",
    "q_before_marker": f"SELECT doc_id, {_strip('''string_split(text, 'the')[1]''')} AS text FROM documents",
    "q_after_marker": f"SELECT doc_id, {_strip('''string_split(text, 'the')[-1]''')} AS text FROM documents",
    "q_after_colon": """SELECT doc_id, CASE WHEN strpos(text, ': ') > 0 THEN substr(text, strpos(text, ': ') + 2)
        ELSE text END AS text FROM documents""",
    "q_prefix_remove": """SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN replace(p_name || ' ' || p_name, 'red ', '') END AS text FROM part""",
    "q_first_sentence": "SELECT doc_id, string_split(text, '.')[1] || '.' AS text FROM documents",
    "q_percent": "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size || '%' END AS text FROM part",
    "q_concat_pair": "SELECT p_partkey, p_brand || ' ' || p_type AS text FROM part",
    "q_join_parts": f"SELECT doc_id, {_strip('replace(text, chr(10), chr(32))')} AS text FROM documents",
    "q_noise_filter": """SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE '|' || p_type END AS text FROM part""",
    "q_exclude_any": """SELECT doc_id, NOT (contains(text, 'http') OR contains(text, '@') OR contains(text, 'License')
        OR contains(text, 'copyright')) AS keep FROM documents""",
    "q_icontains": "SELECT page_id, contains(lower(html), 'nav') AS hit FROM pages",
    "q_url_base": "SELECT page_id, string_split(url || '/sch/i.html?_nkw=' || url, '/sch')[1] AS site FROM pages",
    "q_time_format": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso,
        strftime(o_orderdate, '%Y%m%d_%H%M%S') AS compact FROM orders""",
    "q_search_links": _search(
        "SELECT market, search_term, page_num, pos, CAST(item AS VARCHAR) AS item_id, url FROM links"),
    "q_ordered_links": _search(
        "SELECT market, search_term, page_num, pos, CAST(item AS VARCHAR) AS item_id FROM links"),
    "q_links_per_page": f"""WITH {_PAGE_TAGS} SELECT page_id, count(*) AS links,
        count(*) FILTER (WHERE contains({_HREF}, '?')) AS with_query FROM t1 WHERE tag = 'a' GROUP BY page_id""",
    "q_has_next": _search("SELECT market, search_term, page_num, n_links, has_next FROM facts"),
    "q_page_reach": _search(
        """SELECT market, search_term, page_num, n_links, has_next FROM (SELECT *, coalesce(
             bool_and(has_next AND n_links > 0) OVER prior, true)
             AND page_num = row_number() OVER (PARTITION BY market, search_term ORDER BY page_num) AS keep
           FROM facts WHERE NOT (page_num = 7 AND market IN ('AU', 'US'))
           WINDOW prior AS (PARTITION BY market, search_term ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
           WHERE keep"""),
    "q_unseen_links": _search(
        """SELECT market, search_term, page_num, pos, CAST(item AS VARCHAR) AS item_id FROM links
           WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = item AND p_partkey % 3 = 0)"""),
    "q_link_products": _search(
        """SELECT links.market, links.search_term, links.page_num, links.pos, CAST(item AS VARCHAR) AS item_id,
                  title, title IS NULL AS missing FROM links LEFT JOIN done ON k = item""", LISTINGS),
    "q_run_summary": _search(
        f"""SELECT market, search_term, pages_read, CAST(links_seen AS BIGINT) AS links_seen, items_found,
                   CAST(cap AS BIGINT) AS items_requested,
                   least(items_found, coalesce(cap, items_found)) AS items_stored,
                   CAST(greatest(coalesce(cap - items_found, 0), 0) AS BIGINT) AS shortfall,
                   CASE WHEN dry THEN 'no more items' WHEN items_found < cap THEN 'shortfall' ELSE 'completed' END AS status,
                   wanted AND coalesce(items_found < cap, true) AS partial, CAST(NULL AS VARCHAR) AS error
            FROM (SELECT market, search_term, count(*) AS pages_read, sum(n_links) AS links_seen,
                         bool_or(n_links = 0) AS dry, arg_max(has_next AND n_links > 0, page_num) AS wanted, nullif({_CAP}, 0) AS cap FROM reached GROUP BY ALL)
            JOIN (SELECT market, search_term, count(item) AS items_found FROM
                    (SELECT DISTINCT r.market, r.search_term, d.k AS item FROM reached r
                     LEFT JOIN k0 ON r.okey = l_orderkey LEFT JOIN done d ON d.k = k0.item) GROUP BY ALL)
            USING (market, search_term)""", LISTINGS + "," + _REACH),
    "q_run_store": _search(
        f"""SELECT market, search_term, page_num, url, seq, title FROM m1 WHERE coalesce(seq <= nullif({_CAP}, 0), true)""",
        LISTINGS + "," + _REACH + """,
        m0 AS (SELECT r.market, r.search_term, r.page_num, k0.pos, k0.item, row_number() OVER (
                 PARTITION BY r.market, k0.item ORDER BY r.okey, r.search_term, r.page_num, k0.pos) AS copy
               FROM reached r JOIN k0 ON r.okey = k0.l_orderkey),
        m1 AS (SELECT m0.market, m0.search_term, m0.page_num, d.url, d.title, row_number() OVER (
                 PARTITION BY m0.market, m0.search_term ORDER BY m0.page_num, m0.pos) AS seq
               FROM m0 JOIN done d ON d.k = m0.item WHERE copy = 1 AND item % 2 <> 0)"""),
    "q_run_account": _search(
        f"""SELECT market, page_type, fate, count(*) AS captures FROM (
              SELECT market, 'product' AS page_type, CASE WHEN NOT ok THEN {_LISTING_VERDICT}
                  WHEN title IS NULL OR current_price IS NULL THEN 'incomplete product'
                  WHEN kept THEN 'stored' WHEN NOT kept THEN 'beyond cap' ELSE 'not linked' END AS fate
              FROM l2 LEFT JOIN (SELECT item, bool_or(coalesce(seq <= nullif({_CAP}, 0), true)) AS kept FROM asked GROUP BY item) ON item = k
              UNION ALL SELECT f.market, 'search', CASE WHEN r.okey IS NULL THEN 'page not reached' ELSE 'read' END
              FROM facts f LEFT JOIN reached r ON r.okey = f.okey) GROUP BY ALL""", LISTINGS + "," + _REACH + _ASKED),
    "q_run_saved_twice": _search(
        f"""SELECT market, search_term, page_num, url, seq, title, CAST(0 AS BIGINT) AS again FROM asked
            WHERE coalesce(seq <= nullif({_CAP}, 0), true)""", LISTINGS + "," + _REACH + _ASKED),
    "q_run_rejects": _listing(
        f"""SELECT * FROM (SELECT CASE WHEN k % 37 = 0 THEN 'JP' ELSE market END AS market, url, attempt,
              CASE WHEN k % 37 = 0 THEN 'unknown market' WHEN z = 5 THEN 'status 404' WHEN z = 6 THEN 'timeout'
                   WHEN NOT ok THEN {_LISTING_VERDICT}
                   WHEN title IS NULL OR current_price IS NULL THEN 'incomplete product' END AS reason,
              CASE WHEN k % 17 = 5 THEN CASE WHEN market = 'NL' AND k % 37 <> 0 THEN 'pending' ELSE 'failed' END
                   WHEN k % 37 = 0 OR NOT ok THEN 'pending' ELSE 'success' END AS outcome
            FROM (SELECT *, 1 AS attempt, k % 17 AS z FROM l2 UNION ALL SELECT *, 2, 7 FROM l2 WHERE k % 17 = 6))
            WHERE reason IS NOT NULL"""),
    "q_store_totals": _search(
        "SELECT market, count(*) AS total_products, count(DISTINCT item) AS distinct_urls FROM links GROUP BY market"),
    "q_dedup_first": _search(
        """SELECT market, url, arg_min(search_term, o) AS search_term, arg_min(page_num, o) AS page_num, arg_min(pos, o) AS pos
           FROM (SELECT *, epoch(captured_at) * 1000 + pos AS o FROM links) GROUP BY market, url"""),
    "q_cap_per_term": _search(
        f"""SELECT market, search_term, page_num, pos, item_id, seq FROM placed
            WHERE coalesce(seq <= nullif({_CAP}, 0), true)""", FIRST_LINKS),
    "q_chunks": _search("SELECT market, search_term, item_id, (seq - 1) // 5 AS chunk FROM placed", FIRST_LINKS),
    "q_progress": _search(
        f"""SELECT market, search_term, item_id, seq || '/' || coalesce(CAST(nullif({_CAP}, 0) AS VARCHAR), 'unlimited')
            AS progress FROM placed""", FIRST_LINKS),
    "q_batches": _search(
        """SELECT market, search_term, (seq - 1) // 50 AS batch, count(*) AS rows, ((seq - 1) // 50 + 1) % 20 = 0 AS snapshot
           FROM placed GROUP BY ALL""", FIRST_LINKS),
    "q_stream_products": _listing(f"SELECT market, search_term, page_num, pos, url, {FIELDS} FROM done"),
    "q_stream_flush": _listing(
        "SELECT CAST(page_num % 3 AS BIGINT) AS batch_id, count(*) AS rows FROM done GROUP BY ALL"),
    "q_stream_quarantine": _listing(
        f"""SELECT CASE WHEN k % 37 = 0 THEN 'JP' ELSE market END AS market, url, true AS in_batches, reason,
                   CASE WHEN reason IS NULL OR reason = 'incomplete product' THEN title END AS title
            FROM (SELECT *, CASE WHEN k % 37 = 0 THEN 'unknown market' WHEN k % 17 = 5 THEN 'status 404'
                   WHEN k % 17 = 6 THEN 'timeout' WHEN NOT ok THEN {_LISTING_VERDICT}
                   WHEN title IS NULL OR current_price IS NULL THEN 'incomplete product' END AS reason FROM l2)"""),
    "q_stream_dedup": _listing("SELECT market, url, title FROM done"),
    "q_stream_cap": _listing(
        """SELECT market, search_term, url FROM (SELECT *, row_number() OVER (PARTITION BY market, search_term
             ORDER BY page_num % 3, page_num, pos) AS seq FROM done)
           WHERE coalesce(seq <= CASE WHEN market IN ('AU', 'GB') THEN 5 WHEN market = 'US' THEN 20 END, true)"""),
    "q_stream_state_cap": _listing(
        """SELECT market, search_term, url, title FROM (SELECT *, row_number() OVER (PARTITION BY market, search_term
             ORDER BY page_num % 3, page_num, pos) AS seq FROM done)
           WHERE coalesce(seq <= CASE WHEN market IN ('AU', 'GB') THEN 5 WHEN market = 'US' THEN 20 END, true)"""),
    "q_stream_links": _search(
        """SELECT market, search_term, CAST(item AS VARCHAR) AS item_id, first.url, title, current_price, k IS NULL AS missing
           FROM (SELECT DISTINCT l.market, l.search_term, l.item, l.url FROM links l
                 JOIN reached r ON r.market = l.market AND r.search_term = l.search_term AND r.page_num = l.page_num) first
           LEFT JOIN (SELECT k, title, current_price FROM done) ON k = item""", LISTINGS + "," + _REACH),
    "q_stream_reset": _listing(
        """SELECT CAST(r AS INTEGER) AS run_id, market, search_term, count(*) AS products
           FROM done, range(1, 3) t(r) GROUP BY ALL"""),
    "q_stream_resume": _listing("SELECT market, search_term, url, title FROM done"),
}

# The same rows by another way.
ORACLE.update({new: ORACLE[old] for new, old in {
    "q_key_index": "q_upsert_new", "q_tree_join": "q_sel_descendant", "q_store_totals_merge": "q_store_totals",
    "q_stream_page_reach": "q_page_reach", "q_stream_outcome": "q_capture_outcome"}.items()})
