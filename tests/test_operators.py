"""Order-dependent, link, store and check operators against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.operators.links import has_next, page_limit, reached_pages
from pagemill.operators.sequence import (PAGE_BLOCK, hot_join, keep_first, positioned, spread_join,
                                         within_cap)
from pagemill.operators.store import (appended, changed_since, envelopes, new_products, same_rows,
                                      save_or_quarantine, snapshot_rows, write_snapshot)
from pagemill.operators.validate import with_verdict
from pagemill.plans.rules import MARKETS, market_rules, with_rules
from pagemill.schemas import PRODUCT
from pagemill.sources.store_io import read_envelopes, stored_products, write_envelopes
from pagemill.sources.terms import search_terms


@pytest.fixture(scope="module")
def hot_rows(spark):
    """A third of the rows in one term, spread over several page blocks."""
    rnd = random.Random(7)
    rows = [("US", "hot" if i % 3 == 0 else f"t{i % 50}", rnd.randrange(1, 5 * PAGE_BLOCK), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "market string, search_term string, page_num int, pos int")


def test_positions_match_row_number(hot_rows):
    rows, df = hot_rows
    got = {(r.search_term, r.pos): r.seq for r in
           positioned(df, ["market", "search_term"], "page_num", ["pos"]).collect()}
    want = {}
    for term, group in itertools.groupby(sorted(rows, key=lambda r: (r[1], r[2], r[3])), lambda r: r[1]):
        want.update({(term, r[3]): n for n, r in enumerate(group, 1)})
    assert got == want


def test_cap_zero_and_null_are_no_cap(spark):
    df = spark.createDataFrame([(5, 3), (5, 0), (5, None), (2, 3)], "seq int, cap int")
    assert [r[0] for r in df.select(within_cap(F.col("seq"), F.col("cap"))).collect()] == [False, True, True, True]


def test_spread_join_equals_join(spark, hot_rows):
    _, df = hot_rows
    caps = df.select("market", "search_term").distinct().withColumn("cap", F.lit(4))
    caps = caps.where("search_term <> 't1'")
    for how in ("inner", "left"):
        a = spread_join(df, caps, ["market", "search_term"], F.col("pos"), how)
        b = df.join(caps, ["market", "search_term"], how)
        assert same_rows(a.select(b.columns), b).first()[0]
        c = hot_join(df, caps, ["market", "search_term"], F.col("pos"), how, rows_per_slice=100)
        assert same_rows(c.select(b.columns), b).first()[0]


def test_keep_first(hot_rows):
    rows, df = hot_rows
    got = {tuple(r) for r in keep_first(df, ["search_term"], ["page_num", "pos"]).select(
        "search_term", "page_num", "pos").collect()}
    want = {(t, *min((r[2], r[3]) for r in rows if r[1] == t)) for t in {r[1] for r in rows}}
    assert got == want


def test_page_reach(spark):
    rnd = random.Random(3)
    rows = []
    for t in range(60):
        for p in range(1, 9):
            if rnd.random() < 0.93:
                rows.append(("US", f"t{t}", p, rnd.random() < 0.85, rnd.choice([0, 2, 3, 4, 5, 6])))
    df = spark.createDataFrame(rows, "market string, search_term string, page_num int, has_next boolean, n_links int")
    want = set()
    by_key = {(r[1], r[2]): r for r in rows}
    for t in range(60):
        p = 1
        while (f"t{t}", p) in by_key:
            want.add((f"t{t}", p))
            row = by_key[(f"t{t}", p)]
            if not (row[3] and row[4] > 0):
                break
            p += 1
    assert {(r.search_term, r.page_num) for r in reached_pages(df).collect()} == want
    assert page_limit(df).count() == len({r[1] for r in rows})


@pytest.mark.parametrize("market,want", [
    ("US", "11011"), ("AU", "10001"), ("FR", "10000"), ("NL", "11101"), ("GB", "10101")])
def test_has_next(spark, market, want):
    """States: link with address; enabled button; bare link and disabled button; nothing; bare link."""
    states = [(1, 1, 0, 0), (0, 0, 1, 0), (1, 0, 1, 1), (0, 0, 0, 0), (1, 0, 0, 0)]
    df = spark.createDataFrame([(i, *map(bool, s)) for i, s in enumerate(states)],
                               "i int, link boolean, href boolean, button boolean, disabled boolean")
    rule = next(m.next_page for m in MARKETS if m.market == market)
    flags = F.struct("link", "href", "button", "disabled")
    got = df.orderBy("i").select(has_next(flags, F.lit(rule))).collect()
    assert "".join(str(int(r[0])) for r in got) == want


def products(spark, rows):
    base = spark.createDataFrame(rows, "market string, search_term string, page_num int, pos int, url string, title string")
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in PRODUCT.fields if f.name not in ("url", "title", "store_info")]
    return base.select("*", *extra, F.struct(F.lit("").alias("name"), F.lit("").alias("feedback"),
                                             F.lit("").alias("sales")).alias("store_info"))


def test_upsert_is_idempotent_and_scoped(spark):
    batch = products(spark, [("US", "a", 1, 0, "u1", "x"), ("US", "a", 1, 1, "u1", "y"),
                             ("US", "b", 1, 0, "u1", "z"), ("FR", "a", 1, 0, "u1", "w")])
    empty = batch.limit(0)
    once = appended(empty, batch)
    assert sorted((r.market, r.search_term, r.title) for r in once.collect()) == [
        ("FR", "a", "w"), ("US", "a", "x"), ("US", "b", "z")]
    assert new_products(batch, once).count() == 0
    market = appended(empty, batch, "market")
    assert sorted((r.market, r.title) for r in market.collect()) == [("FR", "w"), ("US", "x")]


def test_snapshot_detects_change(spark):
    a = products(spark, [("US", "a", 1, i, f"u{i}", "t") for i in range(5)])
    b = a.withColumn("title", F.when(F.col("url") == "u3", "new").otherwise(F.col("title")))
    assert not changed_since(a, a, ["market"]).first().changed
    assert changed_since(b, a, ["market"]).first().changed
    assert changed_since(a, a.limit(0), ["market"]).first().changed


def test_snapshot_replaces_changed_terms_only(spark, tmp_path):
    path = str(tmp_path / "snap")
    a = products(spark, [("US", t, 1, i, f"u{i}", "t") for t in "ab" for i in range(3)])
    write_snapshot(a, path)
    keys = ["market", "search_term"]
    b = a.withColumn("title", F.when((F.col("url") == "u1") & (F.col("search_term") == "b"), "new")
                     .otherwise(F.col("title")))
    rows = snapshot_rows(b, spark.read.parquet(path), keys)
    assert {r.search_term for r in rows.collect()} == {"b"}
    write_snapshot(rows, path)
    assert snapshot_rows(b, spark.read.parquet(path), keys).count() == 0


def test_failed_save_is_set_aside(spark, tmp_path):
    batch = products(spark, [("US", "a", 1, 0, "u1", "x")])
    path, at = str(tmp_path / "aside"), F.timestamp_seconds(F.lit(0))

    def fail():
        raise OSError("disk full")

    assert not save_or_quarantine(batch, fail, path, at)
    row = spark.read.parquet(path).first()
    assert (row.url, row.reason, row.quarantined_at) == ("u1", "OSError: disk full", "19700101_000000")
    assert save_or_quarantine(batch, lambda: None, path, at)


def test_envelope_round_trip(spark, tmp_path):
    rows = products(spark, [("US", "red hat", 1 + i // 4, i, f"u{i:02d}", f"é{i}") for i in range(11)])
    out = envelopes(rows, F.lit(20), F.timestamp_seconds(F.lit(0)), part_size=4)
    parts = out.orderBy("part").collect()
    assert [len(p.envelope.products) for p in parts] == [4, 4, 3]
    assert [x.url for p in parts for x in p.envelope.products] == [f"u{i:02d}" for i in range(11)]
    assert {p.envelope.total_products for p in parts} == {11}
    path = str(tmp_path / "store")
    write_envelopes(out, path)
    folder = tmp_path / "store" / "market=US" / "term_slug=bad"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text('{"products": [')
    (folder / "part-1.txt").write_text("")
    read = read_envelopes(spark, path)
    assert [r.term_slug for r in read.collect() if r.corrupt] == ["bad"]
    back = stored_products(read, ["term_slug"])
    assert sorted((r.term_slug, r.url, r.title) for r in back.collect()) == [
        ("red_hat", f"u{i:02d}", f"é{i}") for i in range(11)]


def test_verdict_order(spark):
    good = '<div class="x-item-title"></div><div class="x-price-section"></div>'
    pages = [("short", "x"), ("null", None), ("phrase", "This LISTING was ended robot check" + good),
             ("second", "Robot Check, Security Measure" + good), ("element", '<div class="x-item-title">' + "y" * 50),
             ("comment", "<!--" + good + "-->" + "y" * 50), ("fine", good + "y" * 50)]
    df = spark.createDataFrame([("GB", "product", n, h) for n, h in pages],
                               "market string, page_type string, name string, html string")
    got = {r.name: (r.verdict, r.blocked) for r in with_verdict(
        with_rules(df, market_rules(spark, min_length=20))).collect()}
    assert got == {
        "short": ("Content too short", False), "null": ("Content too short", False),
        "phrase": ("Error page detected: This listing was ended", False),
        "second": ("Error page detected: Security Measure", True),
        "element": ("Missing required element: div.x-price-section", False),
        "comment": ("Missing required element: div.x-item-title", False),
        "fine": ("Page content valid", False)}


def test_terms_and_caps(spark):
    df = spark.createDataFrame([("US", " a , ,b c", "5"), ("FR", "x", " "), ("GB", "y", "0")],
                               "market string, terms string, max_items string")
    assert [tuple(r) for r in search_terms(df).orderBy("market", "term_no").collect()] == [
        ("FR", 0, "x", None), ("GB", 0, "y", None), ("US", 0, "a", 5), ("US", 1, "", 5), ("US", 2, "b c", 5)]


def test_scalars(spark):
    one = spark.range(1)

    def val(c):
        return one.select(c).first()[0]

    assert val(X.strip(F.lit("　\x1f\xa0a b\xa0\n"))) == "a b"
    assert val(X.collapse(F.lit(" a\xa0\n b "))) == "a b"
    assert val(X.drop_trailing_dot(F.lit("a.."))) == "a."
    assert val(X.drop_trailing_dots(F.lit("a.."))) == "a"
    assert val(X.after_last_marker(F.lit("m: x m: y "), "m:")) == "y"
    assert val(X.first_percent(F.lit("5 or ٣% off"))) == "٣%"
    assert val(X.first_percent(F.lit("none"))) is None
    assert val(X.first_sentence(F.lit("abc"))) == "abc."
    assert val(U.item_id(F.lit("https://h/itm/12/itm/3?x"))) == "12/"
    assert val(U.item_id(F.lit("https://h/itm/12#f?x"))) == "12#f"
    assert val(U.quote_plus(F.lit("a b~*é&"))) == "a+b~%2A%C3%A9%26"
    assert val(X.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("z"))) == "z"


def test_positions_keep_rows_without_a_page(spark):
    rows = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("a", 1, 1)], "t string, page int, pos int")
    got = positioned(rows, ["t"], "page", ["pos"]).collect()
    assert sorted((r.seq, r.page, r.pos) for r in got) == [(1, None, 1), (2, None, 2), (3, 1, 1)]


def test_unreadable_caps_are_refused(spark):
    from pagemill.sources.terms import refused_requests, search_terms
    asked = spark.createDataFrame([("US", "a, b", "12 items"), ("US", "c", "5.0"), ("US", "d", " "), ("US", "e", "7"), ("US", "f", None)],
                                  "market string, terms string, max_items string")
    assert sorted((r.search_term, r.max_items) for r in search_terms(asked).collect()) == [("d", None), ("e", 7), ("f", None)]
    assert refused_requests(asked).count() == 2


def test_one_cap_for_a_repeated_term(spark):
    from pagemill.plans.pipeline import one_cap
    terms = spark.createDataFrame([("US", "a", 5), ("US", "a", 9), ("US", "b", 3), ("US", "b", None)],
                                  "market string, search_term string, max_items int")
    assert {r.search_term: r.max_items for r in one_cap(terms).collect()} == {"a": 9, "b": None}


def test_snapshot_folders_differ(spark, tmp_path):
    from pagemill.functions.text import folder_name
    terms = spark.createDataFrame([("a b",), ("a_b",), ("a%5Fb",)], "t string")
    assert terms.select(folder_name(F.col("t")).alias("f")).distinct().count() == 3


def test_shrunk_envelope_replaces_its_parts(spark, tmp_path):
    path, at = str(tmp_path / "store"), F.timestamp_seconds(F.lit(0))

    def save(rows):
        write_envelopes(envelopes(products(spark, rows), F.lit(20), at, part_size=2), path)

    save([("US", t, 1, i, f"{t}{i}", "t") for t in ("a b", "a_b") for i in range(6)])
    save([("US", "a b", 1, i, f"new{i}", "t") for i in range(2)])
    back = stored_products(read_envelopes(spark, path), ["term_slug", "part"]).collect()
    assert sorted(r.url for r in back) == ["a_b0", "a_b1", "a_b2", "a_b3", "a_b4", "a_b5", "new0", "new1"]
    assert sorted({r.part for r in back if r.url.startswith("a_b")}) == [0, 1, 2]
    assert {r.part for r in back if r.url.startswith("new")} == {None}


def test_vanished_terms_are_reported(spark):
    a = products(spark, [("US", t, 1, i, f"u{i}", "t") for t in "ab" for i in range(2)])
    got = changed_since(a.where("search_term = 'a'"), a, ["market", "search_term"]).collect()
    assert sorted((r.search_term, r.rows, r.changed) for r in got) == [("a", 2, False), ("b", 0, True)]


def test_the_first_request_keeps_a_product_of_several_terms(spark):
    rows = products(spark, [("US", "a", 1, 0, "u", "t"), ("US", "b", 9, 9, "u", "t")])
    asked = rows.withColumn("term_no", F.when(F.col("search_term") == "b", 0).otherwise(1))
    assert new_products(asked, rows.limit(0), "market").first().search_term == "b"
    assert new_products(rows, rows.limit(0), "market").first().search_term == "a"


@pytest.mark.parametrize("rows_per_slice, max_hot", [(10, 100_000), (10, 0), (10**6, 100_000)])
def test_hot_join_equals_join(spark, monkeypatch, rows_per_slice, max_hot):
    from pagemill.operators import sequence
    monkeypatch.setattr(sequence, "MAX_HOT_KEYS", max_hot)
    big = spark.range(200).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    small = spark.range(0, 150, 2).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    want = big.join(small, ["k"], "left")
    assert same_rows(sequence.hot_join(big, small, ["k"], F.col("id"), "left", rows_per_slice), want).first()[0]


def test_a_second_run_adds_nothing_and_names_failed_pages(spark):
    from pagemill.plans.pipeline import run
    from pagemill.schemas import CAPTURE
    from workload import render as R
    sf = "/root/testdata/sf0.001"
    captures = R.listing_captures(spark, sf).select(*CAPTURE.names).unionByName(
        R.search_captures(spark, sf).select(*CAPTURE.names))
    terms = captures.where("page_type = 'search'").select("market", "search_term", F.lit(None).cast("int").alias("max_items"))
    once = terms.distinct()
    first = run(captures, terms, R.rules(spark))  # every term is asked for many times
    assert first.stored.count() > 0
    assert first.stored.select("market", "search_term", "url").distinct().count() == first.stored.count()
    down = captures.withColumn("status", F.when((F.col("market") == "GB") & (F.col("page_type") == "search"), 503)
                               .otherwise(F.col("status")))
    second = run(down, once, R.rules(spark), store=first.stored)
    assert second.stored.count() == 0
    errors = {(r.market == "GB", r.error) for r in second.summary.collect()}
    assert errors == {(True, "status 503"), (False, None)}
    lost = second.rejects.where("page_type = 'search'")
    assert lost.count() == captures.where("page_type = 'search' and market = 'GB'").count()
    assert {r.outcome for r in lost.select("outcome").distinct().collect()} == {"pending"}


def test_links_are_found_once(spark):
    """An inner explode puts its array into filters below it, each of which finds the links again."""
    from workload import queries as Q
    plan = Q._links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_ordered_links_sort_a_written_table(spark):
    """A range sort reads its input twice."""
    from workload import queries as Q
    plan = Q.q_ordered_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "parse_page" not in plan


def test_tree_join_sorts_titles_and_spans_only(spark):
    from workload import queries as Q
    plan = Q.q_tree_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate inline")[0]
    assert "Window" in above and "span" in above and "attrs" not in above
