"""Snapshots that delete, saves that repeat, and an account of every capture."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.markup import attribute, with_elements
from pagemill.functions.select import first_where, is_tag
from pagemill.operators.snapshot import latest_version, manifest, open_snapshot, read_snapshot, sync_snapshot
from pagemill.plans import pipeline
from pagemill.plans.pipeline import run, save_run
from pagemill.schemas import CAPTURE, PRODUCT
from workload import render as R
from workload.queries import QUERIES, _all_captures, _caps

SF = "/root/testdata/sf0.001"


def products(spark, rows):
    text = ", ".join(f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in PRODUCT.fields if f.name not in ("url", "title"))
    return spark.createDataFrame(rows, "market string, search_term string, url string, title string").selectExpr("*", *text.split(", "))


def snapshot_rows(spark, path):
    return sorted(((r.market or "", r.search_term or "", r.url, r.title) for r in read_snapshot(spark, path).collect()))


def test_sync_writes_changed_buckets_only(spark, tmp_path):
    path = str(tmp_path / "snap")
    open_snapshot(spark, path)
    assert read_snapshot(spark, path).count() == 0
    first = [("US", t, f"u{i}", "x") for t in ("a", "b", "gone") for i in range(40)] + [(None, None, "n", "x")]
    kinds = lambda df: sorted((r.market or "", r.search_term or "", r.kind) for r in df.collect())
    assert kinds(sync_snapshot(products(spark, first), path, 16)) == [("", "", "added"), ("US", "a", "added"), ("US", "b", "added"), ("US", "gone", "added")]
    assert snapshot_rows(spark, path) == sorted((m or "", t or "", u, x) for m, t, u, x in first)
    # Same rows in another order: nothing differs, nothing is written.
    assert kinds(sync_snapshot(products(spark, first[::-1]), path, 16)) == [] and latest_version(spark, path) == 1

    second = [(m, t, u, "new" if (t, u) == ("a", "u3") else x) for m, t, u, x in first if t != "gone" and (t, u) != ("b", "u5")] + [("FR", "c", "v", "x")]
    assert kinds(sync_snapshot(products(spark, second), path, 16)) == [("FR", "c", "added"), ("US", "a", "changed"), ("US", "b", "changed"), ("US", "gone", "removed")]
    assert snapshot_rows(spark, path) == sorted((m or "", t or "", u, x) for m, t, u, x in second)
    written = manifest(spark, path).where("written = 2").groupBy("search_term").count().collect()
    assert {r.search_term: r["count"] for r in written}.get("a") == 1 and "gone" not in {r.search_term for r in manifest(spark, path).collect()}
    assert spark.read.parquet(path + "/rows/version=2").where("search_term in ('a', 'b')").select("search_term", "bucket").distinct().count() <= 2

    # A sync stopped before its manifest: the version before it stays in force, and repeating it mends it.
    spark.read.parquet(path + "/rows/version=2").write.parquet(path + "/rows/version=3")
    assert snapshot_rows(spark, path) == sorted((m or "", t or "", u, x) for m, t, u, x in second)
    sync_snapshot(products(spark, first), path, 16)
    assert snapshot_rows(spark, path) == sorted((m or "", t or "", u, x) for m, t, u, x in first)
    sync_snapshot(products(spark, []), path, 16)
    assert snapshot_rows(spark, path) == [] and latest_version(spark, path) == 4


def test_every_capture_has_one_fate(spark, tmp_path):
    listings = R.listing_captures(spark, SF).select(*CAPTURE.names)
    searches = R.search_captures(spark, SF).select(*CAPTURE.names).where("market <> 'FR'")  # so nothing links to listings there
    lost = listings.where("url like '%1'").withColumn("page_type", F.lit("odd"))
    captures = listings.unionByName(listings.limit(20)).unionByName(searches).unionByName(searches.where("page_num = 1")).unionByName(lost)
    result = run(captures, _caps(spark, SF).withColumn("max_items", F.lit(1)), R.rules(spark))
    fates = {r.fate: r["count"] for r in result.account.groupBy("fate").count().collect()}
    assert sum(fates.values()) == captures.count()
    assert {"stored", "beyond cap", "not linked", "repeat", "read", "page not reached", "unknown page type"} <= set(fates)
    assert fates["stored"] <= result.stored.count() and fates["unknown page type"] == lost.count()

    store, aside = str(tmp_path / "store"), str(tmp_path / "aside")
    for _ in range(2):
        save_run(result, store, aside, "a")
    assert spark.read.parquet(store).count() == result.stored.count() and spark.read.parquet(aside).count() == result.rejects.count()
    again = run(captures, _caps(spark, SF).withColumn("max_items", F.lit(1)), R.rules(spark), "market", store=spark.read.parquet(store))
    assert again.account.where("fate = 'already stored'").count() > 0 and again.account.count() == captures.count()


def test_runs_over_the_same_captures_share_what_was_parsed(spark, monkeypatch):
    captures = R.listing_captures(spark, SF).select(*CAPTURE.names).unionByName(R.search_captures(spark, SF).select(*CAPTURE.names))
    terms, rules = _caps(spark, SF), R.rules(spark)
    read, checked_pages = [], pipeline.checked_pages
    monkeypatch.setattr(pipeline, "checked_pages", lambda *a: read.append(a[2]) or checked_pages(*a))
    parsed = pipeline.parse_captures(captures, rules)
    had = parsed.products.where("is_valid and title like '%1 & more%'").select("market", "search_term", "url")
    shared, own = run(captures, terms, rules, "market", had, parsed), run(captures, terms, rules, "market", had)
    assert read == ["search", "product"] * 2
    for part in ("pages", "stored", "rejects", "summary", "account"):
        a, b = (sorted(map(repr, getattr(r, part).collect())) for r in (shared, own))
        assert a == b and (a or part == "rejects")
    parsed.unstage()
    read.clear()
    assert QUERIES["q_run_saved_twice"](spark, SF).count() > 0 and read == ["search", "product"]


@pytest.mark.parametrize("value, want", [
    ("a&#x2F;b&eacute;&nbsp;c&#47;itm/1", "a/bé\xa0c/itm/1"), ("?a=1&amp;copy=2&copy=3", "?a=1&copy=2&copy=3"),
    ("&amp;quot;&quot;&#39;&lt;", "&quot;\"'<"), ("&unknown;&#65&", "&unknown;A&")])
def test_references_in_attributes(spark, value, want):
    page = spark.createDataFrame([(f'<a href="{value}" id=x>t</a>',)], "html string")
    got = with_elements(page).withColumn("_a", first_where(F.col("els"), is_tag("a"))).select(
        attribute(F.col("_a.attrs"), "href").alias("href"), attribute(F.col("_a.attrs"), "id").alias("id")).first()
    assert (got.href, got.id) == (want, "x")
