"""The envelope data source: terms replaced whole, killed writes, broken and empty documents, splits, pruned listings."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators.store import envelopes
from pagemill.sources.envelope_source import FORMAT, document_rows, read_terms, register, replace_terms
from pagemill.sources.store_io import stored_products
from tests.test_operators import products


def documents(spark, market, term, urls, part_size=2):
    rows = products(spark, [(market, term, 1, i, u, f"é{u}") for i, u in enumerate(urls)])
    return document_rows(envelopes(rows, F.lit(9), F.timestamp_seconds(F.lit(0)), part_size=part_size))


def stored(spark, path, **options):
    return sorted((r.market, r.term_slug, r.part, r.url, r.title) for r in
                  stored_products(read_terms(spark, path, **options), ["market", "term_slug", "part"]).collect())


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".json") or f.startswith("."))


def test_a_term_is_replaced_whole_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "my store")
    replace_terms(documents(spark, "US", "red hat", "abcde").unionByName(documents(spark, "UK", "red_hat", "f")), path)
    assert stored(spark, path) == [("UK", "red%5Fhat", 0, "f", "éf")] + [
        ("US", "red_hat", i // 2, u, f"é{u}") for i, u in enumerate("abcde")]
    replace_terms(documents(spark, "US", "red hat", "xa"), path)
    expected = [("UK", "red%5Fhat", 0, "f", "éf"), ("US", "red_hat", 0, "a", "éa"), ("US", "red_hat", 0, "x", "éx")]
    assert stored(spark, path) == expected
    row = read_terms(spark, path).where("market = 'US'").first()
    assert (row.total_products, row.requested_items, row.corrupt) == (2, 9, None)


def test_a_killed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    replace_terms(documents(spark, "US", "a", "pqr").unionByName(documents(spark, "UK", "b", "s")), path)
    before, there = stored(spark, path), files(path)
    bad = documents(spark, "US", "a", "tuvwxyz", part_size=1).unionByName(documents(spark, "UK", "b", "s")).withColumn(
        "value", F.when(F.col("part") == 6, F.raise_error(F.lit("disk full")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="disk full"):
        replace_terms(bad, path)
    assert stored(spark, path) == before
    assert files(path) == there  # the abort removed what the tasks had written


def test_remains_of_a_write_without_marker_never_show_and_go_when_old(spark, tmp_path):
    path = tmp_path / "store"
    replace_terms(documents(spark, "US", "a", "p"), str(path))
    folder = path / "market=US" / "term_slug=a"
    lost = [folder / f"{c * 32}-0.json" for c in "ab"]
    for f in lost:
        f.write_text('{"products": []}')
    past = time.time() - 3 * 86400
    draft = folder / ".half"
    draft.write_text("{")
    for f in (lost[0], draft):
        os.utime(f, (past, past))
    assert [r[3] for r in stored(spark, str(path))] == ["p"]
    replace_terms(documents(spark, "US", "a", "q"), str(path))
    assert [r[3] for r in stored(spark, str(path))] == ["q"]
    assert [f.exists() for f in lost] == [False, True] and not draft.exists()  # the younger one may belong to a write that still runs
    replace_terms(documents(spark, "US", "a", "r"), str(path))
    assert len(files(path)) == 3  # the live one, the one before it and the young remains


def test_broken_empty_and_missing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stored(spark, path) == []
    given = spark.createDataFrame([("US", "broken", 0, '{"products": [{"url": "x"'), ("US", "empty", 0, ""), ("US", "null", 0, None),
                                   ("US", "blank", 0, " \n "), (None, "no market", 0, '{"products": []}')],
                                  "market string, term_slug string, part bigint, value string")
    replace_terms(given, path)
    assert sorted((r.market or "", r.term_slug, r.corrupt) for r in read_terms(spark, path).collect()) == [
        ("", "no market", None), ("US", "broken", '{"products": [{"url": "x"')]
    assert stored(spark, path) == []
    replace_terms(given.limit(0), path)
    assert read_terms(spark, path).count() == 2
    with pytest.raises(Exception, match="append"):
        given.write.format(FORMAT).mode("overwrite").save(path)


def test_splits_are_bounded_and_options_prune_the_listing(spark, tmp_path):
    path = str(tmp_path / "store")
    replace_terms(documents(spark, "US", "a", "pqrs", part_size=1).unionByName(documents(spark, "UK", "b", "t")), path)
    register(spark)
    whole = spark.read.format(FORMAT).load(path)
    assert spark.read.format(FORMAT).option("splitBytes", 1).load(path).rdd.getNumPartitions() >= 5
    assert whole.rdd.getNumPartitions() == 1
    assert stored(spark, path, splitBytes=1) == stored(spark, path)
    one = spark.read.format(FORMAT).option("splitBytes", 1).option("market", "UK").load(path)
    assert (one.rdd.getNumPartitions(), [(r.market, r.term_slug) for r in one.collect()]) == (1, [("UK", "b")])
    assert read_terms(spark, path, market="US", termSlug="a").count() == 4
    assert read_terms(spark, path, termSlug="b").count() == 1
    assert read_terms(spark, path, market="UK", termSlug="a").count() == 0
