"""Stream results equal batch results, also after a replayed batch."""

import datetime
import time

from pyspark.sql import functions as F

from pagemill.operators.store import keep_first, same_rows
from pagemill.schemas import CAPTURE
from pagemill.streaming import flow
from pagemill.streaming.links import linked_products
from pagemill.streaming.state import PROVIDER, capped_stream, keyed_state
from workload import render as R

SF = "/root/testdata/sf0.001"


def test_replayed_batch_changes_nothing(spark, tmp_path):
    captures = R.listing_captures(spark, SF).drop("item")
    products = flow.product_stream(captures, R.rules(spark))
    batch = products.unionByName(products).where(F.col("market").isin("US", "FR"))
    store = str(tmp_path / "store")
    flow.open_store(spark, store)
    write = flow.upsert_to(store)
    write(batch.where("market = 'US'"), 0)
    write(batch, 1)
    first = [tuple(r) for r in flow.read_store(spark, store).orderBy("market", "url").collect()]
    write(batch, 1)
    assert first == [tuple(r) for r in flow.read_store(spark, store).orderBy("market", "url").collect()]
    want = keep_first(batch.select(*flow.KEEP, "title"), ["market", "search_term", "url"],
                      ["page_num", "pos"])
    got = flow.read_store(spark, store).select(*flow.KEEP, "title")
    assert same_rows(got, want).first()[0]


def test_a_replay_sets_nothing_aside_twice(spark, tmp_path):
    captures = R.listing_captures(spark, SF).drop("item", "pos", "page_num")
    bad = captures.withColumn("status", F.when(F.col("market") == "US", 500).otherwise(F.col("status")))
    batch = flow.product_stream(bad, R.rules(spark), rejects=True)
    store, aside = str(tmp_path / "store"), str(tmp_path / "aside")
    flow.open_store(spark, store)
    write = flow.upsert_to(store, quarantine_path=aside)
    write(batch, 0)
    write(batch, 0)
    left = spark.read.parquet(aside)
    assert left.count() + flow.read_store(spark, store).count() == captures.count()
    assert {r.reason for r in left.where("market = 'US'").collect()} == {"status 500"}


def test_a_failing_batch_has_its_own_folder(spark, tmp_path):
    products = flow.product_stream(R.listing_captures(spark, SF).drop("item").where("market = 'FR'"), R.rules(spark))
    aside = str(tmp_path / "aside")
    write = flow.upsert_to(str(tmp_path / "no" / "store"), quarantine_path=aside)  # never opened
    for _ in range(2):
        write(products, 3)
    assert spark.read.parquet(aside).count() == products.count()


def test_pages_of_one_file_go_to_many_tasks(spark, tmp_path):
    empty = {f.name: F.lit(None).cast(f.dataType) for f in CAPTURE.fields}
    held = {"market": F.lit("US"), "page_type": F.lit("product"), "status": F.lit(404),
            "url": F.concat(F.lit("/itm/"), F.col("id").cast("string"))}
    captures = spark.range(200).select(*[held.get(n, c).alias(n) for n, c in empty.items()])
    captures.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = []
    stream = flow.product_stream(spark.readStream.schema(CAPTURE).parquet(str(tmp_path / "in")), R.rules(spark), rejects=True)
    (stream.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.select("url", "reason", F.spark_partition_id()).collect()))
     .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r[0] for r in rows) == sorted(f"/itm/{i}" for i in range(200))
    assert {r[1] for r in rows} == {"status 404"}
    assert len({r[2] for r in rows}) > 1


def test_old_keys_leave_the_state(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "url string, captured_at timestamp"
    days = [("a", 0), ("b", 0), ("a", 1), ("c", 30), ("d", 60), ("d", 61)]
    rows = spark.createDataFrame(days, "url string, day int").select(
        "url", F.timestamp_seconds((F.col("day") + 20_000) * 86400).alias("captured_at"), F.col("day").alias("_d"))
    for low, high in [(0, 1), (30, 31), (60, 62)]:
        rows.where(F.col("_d").between(low, high)).drop("_d").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    query = (flow.first_seen(stream, ["url"]).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
    assert query.lastProgress.stateOperators[0].numRowsTotal < 4


def stream_of(spark, path, schema, steps, run):
    """Run a stream after each step of rows (a list of tuples) has arrived; ``run(stream)`` starts it."""
    query = None
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        query = run(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
        query.awaitTermination()
    return query


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_links_wait_for_products_and_misses_come_out(spark, tmp_path):
    schema = "kind string, market string, search_term string, page_num int, pos int, url string, at timestamp, title string"
    link = lambda url, d, term="t": ("link", "US", term, 1, 0, url, day(d), None)
    item = lambda url, d: ("item", "US", None, None, None, url, day(d), f"title {url}")
    beat = [("link", "XX", "t", 1, 0, "beat", day(90), None), ("item", "XX", None, None, None, "other", day(90), None)]
    steps = [[link("a", 0), link("b", 0), link("b", 1, "u"), link("late", 0), item("c", 1)],
             [item("a", 1), link("c", 2), item("b", 2), item("late", 9)], beat, [link("a", 91)]]
    out = str(tmp_path / "out")

    def run(stream):
        links = stream.withWatermark("at", "2 days").where("kind = 'link'").select(
            "market", "search_term", "page_num", "pos", "url", F.col("at").alias("linked_at"))
        items = stream.withWatermark("at", "2 days").where("kind = 'item'").select("market", "url", F.col("at").alias("seen_at"), "title")
        joined = linked_products(links, items, early="1 day", late="3 days", slices=2)
        return (joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
                .trigger(availableNow=True).start())

    query = stream_of(spark, str(tmp_path / "in"), schema, steps, run)
    got = {(r.url, r.search_term, r.title, r.missing) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "t", "title a", False), ("b", "t", "title b", False), ("b", "u", "title b", False),
                   ("c", "t", "title c", False), ("late", "t", None, True)}
    # What is left waits around day 90: two links, and one product in each slice.
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 4


PLACED = "market string, search_term string, page_num int, pos int, url string, captured_at timestamp, title string"


def capped(spark, tmp_path, steps, ttl, caps, wait=0.0):
    out = str(tmp_path / "out")
    limits = spark.createDataFrame(caps, "market string, search_term string, max_items int")

    def run(stream):
        time.sleep(wait)
        kept = capped_stream(stream, limits, "r1", ttl)
        with keyed_state(spark):
            # State that expires asks for another batch for ever, so such a stream ends after one.
            return (kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
                    .trigger(**{"availableNow" if ttl is None else "once": True}).start())

    before = spark.conf.get(PROVIDER, None)
    stream_of(spark, str(tmp_path / "in"), PLACED, steps, run)
    assert spark.conf.get(PROVIDER, None) == before
    return sorted((r.search_term, r.page_num, r.pos, r.url, r.title) for r in spark.read.parquet(out).collect())


def test_caps_and_seen_addresses_as_state(spark, tmp_path):
    row = lambda term, page, pos, url: ("US", term, page, pos, url, day(page or 0), f"{url} {page}")
    steps = [[row("two", 2, 0, "c"), row("two", 1, 1, "b"), row("two", 1, 0, "a"), row("two", 3, 0, "a"), row("all", 1, 0, "a"), row("all", 1, 3, "a")],
             [row("two", 1, 9, "d"), row("all", 2, 0, "a"), row("all", 2, 1, "e"), row("one", 1, 0, "x")],
             [row("one", 1, 1, "y"), row("one", None, 1, "z"), row("none", 1, 0, "q")]]
    got = capped(spark, tmp_path, steps, None, [("US", "two", 2), ("US", "all", 0), ("US", "one", 1)])
    assert got == [("all", 1, 0, "a", "a 1"), ("all", 2, 1, "e", "e 2"), ("none", 1, 0, "q", "q 1"), ("one", 1, 0, "x", "x 1"),
                   ("two", 1, 0, "a", "a 1"), ("two", 1, 1, "b", "b 1")]


def test_seen_addresses_expire(spark, tmp_path):
    row = ("US", "t", 1, 0, "a", day(0), "a")
    assert len(capped(spark, tmp_path, [[row], [row]], 1, [("US", "t", None)], wait=3.0)) == 2
