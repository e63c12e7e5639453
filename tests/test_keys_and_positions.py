"""The key index, running totals, positions by a range sort, and containment over rows."""

import glob
import random

from pyspark.sql import functions as F

from pagemill.operators.containment import nearest_above
from pagemill.operators.key_index import FOLD_AFTER, KeyIndex, open_key_index
from pagemill.operators.sequence import ranked
from pagemill.operators.store import store_totals
from pagemill.operators.totals import add_batch, fold_batches, running_totals

KEYS = ["market", "url"]


def rows(spark, numbers, market="US"):
    return spark.createDataFrame([(market, f"u{n}", n) for n in numbers], "market string, url string, n int")


def numbers(df):
    return sorted(r.n for r in df.collect())


def test_index_tells_new_rows(spark, tmp_path):
    path = str(tmp_path / "index")
    open_key_index(spark, path, KEYS, buckets=8, expected_keys=1000)
    index = KeyIndex(spark, path)
    assert numbers(index.new_rows(rows(spark, [1, 1, 2]))) == [1, 1, 2]  # empty index; repeats stay
    index = index.append(rows(spark, range(100)))
    index = index.append(rows(spark, range(50, 150)))
    assert [n for _, n in index.live] == [100, 50]
    assert numbers(index.new_rows(rows(spark, range(140, 160)))) == list(range(150, 160))
    assert numbers(index.new_rows(rows(spark, range(5), "FR"))) == list(range(5))
    # Null parts never match, empty batches and known ones change nothing.
    none = spark.createDataFrame([(None, "u1", 1)], "market string, url string, n int")
    assert numbers(index.new_rows(none)) == [1] and index.append(none).version == index.version
    assert index.append(rows(spark, range(150))).version == index.version
    assert index.new_rows(rows(spark, range(150)).where("n < 0")).count() == 0
    # An append that stopped before its commit is as if it had never been, and its repeat replaces it.
    index._write(index.placed(rows(spark, [900])), index.version + 1)
    assert numbers(KeyIndex(spark, path).new_rows(rows(spark, [900]))) == [900]
    index = KeyIndex(spark, path).append(rows(spark, [901]))
    assert numbers(index.new_rows(rows(spark, [900, 901]))) == [900]


def test_a_batch_opens_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "index")
    open_key_index(spark, path, KEYS, buckets=32, expected_keys=100_000)
    index = KeyIndex(spark, path).append(rows(spark, range(2000)))
    batch = rows(spark, [3, 4, 5_000_000])
    mine = {r.bucket for r in index.placed(batch.where("n < 9")).collect()}
    theirs = [f for f in glob.glob(f"{path}/keys/version=1/bucket=*/*.parquet") if int(f.split("bucket=")[1].split("/")[0]) not in mine]
    assert len(theirs) >= 28
    for file in theirs:  # whoever opens one of these fails
        with open(file, "wb") as out:
            out.write(b"no table")
        with open(file.replace("part-", ".part-") + ".crc", "wb") as out:
            out.write(b"")
    assert numbers(index.new_rows(batch)) == [5_000_000]
    # Of unknown keys nearly all are told by the filters, so next to nothing is opened for them.
    strange = index.suspects(rows(spark, range(10_000, 12_000)))
    assert strange.where("maybe").count() < 60


def test_small_versions_are_folded(spark, tmp_path):
    path = str(tmp_path / "index")
    open_key_index(spark, path, KEYS, buckets=2, expected_keys=10)
    index = KeyIndex(spark, path).append(rows(spark, range(1000)))
    for i in range(FOLD_AFTER):
        index = index.append(rows(spark, range(1000 + 10 * i, 1010 + 10 * i)))
    assert [n for _, n in index.live] == [1000, 10 * FOLD_AFTER]
    assert index.stored_keys().count() == 1000 + 10 * FOLD_AFTER
    assert numbers(index.new_rows(rows(spark, range(990, 1100)))) == list(range(1000 + 10 * FOLD_AFTER, 1100))


def test_running_totals_merge(spark, tmp_path):
    rnd = random.Random(3)
    data = [(rnd.choice(["US", "FR", None]), rnd.choice([rnd.randrange(100), 40_000 + rnd.randrange(50), 10 ** 12])) for _ in range(600)]
    df = spark.createDataFrame([(m, f"/itm/{n}", n, i % 3) for i, (m, n) in enumerate(data)], "market string, url string, item bigint, b int")
    path = str(tmp_path / "parts")
    for b in (0, 1, 2, 1):
        add_batch(df.where(F.col("b") == b), path, b, ["market"], F.col("item"))
    fold_batches(spark, path, str(tmp_path / "folded"), ["market"])
    key = lambda r: str(r.market)
    want = sorted(store_totals(df, ["market"]).collect(), key=key)
    for at in ("parts", "folded"):
        assert sorted(running_totals(spark, str(tmp_path / at), ["market"]).collect(), key=key) == want
    add_batch(df.limit(1).withColumn("item", F.lit(-1)), path, 3, ["market"], F.col("item"))  # no number: a row, not an address
    more = running_totals(spark, path, ["market"]).agg(F.sum("total_products"), F.sum("distinct_urls")).first()
    assert tuple(more) == (sum(r.total_products for r in want) + 1, sum(r.distinct_urls for r in want))
    add_batch(df.limit(0), path, 4, ["market"], F.col("item"))
    assert running_totals(spark, path, ["market"]).count() == 3


def test_ranked_spreads_a_hot_group(spark):
    rnd = random.Random(5)
    data = [("hot" if i % 3 == 0 else rnd.choice(["a", "b", None]), rnd.choice([None, *range(900)]), i) for i in range(6000)]
    df = spark.createDataFrame(data, "term string, page int, pos int").repartition(7)
    caps = spark.createDataFrame([("hot", 5), ("a", 7)], "term string, max_items int")
    got = ranked(df, ["term"], ["page", "pos"], per_group=caps)
    place, n, want = lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2]), {}, []
    for term, page, pos in sorted(data, key=place):
        n[term] = n.get(term, 0) + 1
        want.append((term, page, pos, {"hot": 5, "a": 7}.get(term), n[term]))
    assert sorted(map(tuple, got.collect()), key=lambda r: place(r)) == want
    # The hot group is sorted by several tasks.
    dealt = df.repartitionByRange(4, "term", "page", "pos").where("term = 'hot'").select(F.spark_partition_id().alias("t"))
    assert dealt.distinct().count() >= 2
    assert ranked(df.limit(0), ["term"], ["pos"]).count() == 0
    same = ranked(spark.createDataFrame([("x", 1)] * 5, "term string, pos int"), ["term"], ["pos"])
    assert sorted(r.seq for r in same.collect()) == [1, 2, 3, 4, 5]


def test_nearest_above_by_brute_force(spark):
    rnd = random.Random(9)
    data = []
    for page in [None, *range(12)]:
        parent, children = [None], {0: []}
        for eid in range(1, rnd.randrange(2, 60)):
            # The next element opens below one that is still open.
            line = [eid - 1]
            while parent[line[-1]] is not None:
                line.append(parent[line[-1]])
            parent.append(rnd.choice(line))
        last = list(range(len(parent)))
        for eid in range(len(parent) - 1, 0, -1):
            last[parent[eid]] = max(last[parent[eid]], last[eid])
        data += [(page, e, last[e], rnd.random() < 0.4, f"x{e}") for e in range(len(parent))]
    df = spark.createDataFrame(data, "page int, eid int, last int, box boolean, _row string")
    got = {(r.page, r.eid): r.above for r in nearest_above(df.unionByName(df), ["page"], F.col("box")).collect()}
    want = {(p, e): max((o for q, o, end, box, _ in data if q == p and box and o < e <= end), default=None) for p, e, _, _, _ in data}
    assert got == want
