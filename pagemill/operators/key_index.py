"""A key index of the store: which keys it holds, without reading the store.

Keys lie in hash buckets, a folder each.  Beside them lie Bloom filters, cut into blocks of 4 KB: a key belongs to one block
and sets ``BITS`` bits of it, so a filter is built by aggregation and asked by one join.  A batch asks the filters of its
buckets first and opens only the buckets where one of its keys may be.  Every append is a version of its own; a manifest names
the versions in force and is committed last, so an append that is stopped changes nothing and its repeat replaces what it left.
Many small versions are folded into larger ones by size, which writes a key again a number of times that grows with the
logarithm of the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.links import unseen
from pagemill.session import work_dir

# Bits that a key sets, and bits of a block (what one bitmap aggregate holds).
BITS = 4
BLOCK_BITS = 32768
# Keys that a block is meant for: about ten bits each.
KEYS_PER_BLOCK = 3000
# Versions after which an append folds small ones.
FOLD_AFTER = 8

_SHAPE = "keys string, buckets int, blocks int"
_MANIFEST = "version int, n_keys bigint"


def open_key_index(spark: SparkSession, path: str, keys: list[str], buckets: int = 256, expected_keys: int = 10_000_000) -> None:
    """An empty index of ``keys`` (text columns).  More keys than expected cost more opened buckets, never a wrong answer."""
    blocks = max(1, -(-expected_keys // (KEYS_PER_BLOCK * buckets)))
    spark.createDataFrame([(",".join(keys), buckets, blocks)], _SHAPE).write.mode("overwrite").parquet(f"{path}/shape")
    _commit(spark, path, 0, [])


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        names, self.buckets, self.blocks = spark.read.schema(_SHAPE).parquet(f"{path}/shape").first()
        self.keys = names.split(",")
        self.version = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
        # One row a version in force; folding keeps them few.
        live = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/at={self.version}").collect()
        self.live = sorted((r.version, r.n_keys) for r in live)

    def _read(self, kind: str, columns: list[T.StructField], buckets: list[int] | None, versions: list[int] | None = None) -> DataFrame:
        """Rows of the versions in force; ``buckets`` prunes the folders that are opened."""
        schema = T.StructType([*columns, T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        versions = [v for v, _ in self.live] if versions is None else versions
        if not versions or buckets == []:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}").where(F.col("version").isin(versions))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def stored_keys(self, buckets: list[int] | None = None, versions: list[int] | None = None) -> DataFrame:
        """The keys of some (default: all) buckets."""
        return self._read("keys", [T.StructField(k, T.StringType()) for k in self.keys], buckets, versions)

    def filters(self, buckets: list[int] | None = None, versions: list[int] | None = None) -> DataFrame:
        """One row a block: the bits set in any of the versions."""
        columns = [T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType())]
        return self._read("filters", columns, buckets, versions).groupBy("bucket", "block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of ``rows`` with their bucket and block."""
        block = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets * self.blocks))
        return (rows.select(*[F.col(k).cast("string").alias(k) for k in self.keys]).distinct()
                .withColumn("block", block).withColumn("bucket", F.floor(F.col("block") / self.blocks).cast("int")))

    def positions(self) -> Column:
        """The bits of a key within its block."""
        h = F.xxhash64(*self.keys, F.lit("bits"))
        return F.array(*[F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(BITS)])

    def suspects(self, batch: DataFrame) -> DataFrame:
        """The distinct keys of ``batch`` with ``maybe``: whether all their bits are set.  Written, as it is read three times."""
        placed = _staged(self.placed(batch), "key-batch")
        asked = _numbers(placed, "bucket")
        bits = F.transform(self.positions(), lambda p: _bit(F.col("bits"), p))
        found = placed.join(self.filters(asked), ["bucket", "block"], "left")
        return _staged(found.withColumn("maybe", F.coalesce(F.forall(bits, lambda b: b == 1), F.lit(False))).drop("bits"), "key-suspects")

    def known(self, suspects: DataFrame) -> DataFrame:
        """The suspects that the index does hold; only their buckets are opened."""
        maybe = suspects.where("maybe")
        opened = self.stored_keys(_numbers(maybe, "bucket")).select(*self.keys, "bucket")
        return maybe.select(*self.keys, "bucket").join(opened, [*self.keys, "bucket"], "left_semi").select(*self.keys)

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose key the index does not hold; a key with a null part is never held, as in a join."""
        return unseen(batch, self.known(self.suspects(batch)), self.keys)

    def append(self, batch: DataFrame) -> "KeyIndex":
        """The index with the keys of ``batch``; one that holds them all stays as it is.  Keys with a null part are left out."""
        suspects = self.suspects(batch.dropna(subset=self.keys))
        fresh = _staged(suspects.join(self.known(suspects), self.keys, "left_anti").drop("maybe"), "key-new")
        n = fresh.count()
        if not n:
            return self
        version = self.version + 1
        self._write(fresh, version)
        _commit(self.spark, self.path, version, [*self.live, (version, n)])
        grown = KeyIndex(self.spark, self.path)
        return grown.fold() if len(grown.live) > FOLD_AFTER else grown

    def fold(self) -> "KeyIndex":
        """The newest versions as one: as many as are together at least half as large as the next older one."""
        taken, n = [], 0
        for version, size in reversed(self.live):
            if len(taken) > 1 and n < size / 2:
                break
            taken.append(version)
            n += size
        if len(taken) < 2:
            return self
        version = self.version + 1
        self._write(self.stored_keys(versions=taken).drop("version"), version, self.filters(versions=taken))
        _commit(self.spark, self.path, version, [*[v for v in self.live if v[0] not in taken], (version, n)])
        return KeyIndex(self.spark, self.path)

    def _write(self, keyed: DataFrame, version: int, filters: DataFrame | None = None) -> None:
        """Keys and filters of one version, a file a bucket; hashing keeps buckets even whatever the keys are."""
        if filters is None:
            filters = (keyed.select("bucket", "block", F.explode(self.positions()).alias("_at"))
                       .groupBy("bucket", "block").agg(F.bitmap_construct_agg("_at").alias("bits")))
        for kind, rows in (("keys", keyed.select(*self.keys, "bucket")), ("filters", filters.select("block", "bits", "bucket"))):
            (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
             .partitionBy("bucket").parquet(f"{self.path}/{kind}/version={version}"))


def _bit(bits: Column, at: Column) -> Column:
    """Bit ``at`` of a bitmap; 0 where there is none."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2, F.lit(0))


def _numbers(rows: DataFrame, column: str) -> list[int]:
    """The buckets that ``rows`` fall in: at most as many as the index has."""
    return sorted(r[0] for r in rows.select(column).distinct().collect())


def _staged(rows: DataFrame, name: str) -> DataFrame:
    path = work_dir(rows.sparkSession, name) + "/table"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _commit(spark: SparkSession, path: str, version: int, live: list[tuple[int, int]]) -> None:
    """The manifest first, then its number: from here on the version is in force."""
    (spark.createDataFrame(live, _MANIFEST).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .parquet(f"{path}/manifest/at={version}"))
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{path}/versions")
