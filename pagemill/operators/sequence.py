"""Order-dependent operators without a task per group.

``row_number() over (partition by term order by page, pos)`` puts a whole search
term into one task, and one term may hold a third of all rows.  A position is
instead the sum of three parts, each from a window of bounded size:

* the row's place within its search page (a page is one document),
* the rows on earlier pages of the same block of ``PAGE_BLOCK`` pages,
* the rows in earlier blocks of the term (at most 2**31 / PAGE_BLOCK blocks).

The last two come from per-page counts, which are combined on the map side.

:func:`ranked` gets the same from one range sort that is written, and is the one to take where rows may be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import work_dir

PAGE_BLOCK = 1024


def positioned(rows: DataFrame, group: list[str], page: str, order: list[str],
               name: str = "seq") -> DataFrame:
    """Add the 1-based position of each row in ``group`` by (page, order).

    ``rows`` is read twice; hand in a table that is cheap to read (a staged one,
    or a narrow projection), not an extraction.  Rows without a page come first, as page 0.
    """
    wanted = [*rows.columns, name]
    rows = rows.withColumn("_page", F.coalesce(F.col(page), F.lit(0)))
    page = "_page"
    block = F.floor(F.col(page) / PAGE_BLOCK)
    per_page = rows.groupBy(*group, page).agg(F.count(F.lit(1)).alias("_rows"))
    per_block = (per_page.groupBy(*group, block.alias("_block"))
                 .agg(F.sum("_rows").alias("_rows")))

    def before(*keys: str, by: str) -> Column:
        window = (Window.partitionBy(*keys).orderBy(by)
                  .rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.sum("_rows").over(window), F.lit(0))

    block_start = per_block.select(
        *group, "_block", before(*group, by="_block").alias("_block_start"))
    page_start = (
        per_page.withColumn("_block", block)
        .withColumn("_page_start", before(*group, "_block", by=page))
        .join(block_start, [*group, "_block"])
        .select(*group, page, (F.col("_block_start") + F.col("_page_start")).alias("_start")))
    in_page = F.row_number().over(Window.partitionBy(*group, page).orderBy(*order))
    return (rows.withColumn("_place", in_page)
            .join(page_start, [*group, page])
            .withColumn(name, (F.col("_start") + F.col("_place")).cast("bigint"))
            .select(*wanted))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "seq",
           per_group: DataFrame | None = None) -> DataFrame:
    """Add the 1-based position of each row in ``group`` by ``order`` (nulls first): a distributed prefix sum.

    Rows are range-sorted once by (group, order) and written, so a group with a third of all rows covers a third of the tasks.
    Each task counts its rows of each group; the counts, at most one a task and group, are summed up in task order and
    joined back.  ``per_group`` (a row a group, such as caps) comes along on those counts, so nothing is salted.  Rows with
    equal ``order`` get positions in no certain order.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The sort of a task gives its rows numbers without gaps in the low bits.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = (rows.repartitionByRange(tasks, *group, *order).sortWithinPartitions(*group, *order)
             .select("*", F.spark_partition_id().alias("_task"), place.alias("_place")))
    path = work_dir(spark, "ranked") + "/table"
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    counts = dealt.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).drop("_rows", "_first")
    extra = []
    if per_group is not None:
        extra = [c for c in per_group.columns if c not in group]
        starts = starts.join(per_group.select(*group, *extra), group, "left")
    starts = starts.select(F.col("_task").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in group], "_start", *extra)
    same = F.col("_task") == F.col("_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return dealt.join(starts, same).select(
        *rows.columns, *extra, (F.col("_start") + F.col("_place") + 1).cast("bigint").alias(name))


def within_cap(seq: Column, cap: Column) -> Column:
    """Null or 0 means no cap."""
    return F.coalesce(F.nullif(cap, F.lit(0)).isNull() | (seq <= cap), F.lit(True))


def chunk_no(seq: Column, size: int) -> Column:
    """0-based chunk of a 1-based position."""
    return F.floor((seq - 1) / size).cast("bigint")


def is_snapshot_batch(batch: Column, interval: int = 20) -> Column:
    """Every ``interval``-th 1-based save."""
    return (batch + 1) % interval == 0


def progress(seq: Column, cap: Column) -> Column:
    """W3: 'n/cap', or 'n/unlimited'."""
    return F.concat(seq.cast("string"), F.lit("/"),
                    F.coalesce(F.nullif(cap, F.lit(0)).cast("string"), F.lit("unlimited")))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row per key.

    A minimum is combined on the map side, so a key with any number of copies
    reaches the shuffle once per task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return (rows.groupBy(*keys).agg(first)
            .select(*keys, *[F.col("_first")[c].alias(c) for c in [*order, *rest]])
            .select(*rows.columns))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: Column,
                how: str = "inner", slices: int = 16) -> DataFrame:
    """Join facts to a few bytes per key (caps, last pages) when a key may hold a third of ``big``.

    Every key of ``big`` is split over ``slices`` tasks and ``small`` is repeated
    that many times; no side has to fit anywhere whole.  For wide ``small`` rows
    use :func:`hot_join`.
    """
    salted = big.withColumn("_slice", F.pmod(F.xxhash64(spread_by), F.lit(slices)).cast("int"))
    copies = small.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return salted.join(copies, [*keys, "_slice"], how).drop("_slice")


# Rows of one key that a single join task takes.
ROWS_PER_SLICE = 1_000_000
# Hot keys that are broadcast; more of them are joined like any table.
MAX_HOT_KEYS = 100_000


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: Column,
             how: str = "inner", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Join where only keys with more than ``rows_per_slice`` rows in ``big`` are split.

    Counts are combined on the map side and the hot keys are counted first: without any
    the join is a plain one, and they are broadcast only up to ``MAX_HOT_KEYS``.
    ``big`` is read more than once; hand in a staged table.
    """
    hot = (big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_slice)
           .select(*keys, F.ceil(F.col("_n") / rows_per_slice).cast("int").alias("_slices")))
    n_hot = hot.count()
    if not n_hot:
        return big.join(small, keys, how)
    if n_hot <= MAX_HOT_KEYS:
        hot = F.broadcast(hot)
    slices = F.coalesce("_slices", F.lit(1))
    split = (big.join(hot, keys, "left")
             .withColumn("_slice", F.pmod(F.xxhash64(spread_by), slices).cast("int")).drop("_slices"))
    copies = (small.join(hot, keys, "left")
              .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices"))
    return split.join(copies, [*keys, "_slice"], how).drop("_slice")
