"""Seen addresses and caps as keyed state of the stream (T3, T4, T5): no batch reads the store."""

from __future__ import annotations

import heapq
import sys
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

# The processor travels with the plan, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Tasks over which the addresses of a term without a cap are spread.
SLICES = 16

RUN_TERM = ["run_id", "market", "search_term"]
PLACE = T.StructType([T.StructField("page_num", T.IntegerType()), T.StructField("pos", T.IntegerType()),
                      T.StructField("url", T.StringType()), T.StructField("captured_at", T.TimestampType()),
                      T.StructField("payload", T.StringType())])
KEYED = T.StructType([T.StructField(c, T.StringType()) for c in RUN_TERM] + [T.StructField("_slice", T.IntegerType()), *PLACE.fields])


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in the store that keyed state needs; a stream keeps the setting it started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class SeenAndCapped(StatefulProcessor):
    """State of one (run, market, term): the addresses given out, which expire, and how many there were."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "url string", "at bigint", self.ttl_ms)
        self.kept = handle.getValueState("kept", "n bigint")

    def handleInputRows(self, key, rows, timer_values):
        had = self.kept.get()[0] if self.kept.exists() else 0
        best: dict[str, tuple] = {}  # the first place of each new address, no more of them than the cap leaves room for
        order: list[tuple] = []      # the same as a heap, the last place on top
        room, out = None, []
        for part in rows:
            for place in part[[*PLACE.names, "max_items"]].itertuples(index=False, name=None):
                cap = place[-1]
                room = None if pd.isna(cap) or not cap else max(0, int(cap) - had)
                if room == 0 or self.seen.containsKey((place[2],)):
                    continue
                row = _sortable(place[:-1])
                if place[2] in best and best[place[2]] <= row:
                    continue
                if room is not None:
                    best[place[2]] = row
                    heapq.heappush(order, _Last(row))
                    while len(best) > room:
                        last = heapq.heappop(order).row
                        if best.get(last[2]) == last:
                            del best[last[2]]
                else:
                    best[place[2]] = row
        for row in sorted(best.values()):
            self.seen.updateValue((row[2],), (1,))
            out.append((*key, None if row[0] < 0 else row[0], None if row[1] < 0 else row[1], *row[2:]))
        self.kept.update((had + len(out),))
        frame = pd.DataFrame(out, columns=KEYED.names)
        for name in ("page_num", "pos"):
            frame[name] = frame[name].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


class _Last:
    """Turns the heap around: the largest place is on top."""

    def __init__(self, row: tuple):
        self.row = row

    def __lt__(self, other: "_Last") -> bool:
        return self.row > other.row


def _sortable(place: tuple) -> tuple:
    """(page, pos, url, time, payload) with a number for a missing page or place; rows without a page come first."""
    page, pos, *rest = place
    return (-1 if pd.isna(page) else int(page), -1 if pd.isna(pos) else int(pos), *rest)


def capped_stream(products: DataFrame, caps: DataFrame, run_id: str = "", ttl: int | None = None) -> DataFrame:
    """Each new product once per run, market and term, and no more of a term than ``caps`` (market, search_term,
    max_items; null or 0: any number) allow, in the order of the batches and within a batch by page and place.

    The state is the stream's own: a map of the addresses given out, which forgets them ``ttl`` seconds after they came (None:
    never), and a counter.  With ``ttl`` the stream never runs out of batches, so start it with a processing-time trigger and not
    with ``availableNow``.  ``run_id`` may be a column of ``products``; each value starts with nothing seen.  A batch holds no
    more rows of a capped term than its cap, and a term without a cap is spread over several tasks by address.
    """
    rest = [c for c in products.columns if c not in (*RUN_TERM, *PLACE.names[:-1])]
    fields = T.StructType([products.schema[c] for c in rest])
    rows = products if "run_id" in products.columns else products.withColumn("run_id", F.lit(run_id))
    asked = caps.select("market", "search_term", F.nullif("max_items", F.lit(0)).cast("int").alias("max_items"))
    keyed = rows.join(asked, ["market", "search_term"], "left").select(
        F.col("run_id").cast("string").alias("run_id"), "market", "search_term",
        F.when(F.col("max_items").isNull(), F.pmod(F.xxhash64("url"), F.lit(SLICES))).otherwise(0).cast("int").alias("_slice"),
        *PLACE.names[:-1], F.to_json(F.struct(*rest)).alias("payload"), "max_items")
    kept = keyed.groupBy(*RUN_TERM, "_slice").transformWithStateInPandas(
        SeenAndCapped(None if ttl is None else 1000 * ttl), KEYED, "Append", "None" if ttl is None else "ProcessingTime")
    return kept.withColumn("_row", F.from_json("payload", fields)).select(
        *RUN_TERM, *PLACE.names[:-1], *[F.col("_row")[c].alias(c) for c in rest])
