"""Containment over element rows: an ordered structural join.

Elements are intervals ``eid`` .. ``last`` that nest and never cross.  Walking a page in document order, the matching elements
that are open form a stack; the nearest one above an element is the latest that was opened at the present depth.  Depth is a
running sum, the latest one a running value: two ordered passes over a page's rows, no pairs and no array of the page.  A page
is sorted in one task, which spills; a page may be larger than one array value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_above(elements: DataFrame, keys: list[str], outer: Column, name: str = "above") -> DataFrame:
    """Add the ``eid`` of the nearest element above each one that satisfies ``outer``; null where there is none.

    ``elements`` has one row per element with ``eid`` and ``last``; ``keys`` name its page (null is a page like any other).
    Rows of one ``eid`` twice on a page are one element.
    """
    is_outer = F.coalesce(outer, F.lit(False))
    rows = elements.dropDuplicates([*keys, "eid"]).withColumn("_outer", is_outer)
    # An element opens at 2 * eid; what ends with ``last`` closes just behind it.
    opens = rows.select(*keys, (2 * F.col("eid")).alias("_at"), F.col("_outer").cast("int").alias("_step"),
                        F.struct(*[F.col(c) for c in elements.columns if c not in keys]).alias("_row"))
    closes = rows.where("_outer").groupBy(*keys, (2 * F.col("last") + 1).alias("_at")).agg(
        (-F.count(F.lit(1))).cast("int").alias("_step")).withColumn("_row", F.lit(None).cast(opens.schema["_row"].dataType))
    walk = Window.partitionBy(*keys).orderBy("_at")
    # The depth before the element itself, which is the depth of its nearest open one.
    depth = F.sum("_step").over(walk.rowsBetween(Window.unboundedPreceding, 0)) - F.greatest("_step", F.lit(0))
    events = opens.unionByName(closes).withColumn("_depth", depth).where(F.col("_row").isNotNull())
    # An outer element answers for those one level deeper; they ask at their own depth.
    answers = events.where("_step > 0").select(*keys, "_at", (F.col("_depth") + 1).alias("_depth"), F.col("_row.eid").alias("_eid"),
                                               F.lit(None).cast(opens.schema["_row"].dataType).alias("_row"))
    asks = events.select(*keys, "_at", "_depth", F.lit(None).cast("int").alias("_eid"), "_row")
    level = Window.partitionBy(*keys, "_depth").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.when(F.col("_depth") > 0, F.last("_eid", ignorenulls=True).over(level))
    return (answers.unionByName(asks).withColumn(name, nearest).where(F.col("_row").isNotNull())
            .select(*keys, *[F.col("_row")[c].alias(c) for c in elements.columns if c not in keys], name))
