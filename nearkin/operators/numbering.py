"""Running totals over a whole table, in two levels."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from nearkin.sources.storage import durable

#: Rows that one task puts in order.
RANGE_ROWS = 10_000


def sums_before(
    df: DataFrame,
    order: Sequence[str | Column],
    value: str,
    name: str,
    rows: int,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows that come earlier by ``order``.

    ``rows`` is how many there are, ``order`` has to tell any two apart. The rows are cut
    into ranges; the sums of the ranges, of which there is one for ``range_rows`` rows, are
    added up first and sent to their rows, which are added up within each range.
    """
    ranges = max(1, ceil(rows / range_rows))
    if ranges == 1:
        return df.withColumn(name, _before(Window.orderBy(*order), value))
    cut = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    cut = durable(cut, "ranges")
    totals = cut.groupBy(F.col("_range").alias("_at")).agg(F.sum(value).alias("_sum"))
    starts = sums_before(totals, ["_at"], "_sum", "_start", ranges, range_rows)
    starts = starts.select(F.col("_at").alias("_range"), "_start")
    within = cut.withColumn("_within", _before(Window.partitionBy("_range").orderBy(*order), value))
    # as many starts as ranges, 16 bytes each
    placed = within.join(F.broadcast(starts), "_range")
    return placed.withColumn(name, F.col("_start") + F.col("_within")).select(*df.columns, name)


def _before(window: WindowSpec, value: str) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
