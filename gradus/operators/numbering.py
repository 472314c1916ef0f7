"""Positions of rows in a declared order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import store


def positions(df: DataFrame, order: list[Column], keys: list[str] | None = None, position: str = "position") -> DataFrame:
    """Adds each row's place (from 0) in the order, within its keys if there are any.

    Rows are dealt by ranges of the order and sorted there; a row's place is its place in its
    range and the rows of earlier ranges, of which there is a row a range (and key). One
    shuffle, whatever the sizes of the keys. Ties in the order come in any order.
    """
    keys = keys or []
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    at, row = "__range", "__row"
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    written = store(ranged.withColumns({at: F.spark_partition_id(), row: F.monotonically_increasing_id()}), "ranges")
    sums = written.groupBy(at, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__first"))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(at).alias("__at"), *[F.col(k).alias(f"__{k}") for k in keys], "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col(at) == F.col("__at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return written.join(sums, on).select(*df.columns, (F.col("__before") + F.col(row) - F.col("__first")).alias(position))
