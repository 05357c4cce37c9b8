"""Running sums that pass through no single task, whatever the size of a key or of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.staging import stage


def running_sum(rows: DataFrame, value: Column, order: list[Column], out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and including each row, within ``keys`` (rows without a null key) by ``order``.

    The rows are range-sorted by keys and order, so that a large key spreads over
    many ranges; the ranges' sums are summed per key (a row per key and range), and
    rows are summed within their range. Pass narrow rows: they are written once
    and shuffled twice. Rows that tie in ``order`` share a range, in no set order.
    """
    ranged = rows.withColumn("__value", value).repartitionByRange(*map(F.col, keys), *order)
    ranged = stage(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*keys, "__range").agg(F.sum("__value").alias("__sum"))
    through = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(through), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(offsets, [*keys, "__range"]).withColumn(out, F.col("__before") + F.sum("__value").over(within))
    return summed.select(*rows.columns, out)
