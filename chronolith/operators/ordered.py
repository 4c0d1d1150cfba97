"""Running values over a log's total order, without a window in one task.

The table is cut into ranges of the order column and written with each row's range number. A window runs inside
each range; one summary row a range (as many as there are partitions) carries what came before it, and joins
back by broadcast. Sum and max are associative, so the result equals that of the one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.sources.storage import written


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    return written(ranged, "ordered")  # range borders come from sampling: freeze them


def _before(ranged: DataFrame, value: Column, total, merge) -> DataFrame:
    """_range, _before: the merged totals of all lower ranges (null for the first)."""
    sums = ranged.groupBy("_range").agg(total(value).alias("_total"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", merge("_total").over(upto).alias("_before"))


def number(df: DataFrame, order: str, name: str, after: int = 0) -> DataFrame:
    """A dense number from ``after + 1`` on, by ascending ``order`` (a unique column)."""
    r = _ranged(df, order)
    before = _before(r, F.lit(1), F.count, F.sum)
    local = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    out = r.withColumn("_local", local).join(F.broadcast(before), "_range")
    return out.withColumn(name, (F.lit(after) + F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("long")).drop("_range", "_local", "_before")


def running_max(df: DataFrame, order: str, value: Column, name: str, current: bool = True) -> DataFrame:
    """The largest value up to each row, by ascending ``order``; ``current``: that row's own value counts."""
    r = _ranged(df.withColumn("_value", value), order)
    before = _before(r, F.col("_value"), F.max, F.max)
    frame = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    out = r.withColumn("_local", F.max("_value").over(frame)).join(F.broadcast(before), "_range")
    return out.withColumn(name, F.greatest("_local", "_before")).drop("_range", "_local", "_before", "_value")


def running_max_in(df: DataFrame, by: str, order: str, value: Column, name: str, current: bool = True) -> DataFrame:
    """``running_max`` in each group of ``by``. A large group is cut into ranges; one summary row a range and group carries on."""
    r = _ranged(df.withColumn("_value", value), by, order)
    sums = r.groupBy(by, "_range").agg(F.max("_value").alias("_total"))
    lower = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.max("_total").over(lower).alias("_before"))
    frame = Window.partitionBy("_range", by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    local = r.withColumn("_local", F.max("_value").over(frame))
    # only groups that lie in several ranges have something to carry: at most one group a range
    carried = F.broadcast(before.filter(F.col("_before").isNotNull()))
    out = local.join(carried, local[by].eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")), "left")
    return out.withColumn(name, F.greatest("_local", "_before")).drop("_range", "_local", "_before", "_value", "_by", "_r")
