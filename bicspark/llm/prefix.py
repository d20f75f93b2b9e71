"""Running sums and places over sorted groups of any size, without a task per group.

Rows come with a uniform sort value. Each group is cut by it into about as many parts
as the square root of the number of rows. The sums of parts are small and are added up
first; then each part runs over its own rows. So a group with a third of all rows
spreads over as many tasks as there are parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 32


def n_parts(n_rows: int) -> int:
    return max(1, math.isqrt(n_rows))


def running(rows: DataFrame, n_rows: int, group: list[str], unit: Column, order: list[str], weight: Column) -> DataFrame:
    """Add ``before`` and ``place``: the weight and the number of rows before each, in its group.

    ``unit`` is a long in [0, 2**32) that never falls along ``order`` (the first of
    which it should be). Group columns must not be null. ``rows`` is read twice, so it
    should be a written table. Rows that tie in all of ``order`` take any order.
    """
    parts = n_parts(n_rows)
    cut = rows.withColumn("part_", F.shiftright(unit * F.lit(parts).cast("bigint"), 32)).withColumn("weight_", weight)
    keys = [*group, "part_"]
    sums = cut.groupBy(*keys).agg(F.sum("weight_").alias("sum_"), F.count("*").alias("count_"))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *keys,
        F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("weight_0"),
        F.coalesce(F.sum("count_").over(earlier), F.lit(0)).alias("place_0"),
    )
    own = Window.partitionBy(*keys).orderBy(*order)
    above = own.rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(starts, keys).select(
        *rows.columns,
        (F.col("weight_0") + F.coalesce(F.sum("weight_").over(above), F.lit(0))).alias("before"),
        (F.col("place_0") + F.row_number().over(own) - 1).alias("place"),
    )
