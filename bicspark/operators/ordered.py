"""Running aggregates and positions in sorted groups of any size, without a task per group.

Rows are range partitioned by group and order. Each partition's part of a group is
aggregated, these few records are added up from the first part to the last, and then every
part runs over its own rows. So a group with all rows spreads over as many tasks as there
are partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bicspark.plans.stages import Stages

#: How two parts' aggregates become one.
_AGGREGATES = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}


def _combined(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    if how == "xor":
        return F.coalesce(left, F.lit(0).cast("bigint")).bitwiseXOR(F.coalesce(right, F.lit(0).cast("bigint")))
    return F.greatest(left, right)  # greatest skips nulls


def before(rows: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, Column]], stages: Stages) -> DataFrame:
    """Add for each row the aggregates over the rows of its group that come before it.

    ``values`` maps a name to ("sum", "max" or "xor", column). Sums and exclusive-ors of
    no rows are 0, a maximum of none is null. Rows that tie in all of ``order`` lie in one
    partition and take any order. ``rows`` is read twice, to find the ranges and to cut
    them, so it should be a written table or cheap.
    """
    columns = rows.columns
    named = rows.select("*", *[value.alias(f"{name}_") for name, (_, value) in values.items()])
    cut = named.repartitionByRange(*group, *order).withColumn("part_", F.spark_partition_id())
    cut = stages.new_table(cut, "ordered")
    parts = cut.groupBy(*group, "part_").agg(*[_AGGREGATES[how](f"{name}_").alias(f"{name}_0") for name, (how, _) in values.items()])
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *[F.col(c).alias(f"{c}_0") for c in [*group, "part_"]],
        *[_AGGREGATES[how](f"{name}_0").over(earlier).alias(f"{name}_0") for name, (how, _) in values.items()],
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_0")) for c in [*group, "part_"]])
    own = Window.partitionBy(*group, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(starts, same).select(
        *columns,
        *[_combined(how, F.col(f"{name}_0"), _AGGREGATES[how](f"{name}_").over(own)).alias(name) for name, (how, _) in values.items()],
    )


def positions(rows: DataFrame, order: list[Column], stages: Stages, name: str = "position") -> DataFrame:
    """Add the place of each row in the order of the whole table, from 1, without gaps.

    Ties take any order. No window runs over more than one partition's rows, apart from
    one over a record per partition.
    """
    cut = stages.new_table(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ordered")
    counts = cut.groupBy("part_").agg(F.count("*").alias("n_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("start_"))
    own = Window.partitionBy("part_").orderBy(*order)
    return cut.join(starts, "part_").select(*rows.columns, (F.col("start_") + F.row_number().over(own)).alias(name))
