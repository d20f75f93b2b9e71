"""Connected components of links between ids, as a loop of joins over stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bicspark.plans.stages import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """``(id, component)`` of every id in ``links (a, b)``: the smallest id it reaches.

    Alternates two steps until nothing changes: every id's larger neighbours are joined
    to its smallest neighbour, then its smaller ones and itself. The rounds needed grow
    with the logarithm of the longest chain. Minima combine before their shuffle, and
    the join that uses them splits a hot id, so no id's links meet in one task. Null ids
    and links of an id to itself are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = None
    names: list[str] = []
    for round_ in range(200):
        name = f"links-{id(links)}-{round_}"
        table, seen = stages.observed_table(
            edges, name, n=F.count("*"), mark=F.bit_xor(F.xxhash64("u", "v")), low=F.sum(F.col("v").cast("decimal(38,0)"))
        )
        if names:
            stages.drop(names.pop())
        names.append(name)
        state = (seen["n"], seen["mark"], seen["low"])
        if state == before:
            heads = table.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return table.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)
        before = state
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = small.unionByName(lowest.withColumnRenamed("m", "v")).distinct()
    raise RuntimeError("components did not settle in 200 rounds")
