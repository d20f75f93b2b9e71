"""Concepts (row set x column set) across ranges: dedupe, group, rank, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bicspark.operators.itemsets import NODE, ROW_SET, ClosedSets, subsupport_items
from bicspark.operators.ordered import positions
from bicspark.plans.stages import Stages

# A row set's number is the (level, node) of one concept that has exactly these rows.
ROWS_ID = ["rows_level", "rows_node"]

#: The order of ranked concepts: rows and column sets descending, then the row set and the columns.
RANKED = ["n_rows", "n_sets", "row_min", "row_max", "row_xor", "cols", "row_hash1", "row_hash2"]


def number_row_sets(closed: ClosedSets, exact: bool = True, stages: Stages | None = None) -> DataFrame:
    """Concepts with their :data:`ROW_SET` columns and :data:`ROWS_ID`.

    Two concepts get the same id if and only if they have the same rows. Within a
    range that never happens, so a group holds at most one concept per range.
    Candidates agree in size, ends and hashes; with ``exact`` the rows that each shares
    with the first of its group are counted, by the cells of their transaction groups.
    Only concepts that share a hash with another one are brought together; ``alone`` tells the others.
    """
    stages = stages or Stages(closed.concepts.sparkSession)
    sets = closed.with_row_sets()
    if closed.subtrees:
        often = sets.groupBy("row_hash1").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("row_hash1")
        often = stages.new_table(often, "shared-hashes")
        single = sets.join(often, "row_hash1", "left_anti").select(
            "*", F.col("level").alias("rows_level"), F.col("node").alias("rows_node"), F.lit(True).alias("alone")
        )
        sets = sets.join(often, "row_hash1", "left_semi")
    numbered = _number(closed, sets, exact, stages)
    return numbered.withColumn("alone", F.lit(False)).unionByName(single) if closed.subtrees else numbered


def _number(closed: ClosedSets, sets: DataFrame, exact: bool, stages: Stages) -> DataFrame:
    first = F.min(F.struct(*NODE)).over(Window.partitionBy(*ROW_SET))
    numbered = sets.withColumn("first", first).select(
        "*", F.col("first.level").alias("rows_level"), F.col("first.node").alias("rows_node")
    ).drop("first")
    follows = (F.col("level") != F.col("rows_level")) | (F.col("node") != F.col("rows_node"))
    numbered, n_open = stages.counted_table(numbered, "row-sets", follows)
    turn = 0
    while exact and n_open:
        turn += 1
        unlike = stages.table(_unlike(closed, numbered.where(follows)), f"unlike-{turn}")
        if unlike.isEmpty():
            break
        # Equal hashes of different row sets: give those a first of their own.
        again = unlike.withColumn("new", F.min(F.struct(*NODE)).over(Window.partitionBy(*ROWS_ID)))
        moved = numbered.join(again.select(*NODE, "new"), NODE, "left").select(
            *[c for c in numbered.columns if c not in ROWS_ID],
            F.coalesce("new.level", "rows_level").alias("rows_level"),
            F.coalesce("new.node", "rows_node").alias("rows_node"),
        )
        numbered, _ = stages.counted_table(moved, f"row-sets-{turn}", follows)
    return numbered


def _unlike(closed: ClosedSets, followers: DataFrame) -> DataFrame:
    """Followers whose rows are not all rows of the first concept of their group.

    No concept's rows are listed. The transaction groups of one range and of another cut
    the rows into cells, and the number of rows in each cell is counted once for all
    concepts of the two ranges. Concepts then meet on their groups: the rows that two of
    them share are the sum of the cells of their groups. Only rows of groups that some of
    the concepts have are met, as the other cells are never asked for.
    """
    stages = closed.stages
    pairs = followers.select(*NODE, *ROWS_ID, "bucket_id", "n_rows")
    firsts = pairs.select(F.col("rows_level").alias("level"), F.col("rows_node").alias("node")).distinct()
    first_ranges = firsts.join(closed.concepts, NODE).select(*NODE, F.col("bucket_id").alias("first_bucket")).toDF(*ROWS_ID, "first_bucket")
    ranges = pairs.join(first_ranges, ROWS_ID).select("bucket_id", "first_bucket").distinct()
    own_groups = stages.new_table(closed.occurrences(pairs).join(pairs.select(*NODE, *ROWS_ID), NODE), "own-groups")
    first_groups = stages.new_table(closed.occurrences(firsts).toDF(*ROWS_ID, "first_tid"), "first-groups")
    rows = closed.row_groups()
    own_rows = rows.join(own_groups.select("tid").distinct(), "tid", "left_semi")
    first_rows = rows.select(F.col("bucket_id").alias("first_bucket"), "row_id", F.col("tid").alias("first_tid"))
    first_rows = first_rows.join(first_groups.select("first_tid").distinct(), "first_tid", "left_semi")
    cells = (
        own_rows.join(ranges, "bucket_id")
        .join(first_rows, ["row_id", "first_bucket"])
        .groupBy("tid", "first_tid")
        .agg(F.count("*").alias("n_shared"))
    )
    cells = stages.new_table(cells, "cells")
    shared = (
        own_groups.join(cells, "tid")
        .join(first_groups, [*ROWS_ID, "first_tid"], "left_semi")
        .groupBy(*NODE)
        .agg(F.sum("n_shared").alias("n_shared"))
    )
    return pairs.join(shared, NODE, "left").where(F.coalesce("n_shared", F.lit(0)) < F.col("n_rows")).select(*NODE, *ROWS_ID)


def distinct_concepts(numbered: DataFrame) -> DataFrame:
    """One record per (rows, cols) over all ranges, with the ranges it came from.

    Concepts that are ``alone`` with their rows come as they are.
    """
    if "alone" in numbered.columns:
        single = numbered.where("alone").select(*ROWS_ID, *ROW_SET, "cols", "n_cols", F.array("bucket_id").alias("bucket_ids"), *NODE)
        return distinct_concepts(numbered.where(~F.col("alone")).drop("alone")).unionByName(single)
    return numbered.groupBy(*ROWS_ID, "cols").agg(
        *[F.first(c).alias(c) for c in ROW_SET],
        F.first("n_cols").alias("n_cols"),
        F.min_by(F.struct(*NODE), F.struct("bucket_id", *NODE)).alias("at"),
        F.sort_array(F.collect_set("bucket_id")).alias("bucket_ids"),
    ).select(*ROWS_ID, *ROW_SET, "cols", "n_cols", "bucket_ids", "at.level", "at.node")


def subsupport_concepts(trans: DataFrame, minsup: int, stages: Stages | None = None) -> DataFrame:
    """:func:`subsupport_items` over all ranges, in the shape of :func:`distinct_concepts`.

    They have fewer than ``minsup`` rows, so they share no row set with a closed
    itemset. Their level is -1, and ``rows`` lists their rows.
    """
    stages = stages or Stages(trans.sparkSession)
    found = subsupport_items(trans, minsup).groupBy("rows", "cols").agg(
        F.sort_array(F.collect_set("bucket_id")).alias("bucket_ids")
    )
    numbered = stages.table(found.select(F.monotonically_increasing_id().alias("node"), "*"), "subsupport")

    def xor(of) -> Column:
        return F.aggregate(F.transform("rows", of), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))

    return (
        numbered.select(
            F.lit(-1).alias("rows_level"),
            F.min("node").over(Window.partitionBy("rows")).alias("rows_node"),
            F.size("rows").cast("bigint").alias("n_rows"),
            F.array_min("rows").alias("row_min"),
            F.array_max("rows").alias("row_max"),
            xor(lambda r: r).alias("row_xor"),
            xor(lambda r: F.xxhash64(r)).alias("row_hash1"),
            xor(lambda r: F.xxhash64(F.lit(1), r)).alias("row_hash2"),
            "cols",
            F.size("cols").alias("n_cols"),
            "bucket_ids",
            F.lit(-1).alias("level"),
            "node",
            "rows",
        )
    )


def group_by_rows(distinct: DataFrame) -> DataFrame:
    """One record per row set with all its column sets, at most one per range."""
    return distinct.groupBy(*ROWS_ID).agg(
        *[F.first(c).alias(c) for c in ROW_SET],
        F.sort_array(F.collect_list("cols")).alias("col_sets"),
        F.count("*").alias("n_sets"),
    )


def longest_per_rows(distinct: DataFrame) -> DataFrame:
    """Per row set the column set with most columns.

    Ties go to the longest text, then to the smallest set. ``n_dup`` is the number
    of column sets that the row set has.
    """
    text_length = F.length(F.array_join(F.col("cols").cast("array<string>"), " "))
    return distinct.groupBy(*ROWS_ID).agg(
        *[F.first(c).alias(c) for c in ROW_SET],
        F.min_by("cols", F.struct(-F.col("n_cols"), -text_length, "cols")).alias("cols"),
        F.max("n_cols").alias("n_cols"),
        F.count("*").alias("n_dup"),
    ).select("*", F.col("rows_level").alias("level"), F.col("rows_node").alias("node"))


def min_cols(concepts: DataFrame, least: int) -> DataFrame:
    """Keep concepts with at least ``least`` columns."""
    return concepts.where(F.col("n_cols") >= least)


def having_value(concepts: DataFrame, value: float) -> DataFrame:
    """Keep concepts of ``col#value`` items that have an item with this value."""
    return concepts.where(
        F.exists("cols", lambda c: F.substring_index(c, "#", -1).cast("double") == F.lit(float(value)))
    )


def rank_keys() -> list[Column]:
    """What concepts are ordered by; the columns are :data:`RANKED`."""
    return [F.desc(c) if c in ("n_rows", "n_sets") else F.asc(c) for c in RANKED]


def rank_concepts(distinct: DataFrame, least_cols: int = 1, limit: int | None = None) -> DataFrame:
    """Order by rows, then by column sets of the row set, both descending.

    ``n_sets`` counts all column sets of a row set, those below ``least_cols`` too.
    Ties are settled by the row set's columns and the column set. The sort is range
    partitioned; with ``limit`` only the top is kept per task and merged.
    """
    ranked = (
        distinct.withColumn("n_sets", F.count("*").over(Window.partitionBy(*ROWS_ID)))
        .where(F.col("n_cols") >= least_cols)
        .orderBy(*rank_keys())
    )
    return ranked if limit is None else ranked.limit(limit)


def with_position(ranked: DataFrame, stages: Stages | None = None, name: str = "position") -> DataFrame:
    """Ranked concepts with their place in the ranking, from 1, without gaps.

    Takes :func:`rank_concepts`' columns in any order. Places come from counts of range
    partitions, so no task sees the whole ranking.
    """
    return positions(ranked, rank_keys(), stages or Stages(ranked.sparkSession), name)
