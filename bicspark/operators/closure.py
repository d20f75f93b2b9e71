"""The steps of the closed itemset search, in two forms.

Both count, for each node (a closed set) and each item that extends it, how often
every other item occurs along with the two. Items as frequent as the extending one
belong to the child's closure, other frequent items stay in its transactions.

:class:`ArraySteps` keeps the items that stay as an array at the node. It suits ranges
with a limited number of frequent items, as the columns of a matrix are, and needs no
shuffle to cut transactions down. :class:`JoinSteps` keeps them as records and cuts by
joins, so that even the frequent items of one node are never brought together; it suits
``col#value`` items, which have no such limit. What both collect is a closure, which is
no longer than a single transaction, and the transactions themselves.

Occurrences are ``(node, tid, weight, cand, pre)``: ``cand`` has the items that may
extend the node, ``pre`` those that must stay out of the closures below it. They have a
``piece`` too if some node has more records than one task should get: such a node's
records are in pieces from 1, and those of the other nodes in piece 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bicspark.plans.stages import Stages


class ArraySteps:
    def __init__(self, counts: DataFrame, minsup: int, stages: Stages):
        self.minsup = minsup
        self.stages = stages
        self.roots = stages.table(self._roots(counts), "roots")

    def _roots(self, counts: DataFrame) -> DataFrame:
        per_range = counts.groupBy("bucket_id").agg(
            F.max("n").alias("n_rows"),
            F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "n"))).alias("counts"),
        )
        return per_range.select(
            F.monotonically_increasing_id().alias("node"),
            "bucket_id",
            "n_rows",
            _full("counts", "n_rows").alias("cols"),
            _part("counts", "n_rows").alias("ext"),
        )

    def cut(self, merged: DataFrame) -> DataFrame:
        """Merged transactions ``(mid, bucket_id, items, ...)`` with ``node`` and ``cand``, their other items left out."""
        return merged.join(self.roots.select("bucket_id", "node", "ext"), "bucket_id").select(
            *merged.columns, "node", F.array_intersect("items", "ext").alias("cand")
        )

    def children(self, occ: DataFrame, parents: DataFrame, tasks: int) -> DataFrame:
        per_child = pair_counts(occ, self.minsup, tasks).groupBy("parent", "item").agg(
            F.max("n").alias("n_rows"),
            F.max("k").alias("n_occ"),
            F.collect_list(F.struct(F.col("other").alias("item"), "n")).alias("counts"),
        )
        split = per_child.select(
            "parent",
            "item",
            "n_rows",
            "n_occ",
            _full("counts", "n_rows").alias("closure"),
            _part("counts", "n_rows").alias("part"),
        )
        item = F.col("item")
        later = F.filter("part", lambda i: i > item)
        earlier = F.filter("part", lambda i: i < item)
        return name_children(
            split, parents, F.size(later).alias("n_ext"), later.alias("ext"), earlier.alias("pre")
        )

    def descend(self, occ: DataFrame, nodes: DataFrame) -> DataFrame:
        """Occurrences of ``nodes`` from those of their parents, with ``n_occ``."""
        child = with_children(occ, nodes, "node", "ext", "pre", "n_occ")
        return child.select(
            "child.node",
            "tid",
            "weight",
            F.array_intersect("cand", "child.ext").alias("cand"),
            F.array_intersect(F.concat("cand", "pre"), "child.pre").alias("pre"),
            "child.n_occ",
        ).where(F.size("cand") > 0)


class JoinSteps:
    def __init__(self, counts: DataFrame, minsup: int, stages: Stages):
        self.minsup = minsup
        self.stages = stages
        totals = counts.where(F.col("item").isNull()).select("bucket_id", F.col("n").alias("n_rows"))
        self.root_counts = counts.where(F.col("item").isNotNull()).join(totals, "bucket_id")
        full = F.when(F.col("n") == F.col("n_rows"), F.col("item"))
        closures = self.root_counts.groupBy("bucket_id").agg(F.sort_array(F.collect_list(full)).alias("cols"))
        self.roots = stages.table(
            totals.join(closures, "bucket_id").select(
                F.monotonically_increasing_id().alias("node"), "bucket_id", "n_rows", "cols"
            ),
            "roots",
        )
        self.counts: DataFrame | None = None

    def cut(self, merged: DataFrame) -> DataFrame:
        part = self.root_counts.where(F.col("n") < F.col("n_rows")).select(
            "bucket_id", "item", F.col("item").alias("kept")
        )
        # The null item keeps transactions that have none of the items.
        cand = (
            merged.select("bucket_id", "mid", F.explode(F.array_append("items", F.lit(None))).alias("item"))
            .join(part, ["bucket_id", "item"], "left")
            .groupBy("mid")
            .agg(F.sort_array(F.collect_list("kept")).alias("cand"))
        )
        named = merged.join(cand, "mid").join(self.roots.select("bucket_id", "node"), "bucket_id")
        return self.stages.table(named.select(*merged.columns, "node", "cand"), "cut")

    def children(self, occ: DataFrame, parents: DataFrame, tasks: int) -> DataFrame:
        self.counts = self.stages.new_table(pair_counts(occ, self.minsup, tasks), "counts")
        totals = self.counts.groupBy("parent", "item").agg(
            F.max("n").alias("n_rows"), F.max("k").alias("n_occ")
        )
        full = F.col("n") == F.col("n_rows")
        split = (
            self.counts.join(totals, ["parent", "item"])
            .groupBy("parent", "item")
            .agg(
                F.first("n_rows").alias("n_rows"),
                F.first("n_occ").alias("n_occ"),
                F.sort_array(F.collect_list(F.when(full, F.col("other")))).alias("closure"),
                F.count_if(~full & (F.col("other") > F.col("item"))).cast("int").alias("n_ext"),
            )
        )
        return name_children(split, parents, F.col("n_ext"))

    def descend(self, occ: DataFrame, nodes: DataFrame) -> DataFrame:
        own = nodes.select("parent", "item", "node", "n_rows", "n_occ")
        keep = self.counts.join(own, ["parent", "item"]).where(F.col("n") < F.col("n_rows")).select("node", "other")
        item, other = F.col("item"), F.col("other")
        return (
            occ.select(
                F.col("node").alias("parent"),
                "tid",
                "weight",
                F.explode("cand").alias("item"),
                F.concat("cand", "pre").alias("others"),
            )
            .join(own.drop("n_rows"), ["parent", "item"])
            .select("node", "tid", "weight", "n_occ", "item", F.explode("others").alias("other"))
            .join(keep, ["node", "other"], "left_semi")
            .groupBy("node", "tid")
            .agg(
                F.first("weight").alias("weight"),
                F.first("n_occ").alias("n_occ"),
                F.sort_array(F.collect_list(F.when(other > item, other))).alias("cand"),
                F.sort_array(F.collect_list(F.when(other < item, other))).alias("pre"),
            )
            .where(F.size("cand") > 0)
        )


def item_counts(merged: DataFrame, minsup: int) -> DataFrame:
    """Frequent items ``(bucket_id, item, n)`` by weight; the null item stands for all rows."""
    return (
        merged.select("bucket_id", "weight", F.explode(F.array_append("items", F.lit(None))).alias("item"))
        .groupBy("bucket_id", "item")
        .agg(F.sum("weight").alias("n"))
        .where(F.col("n") >= minsup)
    )


def pair_counts(occ: DataFrame, minsup: int, tasks: int = 1) -> DataFrame:
    """Count of each (node, extending item, item), ``n`` by weight and ``k`` of records.

    With several ``tasks`` a node's records come together, by piece, before pairs are formed.
    So the rare pairs of a node in one piece are dropped where they are counted, and only the
    others, and the counts per piece of a large node, are shuffled. Two extending items are
    counted once, the smaller first, and mirrored after that. Arrays are sorted, and items to
    stay out come before those that may extend.
    """
    pieces = ["piece"] if tasks > 1 and "piece" in occ.columns else []
    if tasks > 1:
        occ = occ.repartition(tasks, "node", *pieces)
    halves = (
        occ.select(F.col("node").alias("parent"), *pieces, "weight", "cand", "pre", F.posexplode("cand").alias("at", "item"))
        .select(
            "parent",
            *pieces,
            "weight",
            "item",
            F.explode(F.concat(F.slice("cand", F.col("at") + 1, F.size("cand")), "pre")).alias("other"),
        )
        .groupBy("parent", *pieces, "item", "other")
        .agg(F.sum("weight").alias("n"), F.count("*").alias("k"))
    )
    if pieces:
        whole = halves.where((F.col("piece") > 0) | (F.col("n") >= minsup))
        halves = whole.groupBy("parent", "item", "other").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    halves = halves.where(F.col("n") >= minsup)
    one = F.struct("item", "other")
    two = F.struct(F.col("other").alias("item"), F.col("item").alias("other"))
    both = F.when(F.col("other") > F.col("item"), F.array(one, two)).otherwise(F.array(one))
    return halves.select("parent", F.explode(both).alias("pair"), "n", "k").select(
        "parent", "pair.item", "pair.other", "n", "k"
    )


def with_children(occ: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Records of ``occ``, ``node`` as ``parent``, once per child that they are in.

    The child's ``columns`` of ``nodes`` come as ``child``. The children of a parent meet its
    records as an array, so that these are shuffled once and not once per item; only the
    records of a node in pieces go by item.
    """
    occ = occ.withColumnRenamed("node", "parent")
    child = F.struct("item", *columns)
    parts = []
    if "piece" in occ.columns:
        single = occ.where(F.col("piece") > 0).drop("piece").withColumn("item", F.explode("cand"))
        parts.append(single.join(nodes.select("parent", "item", child.alias("child")), ["parent", "item"]).drop("item"))
        occ = occ.where(F.col("piece") == 0).drop("piece")
    lists = nodes.groupBy("parent").agg(F.collect_list(child).alias("children"))
    own = F.filter("children", lambda c: F.array_contains("cand", c["item"]))
    parts.append(occ.join(lists, "parent").select(*occ.columns, F.explode(own).alias("child")))
    return reduce(DataFrame.unionByName, parts)


def name_children(split: DataFrame, parents: DataFrame, *more: Column) -> DataFrame:
    """Children whose closure adds no item before the extending one.

    Each closed set has just one such parent and item, so it arises once. The level is
    counted up in the data, so that all levels run the same generated code.
    """
    proper = split.where(F.col("closure")[0] == F.col("item"))
    named = parents.select(
        F.col("node").alias("parent"), "bucket_id", F.col("cols").alias("above"), F.col("level") + 1
    ).toDF("parent", "bucket_id", "above", "level")
    return proper.join(named, "parent").select(
        F.monotonically_increasing_id().alias("node"),
        "level",
        "parent",
        "item",
        "bucket_id",
        "n_rows",
        "n_occ",
        F.sort_array(F.concat("above", "closure")).alias("cols"),
        *more,
    )


def _full(counts: str, total: str) -> Column:
    return F.sort_array(F.filter(counts, lambda c: c["n"] == F.col(total))["item"])


def _part(counts: str, total: str) -> Column:
    return F.sort_array(F.filter(counts, lambda c: c["n"] < F.col(total))["item"])
