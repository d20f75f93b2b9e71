"""Items and row sets per range, and the closed frequent itemsets over them.

An item is a column (or ``col#value``), a transaction the items of one row within
one range. A set of items is closed if no further item is shared by all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bicspark.functions.text import item_text
from bicspark.operators import subtree
from bicspark.operators.closure import ArraySteps, JoinSteps, item_counts
from bicspark.operators.ordered import positions
from bicspark.operators.subtree import IN_TASK, Subtrees, mask_of
from bicspark.plans.stages import Stages

NODE = ["level", "node"]
# What tells two row sets apart without listing them: size, ends, the exclusive-or
# of the ids and of two hashes of them. All of these merge over disjoint parts.
ROW_SET = ["n_rows", "row_min", "row_max", "row_xor", "row_hash1", "row_hash2"]

#: Of these FP-growth caches as many in a task.
BASKETS_PER_TASK = 200_000


def transactions(bucketed: DataFrame, item: str = "col") -> DataFrame:
    """``(bucket_id, row_id, items)``: the sorted distinct items of a row in a range.

    A group holds at most the cells of one row. It needs no shuffle if the triples
    come from rows that were gathered by ``row_id``.
    """
    if item not in ("col", "col_value"):
        raise ValueError("item is 'col' or 'col_value'")
    items = F.col("cols") if item == "col" else F.zip_with("cols", "values", item_text)
    return (
        bucketed.select("bucket_id", "row_id", items.alias("items"))
        .groupBy("row_id", "bucket_id")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("bucket_id", "row_id", "items")
    )


def item_tidsets(trans: DataFrame) -> DataFrame:
    """The vertical table ``(bucket_id, item, row_id)``, in long form."""
    return trans.select("bucket_id", F.explode("items").alias("item"), "row_id")


def gather_transactions(tidsets: DataFrame) -> DataFrame:
    """:func:`transactions` back from the vertical table."""
    return tidsets.groupBy("row_id", "bucket_id").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def frequent_items(trans: DataFrame, minsup: int) -> DataFrame:
    """``(bucket_id, item, n_rows)`` of the items with at least ``minsup`` rows."""
    return (
        trans.select("bucket_id", F.explode("items").alias("item"))
        .groupBy("bucket_id", "item")
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") >= minsup)
    )


def keep_frequent(tidsets: DataFrame, frequent: DataFrame) -> DataFrame:
    """The part of the vertical table whose items are frequent."""
    return tidsets.join(frequent.select("bucket_id", "item"), ["bucket_id", "item"], "left_semi")


def pair_support(trans: DataFrame, minsup: int = 1) -> DataFrame:
    """``(bucket_id, item_a, item_b, n_rows)``: rows that two items share, a < b.

    Equal transactions are counted once with their weight before pairs are formed.
    """
    weighted = trans.groupBy("bucket_id", "items").agg(F.count("*").alias("weight"))
    return (
        weighted.select("bucket_id", "items", "weight", F.posexplode("items").alias("at", "item_a"))
        .select(
            "bucket_id",
            "item_a",
            F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"),
            "weight",
        )
        .groupBy("bucket_id", "item_a", "item_b")
        .agg(F.sum("weight").alias("n_rows"))
        .where(F.col("n_rows") >= minsup)
    )


@dataclass(frozen=True)
class ClosedSets:
    """Closed frequent itemsets with the tables that lead back to their rows.

    ``concepts``  (level, node, bucket_id, cols, n_cols, n_rows)
    ``transactions``  (bucket_id, row_id, items) as mined
    ``roots``     (bucket_id, node, n_rows, cols): one record per range
    ``cut``       (bucket_id, items, node, cand, weight, ...): distinct transactions, less rare items
    ``groups``    (tid, node, cand, weight, row set parts): equal transactions merged
    ``steps``     per level below the root, (occurrences of its parents, its nodes)
    ``rows``      (row_id) of the whole matrix, also those in no transaction, if known
    ``subtrees``  what was found in tasks, with :data:`ROW_SET` columns, below nodes of the steps
    """

    concepts: DataFrame
    transactions: DataFrame
    roots: DataFrame
    cut: DataFrame
    groups: DataFrame
    steps: list[tuple[DataFrame, DataFrame]]
    stages: Stages
    rows: DataFrame | None = None
    subtrees: list[tuple[Subtrees, DataFrame]] = field(default_factory=list)

    def occurrences(self, concepts: DataFrame | None = None) -> DataFrame:
        """``(level, node, tid)``: the transaction groups of each concept.

        Given concepts are written down first, as each level takes its own from them.
        Concepts that list their rows are in no group; without the list they fail.
        """
        parts = [below.occurrences(found if concepts is None else concepts) for below, found in self.subtrees]
        return reduce(DataFrame.unionByName, parts, self.level_occurrences(concepts))

    def level_occurrences(self, concepts: DataFrame | None = None) -> DataFrame:
        """:meth:`occurrences` of the concepts that were not found in tasks."""
        if concepts is not None:
            level = F.col("level")
            concepts = concepts.where(level.isNull() | (level != IN_TASK))
            if "rows" in concepts.columns:
                concepts = concepts.where(level >= 0)
            known = F.when(level >= 0, level).otherwise(F.raise_error(F.lit("a concept without its rows")).cast("int"))
            wanted = self.stages.new_table(concepts.select(known.alias("level"), "node").distinct(), "wanted")

        def own(nodes: DataFrame, level: int) -> DataFrame:
            if concepts is None:
                return nodes
            return nodes.join(wanted.where(F.col("level") == level).select("node"), "node", "left_semi")

        roots = own(self.roots.where(F.size("cols") > 0).select("node"), 0)
        parts = [self.groups.join(roots, "node", "left_semi").select(F.lit(0).alias("level"), "node", "tid")]
        for level, (occ, nodes) in enumerate(self.steps, start=1):
            child = occ.select(F.col("node").alias("parent"), "tid", F.explode("cand").alias("item"))
            found = child.join(own(nodes, level).select("parent", "item", "level", "node"), ["parent", "item"])
            parts.append(found.select("level", "node", "tid"))
        return reduce(DataFrame.unionByName, parts)

    def row_groups(self) -> DataFrame:
        """``(bucket_id, row_id, tid)``: the transaction group of each row, per range.

        Written once, as several steps need it.
        """
        return self._row_groups

    @cached_property
    def _row_groups(self) -> DataFrame:
        group = self.cut.join(self.groups.select("node", "cand", "tid"), ["node", "cand"])
        # Sorted by a hash first, as arrays compare slowly.
        key = F.xxhash64("bucket_id", "items").alias("key_")
        rows = self.transactions.select("*", key).join(group.select(key, "bucket_id", "items", "tid"), ["key_", "bucket_id", "items"])
        return self.stages.new_table(rows.select("bucket_id", "row_id", "tid"), "row-groups")

    def extents(self, concepts: DataFrame | None = None) -> DataFrame:
        """``(level, node, row_id)``: the rows of each concept, in long form."""
        found = self.occurrences(concepts).join(self.row_groups(), "tid").select(*NODE, "row_id")
        listed = None if concepts is None else self.listed_rows(concepts)
        return found if listed is None else found.unionByName(listed)

    def listed_rows(self, concepts: DataFrame) -> DataFrame | None:
        """``(level, node, row_id)`` of the concepts below the support, which list their rows."""
        if "rows" not in concepts.columns:
            return None
        return concepts.where(F.col("level") < 0).select(*NODE, F.explode("rows").alias("row_id")).distinct()

    def with_row_sets(self, concepts: DataFrame | None = None) -> DataFrame:
        """Concepts with the :data:`ROW_SET` columns, from merged groups, not rows."""
        if concepts is None:
            # A table per level, so that disk holds the shuffled records of one level at a time.
            sets = [self.stages.new_table(level, "level-row-sets") for level in self._row_sets()]
            upper = self.concepts.where(F.col("level") != IN_TASK).join(reduce(DataFrame.unionByName, sets), NODE)
            return reduce(DataFrame.unionByName, [found for _, found in self.subtrees], upper)
        parts = self.occurrences(concepts).join(self.groups.drop("node"), "tid")
        return concepts.join(parts.groupBy(*NODE).agg(*_merge_row_sets()[1:]), NODE)

    def _row_sets(self) -> Iterator[DataFrame]:
        """Per level ``(level, node, row_min, ...)`` of all its nodes.

        The records of a parent come together before they are listed per child, by piece, so
        that only one record per child and piece is left to shuffle.
        """
        weight, *parts = _merge_row_sets()
        merge = [weight.alias("weight"), *parts]
        sets = self.groups.drop("cand").join(self.roots.where(F.size("cols") > 0).select("node"), "node", "left_semi")
        yield sets.groupBy(F.lit(0).alias("level"), "node").agg(*parts)
        for level, (occ, nodes) in enumerate(self.steps, start=1):
            by = [c for c in ("node", "piece") if c in occ.columns]
            met = occ.drop("weight", "pre").join(self.groups.drop("node", "cand"), "tid")
            if level > 1:  # the records of a root are too many to bring together
                met = met.repartition(*by)
            sets = met.withColumn("item", F.explode("cand")).groupBy(*by, "item").agg(*merge)
            if "piece" in by:
                sets = sets.groupBy("node", "item").agg(*merge)
            named = nodes.select("level", F.col("node").alias("child"), F.col("parent").alias("node"), "item")
            yield sets.join(named, ["node", "item"]).drop("node", "item", "weight").withColumnRenamed("child", "node")


def _row_set_parts() -> list[Column]:
    row = F.col("row_id")
    return [
        F.count("*").alias("weight"),
        F.min(row).alias("row_min"),
        F.max(row).alias("row_max"),
        F.bit_xor(row).alias("row_xor"),
        F.bit_xor(F.xxhash64(row)).alias("row_hash1"),
        F.bit_xor(F.xxhash64(F.lit(1), row)).alias("row_hash2"),
    ]


def _merge_row_sets() -> list[Column]:
    return [
        F.sum("weight").alias("n_rows"),
        F.min("row_min").alias("row_min"),
        F.max("row_max").alias("row_max"),
        F.bit_xor("row_xor").alias("row_xor"),
        F.bit_xor("row_hash1").alias("row_hash1"),
        F.bit_xor("row_hash2").alias("row_hash2"),
    ]


def closed_itemsets(
    trans: DataFrame,
    minsup: int,
    min_cols: int = 1,
    max_level: int | None = None,
    stages: Stages | None = None,
    by_joins: bool | None = None,
    rows: DataFrame | None = None,
) -> ClosedSets:
    """All closed itemsets with at least ``minsup`` rows and ``min_cols`` items, per range.

    Closure extension, level by level (see :mod:`bicspark.operators.closure`). Equal
    transactions of a range are merged with a weight up front, before their rare items go and
    again after, so that no later step works on each row; counts combine before they are shuffled, and no range, node or row set is ever gathered in one place,
    so a hot range spreads over all tasks. Each level is written to a stage table.

    ``max_level`` only guards against a run-away search: if sets remain beyond it,
    the call fails rather than return a part of the result. Items that are columns are
    limited by the width of the matrix, so the steps keep them in arrays; ``col#value``
    items have no such limit and go by joins. ``by_joins`` sets this for any items.
    ``rows`` are the ``row_id`` of the whole matrix, which the result carries on.
    """
    if minsup < 1:
        raise ValueError("minsup must be at least 1")
    stages = stages or Stages(trans.sparkSession)
    if min_cols > 1:
        # A row with fewer items in a range cannot belong to such a set.
        trans = trans.where(F.size("items") >= min_cols)
    members = stages.table(trans.select("bucket_id", "row_id", "items"), "members")
    merged = members.groupBy("bucket_id", "items").agg(*_row_set_parts())
    merged = stages.table(merged.select(F.monotonically_increasing_id().alias("mid"), "*"), "merged")
    counts = stages.table(item_counts(merged, minsup), "counts-0")
    if by_joins is None:
        by_joins = dict(trans.dtypes)["items"] == "array<string>"
    steps = (JoinSteps if by_joins else ArraySteps)(counts, minsup, stages)
    cut = steps.cut(merged)
    groups, n_groups = stages.counted_table(_groups(cut), "groups", F.lit(True))
    nodes = steps.roots.select("node", "bucket_id", "cols", "n_rows", F.lit(0).alias("level"))
    occ = groups.select(
        "node", "tid", "weight", "cand", F.slice("cand", 1, 0).alias("pre")
    ).where(F.size("cand") > 0)
    # All records of a range are those of its root.
    occ = occ.withColumn("piece", F.lit(1))

    found = [nodes]
    passed = []
    subtrees: list[tuple[Subtrees, DataFrame]] = []
    n_parts = 0
    inner = (F.col("n_ext") > 0) & (F.size("cols") + F.col("n_ext") >= min_cols)
    busy, tasks = stages.spread(occ, n_groups, "tid"), 1
    for level in _levels(max_level):
        nodes, seen = stages.observed_table(
            steps.children(busy, nodes, tasks),
            f"nodes-{level}",
            n_inner=F.count_if(inner),
            n_occ=F.sum(F.when(inner, F.col("n_occ"))),
            largest=F.max(F.when(inner, F.col("n_occ"))),
        )
        passed.append((occ, nodes))
        found.append(nodes)
        if seen["n_inner"] == 0:
            break
        left = nodes.where(inner)
        if max_level is None and not by_joins and seen["n_occ"] > subtree.LEVEL_RECORDS:
            roots, n = _roots_of_tasks(steps, left, stages)
            if n:
                below = _subtrees(steps, roots, busy, groups, minsup, min_cols, n_parts, stages)
                n_parts += below.n_parts
                subtrees.append((below, stages.new_table(below.sets(), "found-in-tasks")))
                left = left.join(roots.select("node"), "node", "left_anti")
                seen = left.agg(F.count("*").alias("n_inner"), F.sum("n_occ").alias("n_occ"), F.max("n_occ").alias("largest")).first()
                if not seen["n_inner"]:
                    break
        below = stages.cut_up(steps.descend(busy, left), "tid", "n_occ", seen["n_occ"], seen["largest"])
        occ = busy = stages.table(below, f"occ-{level}")
        tasks = stages.tasks(seen["n_occ"])

    concepts = reduce(
        DataFrame.unionByName,
        [t.select(*NODE, "bucket_id", "cols", F.size("cols").alias("n_cols"), "n_rows") for t in [*found, *[t for _, t in subtrees]]],
    ).where(F.col("n_cols") >= max(min_cols, 1))
    return ClosedSets(concepts, members, steps.roots, cut, groups, passed, stages, rows, subtrees)


def _narrow(steps: ArraySteps) -> DataFrame:
    """``(bucket_id, range_node, items)`` of the ranges whose items a mask holds."""
    narrow = steps.roots.where(F.size("ext") <= subtree.MASK_ITEMS)
    return narrow.select("bucket_id", F.col("node").alias("range_node"), F.col("ext").alias("items"))


def _roots_of_tasks(steps: ArraySteps, nodes: DataFrame, stages: Stages) -> tuple[DataFrame, int]:
    """Those of a level's nodes that are left to tasks, numbered as ``root``, and the sum of their records."""
    few = nodes.where(F.col("n_occ") <= subtree.NODE_RECORDS).join(_narrow(steps), "bucket_id")

    def place(item: Column) -> Column:
        return F.when(F.array_contains("cols", item), -1).otherwise(F.array_position("items", item) - 1)

    few = few.withColumn("items_left", F.array_except("items", "cols")).select(
        "*",
        mask_of("ext", "items").alias("may"),
        mask_of("pre", "items").alias("out"),
        F.size("cols").alias("n_above"),
    )
    few = few.withColumn("universe", F.sort_array(F.concat("cols", "items_left")))
    few = few.withColumn("place", F.transform("universe", place))
    numbered, seen = stages.observed_table(positions(few, [F.col("node")], stages, "root"), f"roots-{uuid4().hex}", n=F.sum("n_occ"))
    return numbered, seen["n"] or 0


def _subtrees(
    steps: ArraySteps, roots: DataFrame, occ: DataFrame, groups: DataFrame, minsup: int, min_cols: int, before: int, stages: Stages
) -> Subtrees:
    parts = [c for c in groups.columns if c in ROW_SET]
    masks = groups.join(_narrow(steps), F.col("node") == F.col("range_node")).select(
        "tid", "weight", *parts, mask_of("cand", "items").alias("mask")
    )
    records = (
        steps.descend(occ, roots)
        .select("node", "tid")
        .join(roots.select("node", "root", "may", "out"), "node")
        .join(masks, "tid")
        .select(
            "root",
            "tid",
            F.col("mask").bitwiseAND(F.col("may")).alias("cand"),
            F.col("mask").bitwiseAND(F.col("out")).alias("pre"),
            "weight",
            *parts,
        )
    )
    records, n = stages.counted_table(records, f"records-of-tasks-{uuid4().hex}", F.lit(True))
    return Subtrees.dealt(roots, records, n, before, minsup, min_cols, parts, stages)


def _levels(max_level: int | None) -> Iterator[int]:
    level = 1
    while max_level is None or level <= max_level:
        yield level
        level += 1
    raise RuntimeError(f"closed sets remain below level {max_level}: raise minsup, min_cols or max_level")


def _groups(cut: DataFrame) -> DataFrame:
    """Merge the transactions of a range that have equal frequent items."""
    weight, *parts = _merge_row_sets()
    merged = cut.groupBy("node", "cand").agg(weight.alias("weight"), *parts)
    return merged.select(F.monotonically_increasing_id().alias("tid"), "*")


def frequent_itemsets(trans: DataFrame, minsup: int) -> DataFrame:
    """All frequent itemsets ``(bucket_id, cols, n_rows)``, closed or not, by FP-growth.

    One model serves all ranges: items carry their range as a prefix, so no itemset
    mixes ranges. The number of sets is exponential in the longest closed one; it
    is the input of :func:`closed_filter` and a cross-check of
    :func:`closed_itemsets`, which is the way to mine at scale.
    """
    from pyspark.ml.fpm import FPGrowth

    tagged = F.transform("items", lambda i: F.concat_ws("|", F.col("bucket_id").cast("string"), i.cast("string")))
    stages = Stages(trans.sparkSession)
    baskets, n = stages.counted_table(trans.select(tagged.alias("items")), "baskets", F.lit(True))
    # Baskets compress well and FP-growth caches them as they are, so a task takes a number of them, not a file split.
    groups = int(trans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = baskets.repartition(max(-(-n // BASKETS_PER_TASK), min(groups, max(1, n))))
    # FP-growth takes a share and rounds share * n up; the half keeps that at minsup.
    sets = FPGrowth(itemsCol="items", minSupport=(minsup - 0.5) / max(n, 1), numPartitions=groups).fit(spread).freqItemsets
    types = dict(trans.dtypes)
    item_type = types["items"][len("array<") : -1]
    return sets.select(
        F.substring_index(F.col("items")[0], "|", 1).cast(types["bucket_id"]).alias("bucket_id"),
        F.sort_array(
            F.transform("items", lambda i: F.regexp_extract(i, r"^[^|]*\|(.*)$", 1).cast(item_type))
        ).alias("cols"),
        F.col("freq").alias("n_rows"),
    )


def closed_filter(itemsets: DataFrame) -> DataFrame:
    """Of frequent itemsets ``(bucket_id, cols, n_rows)``, keep the closed ones.

    A set is not closed if some set with one item more has the same count. Each
    set is joined to its one-item-shorter subsets on (range, count, items).
    """
    shorter = itemsets.where(F.size("cols") > 1).select(
        "bucket_id",
        "n_rows",
        F.explode(
            F.transform("cols", lambda _, i: F.concat(F.slice("cols", F.lit(1), i), F.slice("cols", i + 2, F.size("cols"))))
        ).alias("cols"),
    )
    return itemsets.join(shorter, ["bucket_id", "cols", "n_rows"], "left_anti")


def itemset_rows(itemsets: DataFrame, trans: DataFrame) -> DataFrame:
    """Any collection of itemsets ``(bucket_id, cols)`` with the :data:`ROW_SET` columns of each.

    A row has an itemset if it has as many of its items as it has items. Equal
    transactions are merged with a weight first, so what meets the itemsets' items are
    groups of rows, not rows. Itemsets without a row are left out, empty ones too;
    repeated ones come once.
    """
    stages = Stages(trans.sparkSession)
    groups = trans.groupBy("bucket_id", "items").agg(*_row_set_parts())
    groups = stages.table(groups.select(F.monotonically_increasing_id().alias("tid"), "*"), "merged")
    wanted = stages.table(itemsets.select("bucket_id", F.sort_array(F.array_distinct("cols")).alias("cols")).distinct().select(
        F.monotonically_increasing_id().alias("set"), "*"
    ), "itemsets")
    by_item = wanted.select("bucket_id", "set", F.size("cols").alias("n_items"), F.explode("cols").alias("item"))
    having = (
        groups.select("bucket_id", "tid", F.explode("items").alias("item"))
        .join(by_item, ["bucket_id", "item"])
        .groupBy("set", "tid")
        .agg(F.count("*").alias("n"), F.first("n_items").alias("n_items"))
        .where(F.col("n") == F.col("n_items"))
        .select("set", "tid")
    )
    rows = having.join(groups.drop("bucket_id", "items"), "tid").groupBy("set").agg(*_merge_row_sets())
    return wanted.join(rows, "set").drop("set")


def subsumption_filter(itemsets: DataFrame, trans: DataFrame) -> DataFrame:
    """Of any collection of itemsets, those that no larger one of it has the rows of.

    Unlike :func:`closed_filter` it needs no complete collection: a set goes also where
    the sets between it and the larger one are missing. Sets meet on their range and
    :data:`ROW_SET`, so only sets of the same rows are compared, by containment. Returns
    ``(bucket_id, cols, n_rows, ...)``.
    """
    stages = Stages(trans.sparkSession)
    known = stages.table(itemset_rows(itemsets, trans), "known")
    keys = ["bucket_id", *ROW_SET]
    larger = known.select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("cols").alias("more"))
    covered = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys] + [
        F.size("cols") < F.size("more"),
        F.size(F.array_except("cols", "more")) == 0,
    ]
    return known.join(larger, reduce(Column.__and__, covered), "left_anti")


def row_bitmaps(trans: DataFrame) -> DataFrame:
    """``(bucket_id, item, chunk, bits)``: the row set of each item as bitmaps of 32,768 rows.

    A row set costs 4 kB per chunk that it touches, whatever its size, so it suits ids that
    lie close together. Bitmaps are built in each task and united after the shuffle.
    """
    return item_tidsets(trans).groupBy("bucket_id", "item", F.bitmap_bucket_number("row_id").alias("chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("row_id")).alias("bits")
    )


def common_rows(trans: DataFrame, size: int = 3, minsup: int = 1) -> DataFrame:
    """``(bucket_id, items, n_rows)``: the rows that each ``size`` items of a range share.

    The bitmaps of a chunk's items come together, at most one per item, and every choice
    of ``size`` of them is intersected there and counted. No row id is joined. Choices
    grow with the number of items to that power, so it is for few items, as columns are.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    chunks = row_bitmaps(trans).groupBy("bucket_id", "chunk").agg(F.sort_array(F.collect_list("item")).alias("all_items"))
    chosen = chunks.select("*", F.transform("all_items", lambda i: F.array(i)).alias("sets"))
    for _ in range(size - 1):
        longer = F.flatten(
            F.transform(
                "sets",
                lambda s: F.transform(
                    F.filter("all_items", lambda i: i > F.element_at(s, -1)), lambda i: F.array_append(s, i)
                ),
            )
        )
        chosen = chosen.withColumn("sets", longer)
    one = chosen.select("bucket_id", "chunk", F.explode("sets").alias("items"))
    parts = one.select("*", F.explode("items").alias("item")).join(row_bitmaps(trans), ["bucket_id", "chunk", "item"])
    shared = parts.groupBy("bucket_id", "chunk", "items").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return shared.groupBy("bucket_id", "items").agg(F.sum("n").alias("n_rows")).where(F.col("n_rows") >= minsup)


def subsupport_items(trans: DataFrame, minsup: int) -> DataFrame:
    """Single items with fewer than ``minsup`` rows: ``(bucket_id, rows, cols)``.

    Of the items with one and the same row set in a range, the first in string
    order stands for all. Rows are listed, as there are fewer than ``minsup``.
    """
    tidsets = item_tidsets(trans)
    rare = tidsets.groupBy("bucket_id", "item").agg(F.count("*").alias("n")).where(F.col("n") < minsup)
    listed = (
        tidsets.join(rare.select("bucket_id", "item"), ["bucket_id", "item"], "left_semi")
        .groupBy("bucket_id", "item")
        .agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
    )
    return listed.groupBy("bucket_id", "rows").agg(
        F.array(F.min_by("item", F.col("item").cast("string"))).alias("cols"),
    )
