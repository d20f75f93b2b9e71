"""Mixing sources to target weights by a minimum-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a
flow routes the words of each pattern to the quotas of its sources. The r-th repetition
of a pattern costs ``2 r - 1`` a word, so repeats are spread before anything is taken
once more. The network has one node per pattern and per source, which is all that
reaches the driver. Documents of a pattern are then selected in a seeded order.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bicspark.llm.common import free_name, n_words, seeded, source_key, with_row_key
from bicspark.llm.prefix import running
from bicspark.plans.stages import Stages

#: More patterns or sources than this are an error, as the network is solved on the driver.
MAX_NODES = 20_000
WEIGHTS = (5, 2, 1)


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(stratum, source_size, target)`` from ``(stratum, source_size)``.

    In the order of ``stratum`` sources weigh 5, 2, 1, repeating. They share ``share``
    of all words by weight; a target stops at ``most`` times its source, and the excess
    is shared by weight among the others until none is above. Stops are reached in the
    order of size by weight, so the final level is a running sum over that order. The
    table has one small record per source.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighted = sources.select(
        "stratum",
        "source_size",
        F.element_at(weights, (F.row_number().over(Window.orderBy("stratum")) - 1) % len(WEIGHTS) + 1).alias("weight"),
    ).withColumn("room", F.col("source_size") * F.lit(float(most)))
    by_stop = Window.orderBy(F.col("room") / F.col("weight"), "stratum")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("room").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * F.lit(share) - before) / rest
    levels = weighted.withColumn("level", level)
    # The first source in that order whose stop lies above the level sets it for all.
    final = F.min(F.when(F.col("room") > F.col("level") * F.col("weight"), F.struct(F.col("room") / F.col("weight"), "stratum", "level"))).over(whole)["level"]
    return levels.withColumn("final", final).select(
        "stratum",
        "source_size",
        F.coalesce(F.least("room", F.col("final") * F.col("weight")), F.col("room")).alias("target"),
    )


def min_cost_flow(sizes: dict, quotas: dict, max_repeats: int) -> dict:
    """Words that each pattern gives each of its sources: ``{pattern: {source: words}}``.

    ``sizes`` maps a pattern (a tuple of sources) to its words, ``quotas`` a source to
    the words it wants. Costs depend on the repetition only, so shortest ways first
    means: fill what repetition 1 can give, over all sources, before repetition 2.
    """
    flow: dict = {p: {} for p in sizes}
    used = dict.fromkeys(sizes, 0)
    members: dict = {s: [] for s in quotas}
    for pattern in sorted(p for p in sizes if sizes[p] > 0):
        for source in pattern:
            members[source].append(pattern)
    left = dict(quotas)
    for repeat in range(1, max_repeats + 1):
        room = {p: repeat * words for p, words in sizes.items()}
        for source in sorted(quotas):
            while left[source] > 0 and (way := _way(source, members, flow, used, room)):
                end = way[-1][0]
                passed = list(zip(way, way[1:]))
                step = min([left[source], room[end] - used[end], *[flow[p][other] for (p, _), (_, other) in passed]])
                for pattern, taker in way:
                    flow[pattern][taker] = flow[pattern].get(taker, 0) + step
                for (pattern, _), (_, other) in passed:
                    flow[pattern][other] -= step
                used[end] += step
                left[source] -= step
    return flow


def _way(source, members, flow, used, room):
    """The shortest way from a source to a pattern with room, as (pattern, taker) steps.

    A full pattern is passed by taking words that it gives another source, which then
    takes as many elsewhere.
    """
    found = {source: []}
    queue = deque([source])
    seen = set()
    while queue:
        taker = queue.popleft()
        for pattern in members[taker]:
            if pattern in seen:
                continue
            seen.add(pattern)
            way = [*found[taker], (pattern, taker)]
            if used[pattern] < room[pattern]:
                return way
            for other, words in flow[pattern].items():
                if words > 0 and other not in found:
                    found[other] = way
                    queue.append(other)
    return None


def _few(table: DataFrame, what: str) -> list:
    found = table.limit(MAX_NODES + 1).collect()
    if len(found) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} {what} in the network")
    return found


def mix(
    docs: DataFrame, size: Column, members: Column, targets: DataFrame, max_repeats: int = 2, seed: str = "mix", key: str = "doc_id"
) -> DataFrame:
    """``(<key>, size, members, copies, taken)``: how often each document is taken.

    ``members`` is an array of strata; ``targets`` has ``(stratum, target)``. Copies of a
    pattern are whole rounds over its documents and one part of a round: a seeded prefix
    as close below the words left as whole documents allow, and then the one other
    document that brings the sum closest. Reruns agree. Documents without a word or
    without a stratum that has a target are taken 0 times; repeated rows are documents
    of their own.
    """
    stages = Stages(docs.sparkSession)
    rows, seen = stages.observed_table(
        docs.select(
            F.col(key),
            size.alias("size"),
            F.array_sort(F.array_distinct(members)).alias("members"),
            seeded(seed, F.col(key)).alias("unit"),
        ),
        "rows",
        n=F.count("*"),
    )
    quotas = {r["stratum"]: round(r["target"]) for r in _few(targets.select("stratum", "target"), "sources")}
    found = _few(rows.groupBy("members").agg(F.sum("size").alias("words")), "patterns")
    sizes = {tuple(r["members"]): r["words"] for r in found}
    wanted_by = {p: tuple(s for s in p if s in quotas) for p in sizes}
    nodes: dict = {}
    for pattern, words in sizes.items():
        nodes[wanted_by[pattern]] = nodes.get(wanted_by[pattern], 0) + words
    flow = min_cost_flow(nodes, quotas, max_repeats)
    plan = []
    for pattern, words in sizes.items():
        # Patterns that differ only in sources without a target share one node by size.
        given = sum(flow[wanted_by[pattern]].values()) * words // max(nodes[wanted_by[pattern]], 1)
        plan.append((list(pattern), given // max(words, 1), given % max(words, 1)))
    spark = docs.sparkSession
    wanted = spark.createDataFrame(
        plan, "members array<string>, rounds long, rest long"
    )
    ranked = stages.table(
        running(rows.where("size > 0"), seen["n"], ["members"], F.col("unit"), ["unit", key, "size"], F.col("size"))
        .join(wanted, "members", "left"),
        "ranked",
    )
    inside = F.col("before") + F.col("size") <= F.col("rest")
    # The words that the prefix leaves open, then the document closest to them.
    gaps = ranked.groupBy("members").agg(
        (F.first("rest") - F.coalesce(F.max(F.when(inside, F.col("before") + F.col("size"))), F.lit(0))).alias("gap")
    )
    rank = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "unit", "place")
    last = (
        ranked.where(~inside).join(gaps, "members").groupBy("members")
        .agg(F.min(rank).alias("best"), F.first("gap").alias("gap"))
        .where(F.col("best.off") < F.col("gap"))
        .select("members", F.col("best.place").alias("place"), F.lit(1).alias("last"))
    )
    copies = F.coalesce("rounds", F.lit(0)) + F.when(inside, 1).otherwise(F.coalesce("last", F.lit(0)))
    copies = F.least(copies, F.lit(max_repeats).cast("bigint"))
    taken = ranked.join(last, ["members", "place"], "left").select(key, "size", "members", copies.cast("bigint").alias("copies"))
    rest = rows.where("size = 0").select(key, "size", "members", F.lit(0).cast("bigint").alias("copies"))
    return taken.unionByName(rest).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents mixed by their one source: ``(<key>, size, source_size, target, copies, taken)``.

    Sizes count words; a null text has none, and a null source is the last source.
    """
    stages = Stages(docs.sparkSession)
    sized = stages.table(docs.select(F.col(key), n_words().alias("size"), source_key().alias("stratum")), "sized")
    targets = stages.table(
        source_targets(sized.groupBy("stratum").agg(F.sum("size").alias("source_size"))), "targets"
    )
    mixed = mix(sized, F.col("size"), F.array("stratum"), targets, key=key)
    return mixed.withColumn("stratum", F.element_at("members", 1)).join(targets, "stratum").select(
        key, "size", "source_size", "target", "copies", "taken"
    )


def mixture(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of the mix: every document as often as it is taken.

    Columns keep their names and values. Rows are told apart by a key of their own, so
    repeated and null ids are documents like others.
    """
    row, copies, copy = (free_name(c, docs.columns) for c in ("row", "copies", "copy"))
    keyed = with_row_key(docs, row, Stages(spark))
    mixed = mix_documents(keyed, key=row).select(row, F.col("copies").alias(copies)).where(F.col(copies) > 0)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))
    return keyed.join(mixed, row).select(*docs.columns, each.alias(copy)).drop(copy)
