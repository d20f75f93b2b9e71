"""Near-duplicate vectors by binary codes of randomly rotated vectors.

A vector of length 1 is padded with zeros to ``BITS`` dimensions and rotated; its code is
the signs. With each code a correction factor is stored: the inner product of the rotated
vector and its code as a vector of length 1. For another vector, its inner product with
the code, divided by that factor, is an unbiased estimate of the two vectors' inner
product, with an error of about ``sqrt((1 - f**2) / f**2 / (BITS - 1))``. Pairs whose upper
confidence bound lies below the threshold are done; the others are computed exactly.

Pairs meet where they share the key of a table: the signs along its own random directions.
The number of signs follows the number of vectors, so that random vectors meet in groups of
bounded size, and the number of tables follows from the chance that a pair at the threshold
shares all signs of one. No two tables have a direction in common, so that a pair that
misses one meets in the next with the same chance. A pair that meets in several tables counts in the first. Tasks return counts of links
and links that span them, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bicspark.llm import vectors as vec
from bicspark.llm.components import components
from bicspark.plans.stages import Stages

BITS = 256
#: Vectors that random vectors share a key with, about; members that meet at a time.
CROWD, BLOCK = 64, 1024
#: The chance with which a pair at the threshold shares some table's key.
FOUND = 0.9999
#: Standard errors that a bound is off the estimate.
BOUND = 4.0
#: Records that one task's group of keys holds, about.
GROUP = 16_384


def tables(n: int, threshold: float) -> tuple[int, int]:
    """How many signs make a key, and how many tables there are, for ``n`` vectors."""
    signs = max(1, min(24, round(math.log2(max(n, 2) / CROWD))))
    same = (1 - math.acos(threshold) / math.pi) ** signs
    count = max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - same))) if same < 1 else 1
    return signs, count


def planes(width: int, signs: int, count: int) -> list[np.ndarray]:
    """The random directions of each table; the same in every run."""
    random = np.random.default_rng([17, width, signs])
    return [random.standard_normal((width, signs)) for _ in range(count)]


def encode(rows: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, sign bits and correction factors."""
    unit = vec.directions(rows)
    turned = unit @ turn
    return unit, turned >= 0, np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[1])


def keys_of(unit: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """One key per direction and table."""
    return np.stack([(unit @ p >= 0) @ (1 << np.arange(p.shape[1], dtype=np.int64)) for p in chosen], axis=1)


def compare(
    left: tuple, right: tuple | None, table: int, threshold: float, turn: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that are linked and meet first in this table.

    Each side is (directions, bits, factors, keys); without a right side, pairs i < j of
    the left.
    """
    other = left if right is None else right
    codes = (other[1] * 2.0 - 1.0).astype(np.float32) / np.float32(math.sqrt(turn.shape[1]))
    estimate = ((left[0] @ turn).astype(np.float32) @ codes.T) / other[2].astype(np.float32)
    spread = np.sqrt((1 - other[2] ** 2).clip(0)) / other[2] / math.sqrt(turn.shape[1] - 1)
    open_ = estimate + (BOUND * spread + 1e-5) >= threshold
    if right is None:
        open_ = np.triu(open_, 1)
    i, j = np.nonzero(open_)
    if not len(i):
        return i, j
    exact = np.einsum("ij,ij->i", left[0][i], other[0][j]) >= threshold
    i, j = i[exact], j[exact]
    earlier = (left[3][i, :table] == other[3][j, :table]).any(axis=1)
    return i[~earlier], j[~earlier]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        np.minimum.at(fresh, label[i], low)
        np.minimum.at(fresh, label[j], low)
        fresh = fresh[fresh][label]
        if (fresh == label).all():
            break
        label = fresh
    return label


def near_duplicates(table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row, linked at cosine ``threshold``.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and keep themselves, and so do vectors of different lengths with each other.
    Repeated rows are vectors of their own, linked by their equality. ``component_id`` is
    the smallest ``vec_id`` that is not null in a component; a row without ``vec_id`` is not
    kept. An empty table gives no rows.
    """
    spark = table.sparkSession
    stages = Stages(spark)
    rows, seen = stages.observed_table(
        table.select("vec_id", "embedding", vec.usable().alias("usable")).withColumn("row_", F.monotonically_increasing_id()),
        "rows",
        n=F.count_if("usable"),
    )
    signs, count = tables(seen["n"], threshold)
    n_groups = max(1, seen["n"] * count // GROUP)

    def place(batches):
        chosen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column("width").to_numpy()
            for width in np.unique(sizes):
                part = batch.filter(pa.array(sizes == width))
                if width not in chosen:
                    chosen[width] = planes(width, signs, count)
                data = vec.matrix(part.column("vector"), width)
                keys = keys_of(vec.directions(data), chosen[width])
                for t in range(count):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]), part.column("width"), part.column("row_"), part.column("vector")],
                        names=["table", "key", "width", "row_", "vector"],
                    )

    usable = vec.valid(rows.where("usable")).select("row_", "vector", F.size("vector").alias("width"))
    placed = usable.mapInArrow(place, "table int, key long, width int, row_ long, vector array<double>")
    keys = ["table", "key", "width"]
    # Keys that many vectors share are cut into blocks that meet pair by pair.
    crowded = usable.mapInArrow(place, "table int, key long, width int, row_ long, vector array<double>").groupBy(*keys).agg(
        F.count("*").alias("members")
    ).where(F.col("members") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int")
    spread = placed.join(crowded, keys, "left").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("row_"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = spread.select(*keys, "row_", "vector", "block", other).select(
        *keys, "row_", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    group = F.pmod(F.xxhash64(*keys, "low", "high"), F.lit(n_groups)).alias("group")

    def meet(found: pa.Table) -> pa.Table:
        columns = {c: found.column(c).to_numpy() for c in ("table", "key", "width", "low", "high", "block", "row_")}
        order = np.lexsort([columns[c] for c in ("block", "high", "low", "key", "width", "table")])
        columns = {c: v[order] for c, v in columns.items()}
        parts = np.stack([columns[c] for c in ("table", "width", "key", "low", "high")])
        cuts = np.flatnonzero(np.append(True, (parts[:, 1:] != parts[:, :-1]).any(axis=0)))
        ends = np.append(cuts[1:], len(order))
        stored = found.column("vector").combine_chunks()
        out_row, out_links, out_head = [], [], []
        for width in np.unique(columns["width"]):
            turn = vec.rotation(width, max(BITS, width), 1)
            of_width = columns["width"] == width
            data = vec.matrix(stored.take(pa.array(order[of_width])), width)
            unit, bits, factor = encode(data, turn)
            all_keys = keys_of(unit, planes(width, signs, count))
            at = np.cumsum(of_width) - 1
            for first, last in zip(cuts, ends):
                if columns["width"][first] != width or last - first < 2:
                    continue
                own = at[np.arange(first, last)]
                side = lambda k: (unit[k], bits[k], factor[k], all_keys[k])
                t, low, high = columns["table"][first], columns["low"][first], columns["high"][first]
                if low == high:
                    i, j = compare(side(own), None, t, threshold, turn)
                else:
                    n_low = int((columns["block"][first:last] == low).sum())
                    i, j = compare(side(own[:n_low]), side(own[n_low:]), t, threshold, turn)
                    j = j + n_low
                if len(i):
                    links = np.bincount(np.append(i, j), minlength=last - first)
                    head = spanning(i, j, last - first)
                    linked = np.flatnonzero(links)
                    row = columns["row_"][first:last]
                    out_row.append(row[linked])
                    out_links.append(links[linked])
                    out_head.append(row[head[linked]])
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"row_": cat(out_row), "n_links": cat(out_links).astype(np.int64), "head": cat(out_head)})

    met = stages.table(
        spread.select(group, *keys, "low", "high", "block", "row_", "vector")
        .groupBy("group")
        .applyInArrow(meet, "row_ long, n_links long, head long"),
        "met",
    )
    counts = met.groupBy("row_").agg(F.sum("n_links").alias("n_links"))
    joined = stages.table(components(met.select(F.col("row_").alias("a"), F.col("head").alias("b")), stages), "components")
    named = rows.select("row_", "vec_id").join(counts, "row_", "left").join(
        joined.withColumnRenamed("id", "row_"), "row_", "left"
    )
    smallest = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("vec_id").alias("smallest"))
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    return named.join(smallest, "component", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
