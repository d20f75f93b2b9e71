"""Nearest neighbours by inner product with multiprobe p-stable hashing.

A vector is hashed by ``floor((a . x + b) / w)`` for several random Gaussian ``a``. To turn
the largest inner product into the smallest distance, rows get one more dimension that
brings all to the longest row's length, queries a zero there and that same length.

A query visits buckets in the order of their estimated success: the probability, for a
neighbour at distance ``R``, of each hash value given where the query's projection lies,
multiplied over the hashes. It goes on until the buckets visited in all tables would hold
such a neighbour with the chance asked for. ``R`` is fitted on a bounded sample of queries
against all rows, and the numbers of tables and hashes are those of the least estimated
work for that chance: far neighbours call for few hashes, near ones for many.
Rows of visited buckets are ranked by the exact inner product, and the tables' results
are merged.

Rows and queries meet in blocks: a table's buckets in groups, each cut by a hash of the
rows' ids, so that a bucket with a third of all rows goes over many tasks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bicspark.llm import vectors as vec
from bicspark.plans.stages import Stages

#: Width of a hash value, in units of the longest row's length.
WIDTH = 1.6
#: Chance with which a neighbour at the fitted distance is in a visited bucket.
SUCCESS = 0.95
#: Of the sample's queries, the share whose last neighbour is within the fitted distance.
WITHIN = 0.9
#: Numbers of tables and hashes to choose from, and the most visits a choice may need.
TABLES, HASHES, VISITS = (2, 3, 4, 6), range(2, 17), 4096
#: Estimated seconds for a visit, for a row of a visited bucket, and for a row of the index.
VISIT_S, ROW_S, INDEX_S = 2e-6, 4e-8, 2e-5
#: Queries and rows of the samples that fit distance and layout.
SAMPLE, SAMPLE_ROWS = 64, 2048
#: Rows and queries that meet in a block, about.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 65_536
#: Scores computed at a time.
CELLS = 1 << 20
_STEPS = np.arange(-3, 4)


class Layout(NamedTuple):
    """How rows are hashed and how far queries look."""

    tables: int
    hashes: int
    distance: float

    @property
    def success(self) -> float:
        """The chance for one table."""
        return 1 - (1 - SUCCESS) ** (1 / self.tables)


def projections(width: int, table: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([29, width, table, count])
    return random.standard_normal((width, count)), random.uniform(0, WIDTH, count)


def lift(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows in units of the longest one, with the dimension that makes them as long."""
    rows = rows / longest
    return np.hstack([rows, np.sqrt(np.clip(1 - (rows**2).sum(axis=1), 0, None))[:, None]])


def lift_queries(rows: np.ndarray) -> np.ndarray:
    return np.hstack([vec.directions(rows), np.zeros((len(rows), 1))])


def bucket_keys(values: np.ndarray) -> np.ndarray:
    """One key per row of hash values."""
    key = np.zeros(len(values), dtype=np.uint64)
    for k in range(values.shape[1]):
        key = (key ^ values[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def probes(spots: np.ndarray, distance: float, success: float, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(query, bucket key) of the buckets to visit in a table, most promising first.

    ``spots`` are the queries' projections over ``WIDTH``. Buckets are built up hash by hash;
    the best of all are among the continuations of the best beginnings, so keeping
    ``most`` beginnings loses none of the best. Queries whose ``most`` best buckets do not
    reach the chance look again with four times as many, until no more exist.
    """
    n, count = spots.shape
    own = np.floor(spots)
    values = own[:, :, None] + _STEPS
    # A neighbour's projection is normal around the query's, with the distance as deviation.
    scale = max(distance, 1e-6) / WIDTH
    chance = _normal((values + 1 - spots[:, :, None]) / scale) - _normal((values - spots[:, :, None]) / scale)
    score = np.ones((n, 1))
    parts = np.zeros((n, 1, 0), dtype=np.int64)
    line = np.arange(n)[:, None]
    for k in range(count):
        grown = (score[:, :, None] * chance[:, None, k, :]).reshape(n, -1)
        keep = min(grown.shape[1], most)
        best = np.argpartition(-grown, keep - 1, axis=1)[:, :keep] if keep < grown.shape[1] else np.tile(np.arange(keep), (n, 1))
        score = grown[line, best]
        step = values[line, k, best % len(_STEPS)].astype(np.int64)
        parts = np.concatenate([parts[line, best // len(_STEPS)], step[:, :, None]], axis=2)
    order = np.argsort(-score, axis=1, kind="stable")
    score, parts = score[line, order], parts[line, order]
    # As many as reach the chance, and the first in any case.
    before = np.cumsum(score, axis=1) - score
    visit = (before < success) & (score > 0)
    visit[:, 0] = True
    short = (score.sum(axis=1) < success) & (most < len(_STEPS) ** count)
    visit[short] = False
    query, place = np.nonzero(visit)
    keys = bucket_keys(parts[query, place])
    if not short.any():
        return query, keys
    again, more = probes(spots[short], distance, success, most * 4)
    query, keys = np.append(query, np.flatnonzero(short)[again]), np.append(keys, more)
    order = np.argsort(query, kind="stable")
    return query[order], keys[order]


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    tail *= t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def nearest(asked: np.ndarray, asked_ids: np.ndarray, visits: np.ndarray, visitor: np.ndarray, rows: np.ndarray, ids: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): each query's ``k`` best rows of the buckets it visits, itself apart."""
    order = np.argsort(key, kind="stable")
    by_visit = np.argsort(visits, kind="stable")
    visits, visitor = visits[by_visit], visitor[by_visit]
    buckets, first = np.unique(key[order], return_index=True)
    last = np.append(first[1:], len(key))
    low, high = np.searchsorted(visits, buckets, "left"), np.searchsorted(visits, buckets, "right")
    # The product of matrices may round equal rows apart: what is close to the k-th stays.
    slack = 1e-9 * np.linalg.norm(asked, axis=1) * np.linalg.norm(rows, axis=1).max()
    least = np.full(len(asked), -np.inf)
    waiting, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def shrink():
        query, at, score = (np.concatenate(x) for x in zip(*waiting))
        by_score = np.lexsort((-score, query))
        query, at, score = query[by_score], at[by_score], score[by_score]
        place = _places(query)
        least[query[place == k - 1]] = (score - slack[query])[place == k - 1]
        keep = score >= least[query]
        return [(query[keep], at[keep], score[keep])]

    for f, l, a, b in zip(first, last, low, high):
        step = max(1, CELLS // min(l - f, CELLS))
        for i in range(f, l, CELLS) if b > a else ():
            some = order[i : min(i + CELLS, l)]
            data = rows[some].T
            for j in range(a, b, step):
                who = visitor[j : min(j + step, b)]
                score = asked[who] @ data
                score[asked_ids[who][:, None] == ids[some][None, :]] = -np.inf
                floor = least[who]
                if len(some) > k:
                    floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k] - slack[who])
                q, x = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
                waiting.append((who[q], some[x], score[q, x]))
                size += len(q)
                if size > CELLS // 4:
                    waiting, size = shrink(), 0
    query, at, _ = shrink()[0]
    score = np.concatenate([(asked[query[i : i + 65_536]] * rows[at[i : i + 65_536]]).sum(axis=1) for i in range(0, len(query), 65_536)] or [np.zeros(0)])
    best = np.lexsort((ids[at], -score, query))
    best = best[_places(query[best]) < k]
    return query[best], at[best], score[best]


def _places(query: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its query, which stand together."""
    at = np.arange(len(query))
    return at - np.maximum.accumulate(np.where(np.append(True, query[1:] != query[:-1])[: len(query)], at, 0))


def search(table: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows nearest each query, itself apart.

    Both tables have ``(vec_id, embedding)``; a query's own rows are all with its
    ``vec_id``. Vectors that are null, empty, zero or hold null or non-finite components,
    rows without a ``vec_id``, and vectors of other lengths than a query's take no part. A
    query with fewer candidates found than asked for, and a repeated row, is answered as far
    as it goes: repeated rows count once. Empty tables give no rows.

    Of equal vectors only the ``k + 1`` smallest ids are indexed. No other can be among the
    ``k`` nearest, as ties go to the smaller id and a query leaves out at most its own.
    """
    spark = table.sparkSession
    stages = Stages(spark)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))

    def take_part(t: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>").alias("vector")
        return t.where(vec.usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), vector)

    equal = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = take_part(table).withColumn("place", equal).where(F.col("place") <= k + 1).dropDuplicates(["vector", "vec_id"])
    rows, seen = stages.observed_table(
        distinct.select("vec_id", "vector", F.size("vector").alias("width"), norm.alias("norm")),
        "rows",
        n=F.count("*"),
        longest=F.max("norm"),
    )
    asked, count = stages.observed_table(
        take_part(queries).dropDuplicates(["vec_id", "vector"]).select("vec_id", "vector", F.size("vector").alias("width")),
        "queries",
        n=F.count("*"),
    )
    n, n_asked, longest = seen["n"], count["n"], seen["longest"]
    schema = "query_id long, rank int, vec_id long, score double"
    if not n or not n_asked or not math.isfinite(longest):
        return spark.createDataFrame([], schema)
    layout = _fit(rows, asked, n, n_asked, longest, k)
    # Blocks: groups of buckets times parts of their rows times parts of the queries.
    blocks = -(-n // BLOCK_ROWS)
    n_groups = math.isqrt(blocks - 1) + 1
    n_cuts, n_parts = -(-blocks // n_groups), -(-n_asked // BLOCK_QUERIES)

    def block(table, part, group, cut):
        return ((table * n_parts + part) * n_groups + group) * n_cuts + cut

    def index(batches):
        for batch in batches:
            for width, part, data in _by_width(batch):
                lifted, ids = lift(data, longest), part.column("vec_id")
                cut = _spread(ids.to_numpy(), n_cuts)
                for t in range(layout.tables):
                    a, b = projections(width + 1, t, layout.hashes)
                    key = bucket_keys(np.floor((lifted @ a + b) / WIDTH))
                    for p in range(n_parts):
                        yield _records(block(t, p, _spread(key, n_groups), cut), key, ids, part.column("vector"), None)

    def visit(batches):
        for batch in batches:
            for width, part, data in _by_width(batch):
                for first in range(0, len(data), 64):
                    some = part.slice(first, 64)
                    lifted, ids = lift_queries(data[first : first + 64]), some.column("vec_id").to_numpy()
                    for t in range(layout.tables):
                        a, b = projections(width + 1, t, layout.hashes)
                        who, keys = probes((lifted @ a + b) / WIDTH, layout.distance, layout.success)
                        group = _spread(keys, n_groups)
                        order = np.lexsort((group, who))
                        who, keys, group = who[order], keys[order], group[order]
                        cuts = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (group[1:] != group[:-1])))
                        owner = who[cuts]
                        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(keys)).astype(np.int32)), pa.array(keys))
                        for cut in range(n_cuts):
                            at = block(t, _spread(ids[owner], n_parts), group[cuts], cut)
                            yield _records(at, None, some.column("vec_id").take(pa.array(owner)), some.column("vector").take(pa.array(owner)), lists)

    def _records(at, key, ids, data, lists):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(at.astype(np.int64)),
                pa.array(key) if key is not None else pa.nulls(len(ids), pa.int64()),
                ids,
                data,
                lists if lists is not None else pa.nulls(len(ids), pa.list_(pa.int64())),
            ],
            names=["block", "key", "vec_id", "vector", "keys"],
        )

    record = "block long, key long, vec_id long, vector array<double>, keys array<long>"

    def rank(found: pa.Table) -> pa.Table:
        asks = found.column("keys").combine_chunks().is_valid()
        width = found.column("width")[0].as_py()
        base, ask = found.filter(pc.invert(asks)), found.filter(asks)
        if not base.num_rows or not ask.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        ids, ask_ids = base.column("vec_id").to_numpy(), ask.column("vec_id").to_numpy()
        lists = ask.column("keys").combine_chunks()
        query, at, score = nearest(
            vec.matrix(ask.column("vector"), width), ask_ids,
            lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()),
            vec.matrix(base.column("vector"), width), ids, base.column("key").to_numpy(), k,
        )
        cuts = np.flatnonzero(_places(query) == 0)
        offsets = pa.array(np.append(cuts, len(query)).astype(np.int32))
        return pa.table(
            {
                "query_id": ask_ids[query[cuts]],
                "ids": pa.ListArray.from_arrays(offsets, pa.array(ids[at])),
                "scores": pa.ListArray.from_arrays(offsets, pa.array(score)),
            }
        )

    records = rows.select("vec_id", "vector", "width").mapInArrow(index, record).unionByName(
        asked.mapInArrow(visit, record)
    )
    ranked = records.withColumn("width", F.size("vector")).groupBy("block", "width").applyInArrow(
        rank, "query_id long, ids array<long>, scores array<double>"
    )
    # A row found in several tables has the same score in each, and counts once.
    each = ranked.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    best = each.groupBy("query_id", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _spread(values: np.ndarray, n: int) -> np.ndarray:
    """A number from 0 to ``n - 1`` for each value."""
    mixed = values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _by_width(batch):
    sizes = batch.column("width").to_numpy()
    for width in np.unique(sizes):
        part = batch.filter(pa.array(sizes == width))
        yield int(width), part, vec.matrix(part.column("vector"), int(width))


def _fit(rows: DataFrame, asked: DataFrame, n: int, n_asked: int, longest: float, k: int) -> Layout:
    """The layout of least estimated work for the distance of the ``k`` nearest rows.

    ``SAMPLE`` queries are compared with all rows; each task returns its best for each of
    them. ``SAMPLE_ROWS`` rows tell what share of the table a layout's visits would read.
    """
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    queries = {w: [r for r in some if r["width"] == w] for w in {r["width"] for r in some}}

    def best(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, part, data in _by_width(batch):
                if width not in queries:
                    continue
                ids = part.column("vec_id").to_numpy()
                score = np.array([r["vector"] for r in queries[width]]) @ data.T
                for r, line in zip(queries[width], score):
                    line = line[ids != r["vec_id"]]
                    own = kept.get(r["vec_id"], np.zeros(0))
                    kept[r["vec_id"]] = -np.sort(-np.append(own, line))[:k]
        found = [(q, float(s)) for q, line in kept.items() for s in line]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["query_id", "score"]
        )

    scores: dict[int, list[float]] = {}
    for row in rows.select("vec_id", "vector", "width").mapInArrow(best, "query_id long, score double").collect():
        scores.setdefault(row["query_id"], []).append(row["score"])
    length = {r["vec_id"]: float(np.linalg.norm(r["vector"])) for r in some}
    # In lifted units a query and its k-th row are sqrt(2 - 2 cos) apart.
    last = [sorted(s, reverse=True)[:k][-1] / (length[q] * longest) for q, s in scores.items() if s]
    distance = math.sqrt(max(2 - 2 * float(np.quantile(last, 1 - WITHIN)), 1e-4)) if last else 1.0

    width = max(queries, key=lambda w: (len(queries[w]), w))
    spots = lift_queries(np.array([r["vector"] for r in queries[width]][:16]))
    sample = rows.where(F.col("width") == width).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()
    if not sample:
        return Layout(min(TABLES), min(HASHES), distance)
    lifted = lift(np.array([r["vector"] for r in sample]), longest)
    cheapest, chosen = math.inf, None
    for tables in TABLES:
        for count in HASHES:
            layout = Layout(tables, count, distance)
            a, b = projections(width + 1, 0, count)
            who, keys = probes((spots @ a + b) / WIDTH, distance, layout.success)
            key = bucket_keys(np.floor((lifted @ a + b) / WIDTH))
            share = np.mean([np.isin(key, keys[who == q]).mean() for q in range(len(spots))])
            cost = tables * (len(keys) / len(spots) * VISIT_S + share * n * ROW_S + n * INDEX_S / n_asked)
            if cost < cheapest:
                cheapest, chosen = cost, layout
            if len(keys) > VISITS * len(spots):
                break
    return chosen
