import glob
import os
import random
import tempfile
import time
from functools import reduce
from itertools import combinations
from operator import xor

import pytest
from pyspark.sql import functions as F

from bicspark.operators import closure
from bicspark.operators import concepts as con
from bicspark.operators import itemsets as its
from bicspark.plans.stages import Stages
from tests import brute


def random_transactions(seed, n_rows, n_cols, n_buckets=2, density=0.5):
    rng = random.Random(seed)
    return {
        b: {
            r: {c for c in range(n_cols) if rng.random() < density} | ({99} if b == 1 else set())
            for r in range(100 * seed, 100 * seed + n_rows)
        }
        for b in range(n_buckets)
    }


def frame(spark, trans):
    rows = [(b, r, sorted(s)) for b, rows in trans.items() for r, s in rows.items() if s]
    return spark.createDataFrame(rows, "bucket_id int, row_id bigint, items array<int>")


def mined(closed, concepts=None):
    rows = (
        closed.extents(concepts)
        .groupBy(*its.NODE)
        .agg(F.collect_list("row_id").alias("rows"))
        .join(closed.concepts, its.NODE)
        .collect()
    )
    for r in rows:
        assert len(r.rows) == len(set(r.rows)) == r.n_rows and len(r.cols) == r.n_cols
    keys = [(r.bucket_id, tuple(r.cols)) for r in rows]
    assert len(keys) == len(set(keys))
    return {(r.bucket_id, tuple(r.cols)): frozenset(r.rows) for r in rows}


def set_of(trans):
    return {b: {r: set(s) for r, s in rows.items() if s} for b, rows in trans.items()}


@pytest.mark.parametrize("seed,n_rows,n_cols,minsup,density", [(1, 12, 5, 1, 0.5), (2, 40, 6, 3, 0.6)])
def test_closed_itemsets_against_all_subsets(spark, seed, n_rows, n_cols, minsup, density):
    trans = random_transactions(seed, n_rows, n_cols, density=density)
    every = brute.closed_sets(set_of(trans), minsup)
    assert mined(its.closed_itemsets(frame(spark, trans), minsup)) == every
    assert mined(its.closed_itemsets(frame(spark, trans), minsup, by_joins=True)) == every


def test_min_cols_keeps_the_larger_sets_unchanged(spark):
    trans = random_transactions(4, 30, 7)
    every = brute.closed_sets(set_of(trans), 2)
    closed = its.closed_itemsets(frame(spark, trans), 2, min_cols=4)
    assert mined(closed) == {k: v for k, v in every.items() if len(k[1]) >= 4}


def test_result_does_not_depend_on_row_order_or_partitions(spark):
    trans = frame(spark, random_transactions(5, 30, 6))
    first = mined(its.closed_itemsets(trans, 2))
    again = mined(its.closed_itemsets(trans.orderBy(F.rand(1)).repartition(7), 2))
    assert first == again


def test_hot_group_of_equal_rows(spark):
    rows = [(0, r, [1, 2, 3]) for r in range(500)] + [(0, 500 + r, [2, 3, 4]) for r in range(3)] + [(0, 600, [4])]
    trans = spark.createDataFrame(rows, "bucket_id int, row_id bigint, items array<int>")
    closed = its.closed_itemsets(trans, 2)
    assert closed.groups.count() == 3
    assert {k[1]: len(v) for k, v in mined(closed).items()} == {(2, 3): 503, (1, 2, 3): 500, (2, 3, 4): 3, (4,): 4}


def test_row_sets_are_those_of_the_rows(spark):
    trans = random_transactions(6, 30, 6)
    closed = its.closed_itemsets(frame(spark, trans), 2)
    own = {(r.bucket_id, tuple(r.cols)): r for r in closed.with_row_sets().collect()}
    for key, rows in mined(closed).items():
        xor = 0
        for r in rows:
            xor ^= r
        r = own[key]
        assert (r.n_rows, r.row_min, r.row_max, r.row_xor) == (len(rows), min(rows), max(rows), xor)


def test_no_transactions(spark):
    empty = spark.createDataFrame([], "bucket_id int, row_id bigint, items array<int>")
    assert its.closed_itemsets(empty, 2).concepts.count() == 0


def test_a_level_limit_fails_rather_than_cut_the_result(spark):
    trans = frame(spark, random_transactions(7, 20, 6))
    with pytest.raises(RuntimeError, match="level 1"):
        its.closed_itemsets(trans, 1, max_level=1)


def test_fp_growth_and_filter_give_the_same_closed_sets(spark):
    trans = frame(spark, random_transactions(8, 25, 6))
    every = its.frequent_itemsets(trans, 3)
    kept = {(r.bucket_id, tuple(r.cols)): r.n_rows for r in its.closed_filter(every).collect()}
    closed = its.closed_itemsets(trans, 3).concepts
    assert kept == {(r.bucket_id, tuple(r.cols)): r.n_rows for r in closed.collect()}
    assert every.count() > len(kept)


def test_vertical_table_and_supports(spark):
    trans = spark.createDataFrame(
        [(0, 1, ["a", "b"]), (0, 2, ["a"]), (0, 3, ["a", "b"]), (1, 1, ["b"])],
        "bucket_id int, row_id bigint, items array<string>",
    )
    tidsets = its.item_tidsets(trans)
    assert tidsets.count() == 6
    frequent = its.frequent_items(trans, 2)
    assert sorted(map(tuple, frequent.collect())) == [(0, "a", 3), (0, "b", 2)]
    assert its.keep_frequent(tidsets, frequent).count() == 5
    assert sorted(map(tuple, its.pair_support(trans).collect())) == [(0, "a", "b", 2)]
    back = {(r.bucket_id, r.row_id): r["items"] for r in its.gather_transactions(tidsets).collect()}
    assert back == {(r.bucket_id, r.row_id): r["items"] for r in trans.collect()}


def test_subsupport_items_collapse_to_the_first_in_string_order(spark):
    trans = spark.createDataFrame(
        [(0, 1, [2, 9, 10]), (0, 2, [2, 9, 10]), (0, 3, [2, 7])], "bucket_id int, row_id bigint, items array<int>"
    )
    found = {(tuple(r.rows), tuple(r.cols)) for r in its.subsupport_items(trans, 3).collect()}
    assert found == {((1, 2), (10,)), ((3,), (7,))}


def test_transactions_of_columns_and_of_values(spark):
    runs = spark.createDataFrame(
        [(1, 0, [3, 1, 2], [1.0, 2.0, 3.5]), (1, 0, [1, 2, 10], [2.0, 3.5, 4.0])],
        "row_id bigint, bucket_id int, cols array<int>, values array<double>",
    )
    assert its.transactions(runs).first()["items"] == [1, 2, 3, 10]
    assert its.transactions(runs, "col_value").first()["items"] == ["1#2.0", "10#4.0", "2#3.5", "3#1.0"]


def test_concepts_over_ranges(spark):
    rows = [(0, r, [1, 2]) for r in (1, 2, 3)] + [(1, r, [1, 2]) for r in (1, 2, 3)] + [(2, r, [5, 6, 7]) for r in (1, 2, 3)]
    rows += [(3, r, [1, 2]) for r in (1, 2, 4)]
    trans = spark.createDataFrame(rows, "bucket_id int, row_id bigint, items array<int>")
    closed = its.closed_itemsets(trans, 2)
    numbered = con.number_row_sets(closed)
    distinct = con.distinct_concepts(numbered)
    got = {(r.n_rows, r.row_max, tuple(r.cols)): r.bucket_ids for r in distinct.collect()}
    assert got == {(3, 3, (1, 2)): [0, 1], (3, 3, (5, 6, 7)): [2], (3, 4, (1, 2)): [3]}
    grouped = {r.row_max: (r.col_sets, r.n_sets) for r in con.group_by_rows(distinct).collect()}
    assert grouped == {3: ([[1, 2], [5, 6, 7]], 2), 4: ([[1, 2]], 1)}
    longest = {r.row_max: (r.cols, r.n_dup) for r in con.longest_per_rows(distinct).collect()}
    assert longest == {3: ([5, 6, 7], 2), 4: ([1, 2], 1)}
    ranked = [(r.row_max, tuple(r.cols), r.n_sets) for r in con.rank_concepts(distinct).collect()]
    assert ranked == [(3, (1, 2), 2), (3, (5, 6, 7), 2), (4, (1, 2), 1)]
    assert con.rank_concepts(distinct, least_cols=3, limit=5).count() == 1
    assert con.min_cols(distinct, 3).count() == 1


def test_row_sets_with_equal_hashes_are_still_told_apart(spark, monkeypatch):
    """With hashes that say nothing, the row by row check must separate the sets."""
    blind = [F.max(F.lit(0).cast("bigint")).alias(c) for c in its.ROW_SET[1:]]
    monkeypatch.setattr(its, "_row_set_parts", lambda: [F.count("*").alias("weight"), *blind])
    rows = [(0, r, [1]) for r in (1, 2)] + [(1, r, [1]) for r in (1, 2)]
    rows += [(2, r, [1]) for r in (3, 4)] + [(3, r, [1]) for r in (3, 4)] + [(4, r, [1]) for r in (5, 6)]
    trans = spark.createDataFrame(rows, "bucket_id int, row_id bigint, items array<int>")
    numbered = con.number_row_sets(its.closed_itemsets(trans, 2))
    distinct = con.distinct_concepts(numbered)
    assert sorted(r.bucket_ids for r in distinct.collect()) == [[0, 1], [2, 3], [4]]


def test_only_groups_of_compared_concepts_are_met(spark):
    rows = [(0, r, [1]) for r in range(4)] + [(0, r, [2]) for r in range(4, 10)]
    rows += [(1, r, [7]) for r in range(4)] + [(1, r, [8]) for r in range(4, 13)]
    trans = spark.createDataFrame(rows, "bucket_id int, row_id bigint, items array<int>")
    closed = its.closed_itemsets(trans, 2)
    distinct = con.distinct_concepts(con.number_row_sets(closed)).collect()
    assert sorted((r.n_rows, r.row_min) for r in distinct) == [(4, 0), (4, 0), (6, 4), (9, 4)]
    assert len({(r.rows_level, r.rows_node) for r in distinct}) == 3
    cells = spark.read.parquet(f"{closed.stages.folder}/cells-*").collect()
    assert [c.n_shared for c in cells] == [4]


def test_having_value(spark):
    df = spark.createDataFrame([(["1#16.0", "2#3.0"],), (["1#1.0"],)], "cols array<string>")
    assert con.having_value(df, 16).count() == 1


def test_hot_node_is_cut_over_tasks_and_counts_stay_whole(spark, monkeypatch):
    from bicspark.plans import stages

    monkeypatch.setattr(stages, "RECORDS_PER_TASK", 5)
    trans = random_transactions(9, 60, 6, density=0.7)
    assert mined(its.closed_itemsets(frame(spark, trans), 3)) == brute.closed_sets(set_of(trans), 3)
    df = spark.createDataFrame([(1, t, 90) for t in range(90)] + [(2, t, 4) for t in range(4)], "node int, tid int, n bigint")
    spread = stages.Stages(spark).spread_by(df, "node", "tid", "n", 94)
    parts = spread.select("node", F.spark_partition_id().alias("p")).distinct().groupBy("node").count()
    assert {r.node: r["count"] > 1 for r in parts.collect()} == {1: True, 2: False}
    assert spread.count() == 94 and spread.columns == ["node", "tid"]


@pytest.mark.parametrize("by_joins", [False, True])
def test_rows_and_row_sets_of_nodes_in_pieces(spark, monkeypatch, by_joins):
    from bicspark.plans import stages

    monkeypatch.setattr(stages, "RECORDS_PER_TASK", 5)
    monkeypatch.setattr(stages.Stages, "tasks", lambda self, n_records: 12)
    trans = random_transactions(9, 60, 6, density=0.7)
    closed = its.closed_itemsets(frame(spark, trans), 3, by_joins=by_joins)
    assert any("piece" in occ.columns for occ, _ in closed.steps[1:])
    every = brute.closed_sets(set_of(trans), 3)
    assert mined(closed) == every
    got = closed.with_row_sets().collect()
    assert {(r.bucket_id, tuple(r.cols)): (r.n_rows, r.row_min, r.row_max, r.row_xor) for r in got} == {
        k: (len(rows), min(rows), max(rows), reduce(xor, rows)) for k, rows in every.items()
    }
    some = closed.with_row_sets(closed.concepts).select(*got[0].__fields__)
    assert len(got) == len(every) and sorted(some.collect()) == sorted(got)


def test_rare_pairs_are_dropped_before_a_shuffle(spark):
    """Only records are shuffled where a node is in one piece; a node in pieces adds up."""
    rng = random.Random(5)
    rows = [(n, 10 * n + t, rng.randint(1, 3), sorted(rng.sample(range(5, 12), 4)), sorted(rng.sample(range(5), 2))) for n in range(9) for t in range(8)]
    occ = spark.createDataFrame(rows, "node bigint, tid bigint, weight bigint, cand array<int>, pre array<int>")
    expected = sorted(closure.pair_counts(occ, 6).collect())
    whole = closure.pair_counts(occ, 6, 3)
    pieces = closure.pair_counts(occ.withColumn("piece", F.when(F.col("node") < 2, 1 + F.col("tid") % 2).otherwise(0)), 6, 3)
    assert expected and sorted(whole.collect()) == sorted(pieces.collect()) == expected
    plan = closure.pair_counts(occ, 6, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_subsumption_in_incomplete_collections(spark):
    """A set goes if a larger one of the collection has its rows, also where those between are missing."""
    rng = random.Random(21)
    trans = {b: {r: {c for c in range(7) if rng.random() < 0.7} for r in range(30)} for b in range(2)}
    trans[0] |= {r: {0, 1, 2, 3, 4} for r in range(30, 60)}  # equal rows
    table = frame(spark, trans)
    having = {}
    for b, rows in trans.items():
        for size in range(1, 8):
            for cols in combinations(range(7), size):
                found = frozenset(r for r, s in rows.items() if s.issuperset(cols))
                if found and rng.random() < 0.4:
                    having[b, cols] = found
    expected = {
        (b, c) for (b, c), rows in having.items()
        if not any(x == b and set(c) < set(d) and having[x, d] == rows for x, d in having)
    }
    assert 0 < len(expected) < len(having)
    sets = spark.createDataFrame([(b, list(reversed(c))) for b, c in having] * 2 + [(0, []), (5, [1]), (0, [99])], "bucket_id int, cols array<int>")
    got = its.subsumption_filter(sets, table).collect()
    assert len(got) == len(expected) and {(r.bucket_id, tuple(r.cols)) for r in got} == expected
    assert all(r.n_rows == len(having[r.bucket_id, tuple(r.cols)]) and r.row_min == min(having[r.bucket_id, tuple(r.cols)]) for r in got)
    assert its.subsumption_filter(sets.where("false"), table).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3])
def test_common_rows_by_bitmaps(spark, size):
    """Row ids over several chunks of 32,768, negative ones and both ends of a chunk among them."""
    rng = random.Random(size)
    ids = [-40_000, -1, 0, 1, 32_767, 32_768, 32_769, 2**40] + rng.sample(range(100_000), 60)
    trans = {r: {c for c in "abcde" if rng.random() < 0.6} for r in ids}
    table = spark.createDataFrame([(3, r, sorted(s)) for r, s in trans.items()], "bucket_id int, row_id bigint, items array<string>")
    expected = {}
    for cols in combinations("abcde", size):
        n = sum(s.issuperset(cols) for s in trans.values())
        if n >= 4:
            expected[cols] = n
    assert {tuple(r["items"]): r.n_rows for r in its.common_rows(table, size, 4).collect()} == expected
    assert its.common_rows(table.where("false"), size).count() == 0


def test_row_sets_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """With hashes that say nothing, the cells of the groups decide which concepts have the same rows."""
    rng = random.Random(8)
    trans = {b: {r: {c for c in range(5) if rng.random() < 0.6} or {0} for r in range(24)} for b in range(3)}
    trans[2] = dict(trans[0])
    found = brute.closed_sets(trans, 6)

    def parts():
        zero = F.lit(0).cast("bigint")
        return [F.count("*").alias("weight"), *[F.min(zero).alias(c) for c in ("row_min", "row_max")], *[F.bit_xor(zero).alias(c) for c in ("row_xor", "row_hash1", "row_hash2")]]

    monkeypatch.setattr(its, "_row_set_parts", parts)
    numbered = con.number_row_sets(its.closed_itemsets(frame(spark, trans), 6)).collect()
    groups = {}
    for r in numbered:
        groups.setdefault((r.rows_level, r.rows_node), []).append(found[r.bucket_id, tuple(r.cols)])
    assert len(numbered) == len(found)
    assert sorted(map(len, groups.values())) == sorted(
        sum(1 for rows in found.values() if rows == one) for one in set(found.values())
    )
    assert all(len(set(g)) == 1 for g in groups.values())


@pytest.mark.parametrize("by_joins", [False, True])
def test_steps_after_the_merge_work_on_distinct_transactions(spark, by_joins):
    few = {0: {r: {1, 2, r % 3 + 3} for r in range(60)}, 1: {r: {1, r + 100} for r in range(20)}}
    closed = its.closed_itemsets(frame(spark, few), 4, by_joins=by_joins)
    assert closed.cut.count() == 3 + 20  # not 80
    assert closed.cut.agg({"weight": "sum"}).first()[0] == 80
    groups = closed.row_groups().collect()
    assert sorted((r.bucket_id, r.row_id) for r in groups) == sorted((b, r) for b, rows in few.items() for r in rows)
    tids = {(r.bucket_id, r.row_id): r.tid for r in groups}
    assert len({tids[0, r] for r in range(60)}) == 3 and len({tids[1, r] for r in range(20)}) == 1
    got = {(r.bucket_id, tuple(r.cols)): r.n_rows for r in closed.concepts.collect()}
    assert got == {k: len(rows) for k, rows in brute.closed_sets(few, 4).items()}


def test_fp_growth_takes_a_bounded_number_of_baskets_per_task(spark, monkeypatch):
    from pyspark.ml.fpm import FPGrowth

    parts = []
    fit = FPGrowth.fit
    monkeypatch.setattr(FPGrowth, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(its, "BASKETS_PER_TASK", 50)
    trans = frame(spark, {0: {r: {1, 2, r % 5 + 3} for r in range(1000)}})
    assert its.frequent_itemsets(trans, 3).where("n_rows = 1000").count() == 3
    assert parts == [20]


def shuffle_files(spark):
    folder = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    return set(glob.glob(f"{folder}/**/shuffle_*", recursive=True))


def test_stage_tables_leave_no_shuffle_files(spark, tmp_path):
    """They stayed until the driver collected garbage, so disk held those of many jobs."""
    before = shuffle_files(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("key")).agg(F.count("*").alias("n"))
    table = Stages(spark, str(tmp_path / "stages")).table(counted, "counted")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert table.agg(F.sum("n")).first()[0] == 1000


def test_row_sets_are_written_level_by_level(spark, tmp_path):
    """One job for all levels held the shuffled records of all of them on disk."""
    trans = random_transactions(3, 30, 6)
    folder = tmp_path / "stages"
    closed = its.closed_itemsets(frame(spark, trans), 3, stages=Stages(spark, str(folder)))
    found = closed.with_row_sets().collect()
    assert len(list(folder.glob("level-row-sets-*"))) == len(closed.steps) + 1 > 2
    assert {(r.level, r.node): r.n_rows for r in found} == {(r.level, r.node): r.n_rows for r in closed.concepts.collect()}
