"""Closed sets found in tasks are those found by levels, with the same rows, seeds and votes."""

import random

import pytest
from pyspark.sql import functions as F

from bicspark.operators import concepts as con
from bicspark.operators import itemsets as its
from bicspark.operators import predict as pre
from bicspark.operators import subtree
from bicspark.plans.labels import predict_labels
from tests import brute


def transactions(seed, n_rows=60, n_cols=9, n_buckets=3, density=0.6):
    rng = random.Random(seed)
    trans = {b: {r: {c for c in range(n_cols) if rng.random() < density} or {0} for r in range(n_rows)} for b in range(n_buckets)}
    trans[n_buckets] = dict(trans[0])  # a range with the rows of another
    return trans


def frame(spark, trans, kind="int"):
    rows = [(b, r, sorted(s)) for b, of in trans.items() for r, s in of.items()]
    return spark.createDataFrame(rows, f"bucket_id int, row_id bigint, items array<{kind}>")


@pytest.fixture(params=[(40, 50)])
def in_tasks(request, monkeypatch):
    """All nodes are left to tasks from the first level on, or only small ones, in small batches."""
    monkeypatch.setattr(subtree, "LEVEL_RECORDS", 0)
    monkeypatch.setattr(subtree, "NODE_RECORDS", request.param[0])
    monkeypatch.setattr(subtree, "BATCH", request.param[1])


def known(closed, concepts):
    return {(r.bucket_id, tuple(r.cols)): r for r in concepts.collect()}


def test_sets_rows_and_row_sets_by_tasks(spark, in_tasks):
    trans = transactions(1)
    every = brute.closed_sets(trans, 4)
    closed = its.closed_itemsets(frame(spark, trans), 4)
    assert closed.subtrees and closed.subtrees[0][1].count() > 0
    assert {k: r.n_rows for k, r in known(closed, closed.concepts).items()} == {k: len(rows) for k, rows in every.items()}
    rows = closed.extents().join(closed.concepts, its.NODE).groupBy("bucket_id", "cols").agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
    assert {(r.bucket_id, tuple(r.cols)): r.rows for r in rows.collect()} == {k: sorted(v) for k, v in every.items()}
    some = closed.concepts.where("n_cols = 3")
    assert closed.extents(some).join(some, its.NODE, "left_anti").count() == 0
    assert closed.extents(some).count() == sum(len(v) for k, v in every.items() if len(k[1]) == 3)
    by_levels = {(b, c): r for (b, c), r in known(closed, closed.with_row_sets(closed.concepts)).items()}
    for key, r in known(closed, closed.with_row_sets()).items():
        assert [r[c] for c in its.ROW_SET] == [by_levels[key][c] for c in its.ROW_SET]
        assert (r.row_min, r.row_max, r.n_cols) == (min(every[key]), max(every[key]), len(key[1]))


def test_ranges_of_concepts_and_predictions_by_tasks(spark, in_tasks, monkeypatch):
    trans = transactions(2)
    labels = spark.createDataFrame([(r, "ab"[r % 3 == 0]) for r in range(0, 70) if r % 11], "row_id bigint, label string")

    def results():
        closed = its.closed_itemsets(frame(spark, trans), 4, min_cols=2)
        concepts = con.distinct_concepts(con.number_row_sets(closed))
        found = {(r.row_min, r.row_xor, r.row_hash1, tuple(r.cols)): r.bucket_ids for r in concepts.collect()}
        seeds = pre.seed_rows(closed, concepts, 2).join(concepts, its.NODE).groupBy("row_hash1", "cols").agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
        seeds = {(r.row_hash1, tuple(r.cols)): r.rows for r in seeds.collect()}
        return closed, found, seeds, sorted(map(str, predict_labels(closed, concepts, labels).collect()))

    by_tasks = results()
    monkeypatch.setattr(subtree, "LEVEL_RECORDS", 10**9)
    by_levels = results()
    assert by_tasks[0].subtrees and not by_levels[0].subtrees
    assert by_tasks[1:] == by_levels[1:]
    assert any(len(b) > 1 for b in by_tasks[1].values())


def test_equal_transactions_null_rows_and_text_items(spark, in_tasks):
    rng = random.Random(5)
    rows = [(0, r if r % 9 else None, sorted({f"c{rng.randint(0, 5)}" for _ in range(4)})) for r in range(80)]
    trans = spark.createDataFrame(rows, "bucket_id int, row_id bigint, items array<string>")
    found = {}
    for by_joins in (False, True):
        closed = its.closed_itemsets(trans, 3, by_joins=by_joins)
        found[by_joins] = {tuple(r.cols): [r[c] for c in its.ROW_SET] for r in closed.with_row_sets().collect()}
        seeds = pre.seed_rows(closed, closed.concepts, 2).join(closed.concepts, its.NODE).groupBy("cols").agg(F.sort_array(F.collect_list(F.struct("row_id"))).alias("rows"))
        found[by_joins, "seeds"] = {tuple(r.cols): r.rows for r in seeds.collect()}
        assert bool(closed.subtrees) != by_joins
    assert found[False] == found[True] and found[False, "seeds"] == found[True, "seeds"]


def test_ranges_with_more_items_than_a_mask_go_by_levels(spark, monkeypatch):
    monkeypatch.setattr(subtree, "LEVEL_RECORDS", 0)
    monkeypatch.setattr(subtree, "MASK_ITEMS", 8)
    trans = transactions(3, n_rows=30, n_cols=9, n_buckets=1)
    trans[2] = {r: {c for c in s if c < 6} or {0} for r, s in trans[0].items()}
    closed = its.closed_itemsets(frame(spark, trans), 4)
    assert {r.bucket_id for r in closed.subtrees[0][1].select("bucket_id").distinct().collect()} == {2}
    assert {k: r.n_rows for k, r in known(closed, closed.concepts).items()} == {k: len(v) for k, v in brute.closed_sets(trans, 4).items()}
