import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from bicspark.functions.numeric import round_half_up
from bicspark.operators import cells as cel
from bicspark.operators import grid as gr
from bicspark.operators import triples as tri


def test_cells_sorted_by_value_then_column(spark):
    matrix = spark.createDataFrame(
        [(0, [3.0, 1.0, 3.0, None, float("nan"), 2.0]), (1, [5.0])], "row_id bigint, values array<double>"
    )
    expected = {0: [(1.0, 1), (2.0, 5), (3.0, 0), (3.0, 2)], 1: [(5.0, 0)]}
    by_array = cel.sort_row_arrays(matrix)
    by_cells = cel.sort_cells(cel.to_cells(matrix, values="values"))
    for rows in (by_array, by_cells):
        assert {r.row_id: [tuple(c) for c in r.cells] for r in rows.collect()} == expected


def test_wide_table_unpivots_by_position(spark):
    table = spark.createDataFrame([(7, 1, 2.5), (8, None, 4.0)], "k int, a int, b double")
    cells = cel.to_cells(table, "k", columns=["a", "b"])
    assert sorted(map(tuple, cells.collect())) == [(7, 0, 1.0), (7, 1, 2.5), (8, 1, 4.0)]


def test_both_triple_forms_agree(spark):
    rng = random.Random(1)
    data = [(r, c, float(rng.randint(0, 9))) for r in range(60) for c in range(rng.randint(1, 8))]
    cells = spark.createDataFrame(data, "row_id bigint, col int, value double")
    stream = sorted(map(str, tri.cell_triples(cells).collect()))
    array = sorted(map(str, tri.triples(cel.sort_cells(cells)).collect()))
    assert stream == array
    widths = {r: sum(1 for d in data if d[0] == r) for r in range(60)}
    assert len(stream) == sum(max(n - 2, 0) for n in widths.values())


def test_stats_follow_the_running_mean(spark):
    values = [0.23, 0.241, 0.25]
    runs = spark.createDataFrame([(0, 0, [1, 2, 3], values)], "row_id bigint, pos int, cols array<int>, values array<double>")
    row = tri.triple_stats(runs).first()

    def running(xs):
        mean = 0.0
        for i, x in enumerate(xs, 1):
            mean += (x - mean) / i
        return mean

    mean = running(values)
    variance = running([(x - mean) ** 2 for x in values])
    assert (row.mean, row.variance, row.cv) == (mean, variance, math.sqrt(variance) / mean)
    assert (row.mean2, row.variance7) == (0.24, round(variance, 7))


def test_cv_of_zero_mean_is_null_and_fails_the_filter(spark):
    runs = spark.createDataFrame(
        [(0, 0, [1, 2, 3], [-1.0, 0.0, 1.0]), (1, 0, [1, 2, 3], [-2.0, -1.0, -1.0]), (2, 0, [1, 2, 3], [1.0, 1.0, 1.0])],
        "row_id bigint, pos int, cols array<int>, values array<double>",
    )
    stats = tri.triple_stats(runs)
    assert [r.row_id for r in gr.max_cv(stats, 0.1).orderBy("row_id").collect()] == [1, 2]
    assert [r.row_id for r in gr.max_cv(stats, 0.1, abs_mean=True).collect()] == [2]
    assert gr.max_cv(stats, None).count() == 3


@pytest.mark.parametrize("exact", [False, True])
def test_rounding_half_up(spark, exact):
    rng = random.Random(2)
    xs = [0.125, 2.675, 1.005, -0.025, -1.005, 0.285, 1.115, 8.5e10 + 0.005, 0.0, 1e-9]
    xs += [rng.randint(-10**6, 10**6) / 1000 for _ in range(3000)]
    xs += [rng.uniform(-100, 100) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", round_half_up(F.col("x"), 2, exact).alias("r")
    )
    for x, r in got.collect():
        decimal = Decimal(x) if exact else Decimal(repr(x))
        assert r == float(decimal.quantize(Decimal("0.01"), ROUND_HALF_UP)), x


def test_default_grid_and_literal():
    grid = gr.default_grid()
    assert len(grid) == 54
    assert grid[0] == (-0.03, 0.13) and grid[10] == (0.97, 1.12) and grid[-1] == (670.0, 705.0)
    assert gr.parse_grid("0.00:0.33, 1.33:0.66") == [(0.0, 0.33), (1.33, 0.66)]


def test_buckets_against_a_plain_scan(spark):
    rng = random.Random(3)
    grid = [gr.Range(float(lo), float(lo + rng.randint(-2, 6))) for lo in [rng.randint(0, 30) for _ in range(25)]]
    grid.append(grid[3])
    points = sorted({float(p) / 2 for p in range(-4, 90)})
    df = spark.createDataFrame([(p,) for p in points], "mean2 double")
    first = {}
    for i, r in enumerate(grid):
        first.setdefault(r, i)
    hits = {p: [first[r] for r in grid if r.lo <= p <= r.hi] for p in points}
    last = {r.mean2: r.bucket_id for r in gr.assign_bucket(df, grid).collect()}
    assert last == {p: h[-1] if h else gr.UNMATCHED for p, h in hits.items()}
    kept = gr.assign_bucket(df, grid, drop_unmatched=True).count()
    assert kept == sum(1 for h in hits.values() if h)
    every = sorted(tuple(r) for r in gr.assign_bucket(df, grid, mode="all").collect())
    assert every == sorted((p, i) for p, h in hits.items() for i in set(h))


def test_bucket_label_and_summary(spark):
    grid = gr.parse_grid("0:1.5,1:2")
    df = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.7), (1, 1, None), (0, -1, 1.0)], "row_id bigint, bucket_id int, cv double")
    labels = {r.bucket_id: r.b for r in df.select("bucket_id", gr.bucket_label("bucket_id", grid).alias("b")).collect()}
    assert labels == {1: "1.0:2.0", -1: ""}
    summary = {r.bucket_id: (r.n_triples, r.n_rows, r.mean_cv) for r in gr.bucket_summary(df).collect()}
    assert summary == {1: (3, 2, 0.6), -1: (1, 1, 1.0)}


@pytest.mark.parametrize("mode", ["all", "last"])
def test_a_table_of_ranges_of_all_widths(spark, mode):
    """Nested, equal, empty, reversed and single-point ranges from 1e-9 to 1e9 wide; values at their ends."""
    rng = random.Random(5)
    ranges = []
    for k in range(300):
        lo = rng.choice([rng.uniform(-100, 100), float(rng.randint(-5, 5)), rng.uniform(-1e9, 1e9)])
        ranges.append((k, lo, lo + rng.choice([0.0, 1e-9, 0.5, 3.0, 250.0, 1e9, -1.0])))
    ranges += [(300, float("nan"), 1.0), (301, None, 1.0), (302, 0.0, float("inf")), (303, 1.0, 1.0), (304, 0.0, -0.0)]
    values = [e for _, lo, hi in ranges for e in (lo, hi)] + [rng.uniform(-120, 120) for _ in range(200)] + [1.0] * 30
    stats = spark.createDataFrame(list(enumerate(values)), "row_id bigint, mean2 double").withColumn("value_", F.lit("x"))
    table = spark.createDataFrame(ranges, "bucket_id bigint, lo double, hi double")
    live = [(b, lo, hi) for b, lo, hi in ranges if lo is not None and -1e300 < lo <= hi < 1e300]
    expected = set()
    for row, v in enumerate(values):
        found = [] if v is None else [b for b, lo, hi in live if lo <= v <= hi]
        expected |= {(row, b) for b in found} if mode == "all" else {(row, max(found, default=-1))}
    got = gr.assign_ranges(stats, table, mode)
    assert got.columns == ["row_id", "mean2", "value_", "bucket_id"]
    rows = [(r.row_id, r.bucket_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    if mode == "last":
        matched = gr.assign_ranges(stats, table, mode, drop_unmatched=True).collect()
        assert {(r.row_id, r.bucket_id) for r in matched} == {x for x in expected if x[1] != -1}
    assert gr.assign_ranges(stats, table.where("false"), mode).where("bucket_id <> -1").count() == 0


def test_ranges_as_a_table_equal_the_literal_grid(spark):
    grid = gr.range_grid(0, 20, 3, 1)
    stats = spark.createDataFrame([(k, k / 7) for k in range(200)], "row_id bigint, mean2 double")
    for mode in ("all", "last"):
        one = gr.assign_bucket(stats, grid, mode).collect()
        two = gr.assign_ranges(stats, gr.grid_table(spark, grid).drop("bucket"), mode).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_totals_per_range_without_a_record_per_match(spark):
    """As counted over all matches: equal, repeated and empty ranges, nulls, and few records for many matches."""
    rng = random.Random(6)
    values = [(rng.choice([None, r]), rng.choice([-0.0, 1.0, None, float("nan"), float("inf"), rng.uniform(-9, 9)])) for r in range(300)]
    ranges = [(rng.choice([None, k // 2]), lo := float(rng.randint(-9, 9)), lo + rng.choice([0.0, 0.5, 7.0, -1.0])) for k in range(200)]
    ranges += [(500, 0.0, -0.0), (501, float("nan"), 1.0), (502, None, 1.0), (503, 8.999, 8.9991)]
    stats = spark.createDataFrame(values, "row_id bigint, mean2 double")
    table = spark.createDataFrame(ranges, "bucket_id bigint, lo double, hi double")
    totals = {"n": ("sum", F.lit(1)), "x": ("xor", F.col("row_id")), "s": ("sum", F.col("row_id"))}
    got = gr.assign_ranges(stats, table, totals=totals)
    listed = gr.assign_ranges(stats, table).groupBy("bucket_id").agg(F.count("*"), F.bit_xor("row_id"), F.sum("row_id"))
    rows = {tuple(r) for r in got.collect()}
    expected = {tuple(r) for r in listed.collect()}
    assert len(rows) > 30 and rows == expected
    many = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") / 3000).alias("mean2"))
    wide = spark.range(3000).select(F.col("id").alias("bucket_id"), (-F.col("id") / 3000).alias("lo"), F.lit(1.0).alias("hi"))
    found = gr.assign_ranges(many, wide, totals=totals).cache()
    assert found.agg(F.sum("n")).first()[0] == 9_000_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "width" not in plan  # no join of values with cells of ranges
    with pytest.raises(ValueError):
        gr.assign_ranges(many, wide, "last", totals=totals)
