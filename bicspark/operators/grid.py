"""Range grids over the mean, and the assignment of triples to ranges."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bicspark.operators.ordered import before
from bicspark.plans.stages import Stages

UNMATCHED = -1


class Range(NamedTuple):
    """One range, both ends inclusive. It is empty if lo > hi."""

    lo: float
    hi: float


Grid = Sequence[Range]

# The default ranges, as (start, end, step, overlap).
DEFAULT_GRID_PARTS = [
    (0.0, 1.0, 0.1, 0.025),
    (1.0, 10.0, 1.0, 0.25),
    (10.0, 50.0, 5.0, 1.0),
    (50.0, 700.0, 25.0, 5.0),
]


def _to_cents(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def range_grid(start: float, end: float, step: float, overlap: float = 0.0) -> list[Range]:
    """Ranges of width ``step`` from ``start`` while below ``end``, widened by ``overlap``.

    The position is summed up in doubles, so rounding may add a last range (0 to 1
    by 0.1 has 11). Both ends are rounded half up to 2 decimals.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    ranges = []
    at = float(start)
    while at < end:
        ranges.append(Range(_to_cents(at - overlap), _to_cents(at + step + overlap)))
        at += step
    return ranges


def default_grid() -> list[Range]:
    return [r for part in DEFAULT_GRID_PARTS for r in range_grid(*part)]


def parse_grid(text: str) -> list[Range]:
    """A literal list ``lo:hi,lo:hi,...``."""
    pairs = [part.split(":") for part in text.split(",") if part.strip()]
    return [Range(float(lo), float(hi)) for lo, hi in pairs]


def grid_table(spark: SparkSession, grid: Grid) -> DataFrame:
    """The grid as a table ``(bucket_id, lo, hi, bucket)``."""
    rows = [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(grid)]
    table = spark.createDataFrame(rows, "bucket_id int, lo double, hi double")
    return table.withColumn("bucket", F.concat_ws(":", F.col("lo").cast("string"), F.col("hi").cast("string")))


def bucket_label(bucket_id: Column | str, grid: Grid) -> Column:
    """Text ``lo:hi`` of a range, empty where no range matched."""
    bucket_id = F.col(bucket_id) if isinstance(bucket_id, str) else bucket_id
    labels = F.array(
        *[F.concat_ws(":", F.lit(float(lo)).cast("string"), F.lit(float(hi)).cast("string")) for lo, hi in grid]
    )
    return F.when(bucket_id == UNMATCHED, F.lit("")).otherwise(F.get(labels, bucket_id))


def assign_bucket(
    stats: DataFrame,
    grid: Grid,
    mode: str = "last",
    drop_unmatched: bool = False,
    on: str = "mean2",
) -> DataFrame:
    """Add ``bucket_id``, the range with ``lo <= mean2 <= hi``.

    ``mode='last'`` takes the last matching range and marks none by ``UNMATCHED``
    (dropped with ``drop_unmatched``). ``mode='all'`` gives one record per matching
    range and none where nothing matches. Equal ranges share the first one's id.

    A closed range [lo, hi] of doubles is the half-open [lo, next double after hi),
    so the ends cut the line into segments with one answer each. The segment is
    found by a binary search spelled as nested conditions: a few comparisons per
    record, inside codegen, with neither a join nor a loop over the ranges.
    """
    if mode not in ("last", "all"):
        raise ValueError("mode is 'last' or 'all'")
    first_id: dict[Range, int] = {}
    for i, r in enumerate(grid):
        first_id.setdefault(Range(*r), i)
    live = [r for r in grid if r[0] <= r[1]]
    cuts = sorted({float(r[0]) for r in live} | {math.nextafter(r[1], math.inf) for r in live})
    matches: list[list[int]] = [[] for _ in range(len(cuts) + 1)]
    for r in live:
        below = bisect_right(cuts, math.nextafter(r[1], math.inf))
        for segment in range(bisect_right(cuts, float(r[0])), below):
            matches[segment].append(first_id[Range(*r)])

    if mode == "last":
        leaves = [found[-1] if found else UNMATCHED for found in matches]
        out = stats.withColumn("bucket_id", _search(F.col(on), cuts, leaves, F.lit))
        return out.where(F.col("bucket_id") != UNMATCHED) if drop_unmatched else out
    sets = [tuple(sorted(set(found))) for found in matches]
    found = _search(F.col(on), cuts, sets, lambda ids: F.array(*[F.lit(i) for i in ids]).cast("array<int>"))
    return stats.withColumn("bucket_id", F.explode(found))


def _search(x: Column, cuts: list[float], leaves: list, leaf: Callable[..., Column]) -> Column:
    """The leaf of the segment that holds ``x``, by halving the sorted cuts."""
    if not cuts or all(v == leaves[0] for v in leaves):
        return leaf(leaves[0])
    mid = len(cuts) // 2
    return F.when(x < cuts[mid], _search(x, cuts[:mid], leaves[: mid + 1], leaf)).otherwise(
        _search(x, cuts[mid + 1 :], leaves[mid + 1 :], leaf)
    )


def assign_ranges(
    stats: DataFrame,
    ranges: DataFrame,
    mode: str = "all",
    drop_unmatched: bool = False,
    on: str = "mean2",
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """As :func:`assign_bucket`, with a table ``(bucket_id, lo, hi)`` of any number of ranges.

    A range is known in the grid of cells whose width is the power of two next above its
    own, of which it touches at most two. A value is looked up once for each width that
    occurs, so ranges of all sizes, nested or overlapping, meet their values in an
    equi-join. ``mode='last'`` takes the matching range of the largest ``bucket_id``, and
    looks up each distinct value once. Ranges with a null, NaN or infinite end or
    ``lo > hi`` hold nothing; values that are null or NaN match nothing.

    With ``totals`` the matches of ``mode='all'`` are not listed but added up per
    ``bucket_id``. It maps a name to ("sum" or "xor", column of whole numbers). The cost
    is then that of sorting values and ranges, however many values each range holds.
    """
    if mode not in ("last", "all"):
        raise ValueError("mode is 'last' or 'all'")
    if totals is not None and mode != "all":
        raise ValueError("totals are of mode 'all'")
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    finite = (F.abs(lo) < F.lit(math.inf)) & (F.abs(hi) < F.lit(math.inf)) & (lo <= hi)
    # The width is at least 2**-40 of the ends, so that cells can be told apart.
    wide = F.greatest(hi - lo, F.abs(lo) * F.lit(2.0**-40), F.abs(hi) * F.lit(2.0**-40), F.lit(2.0**-1000))
    live = ranges.where(finite).select("bucket_id", lo.alias("lo"), hi.alias("hi"), (F.floor(F.log2(wide)) + 1).alias("width"))
    if totals is not None:
        return _range_totals(stats, live, on, totals)
    widths = [r["width"] for r in live.select("width").distinct().collect()]  # one per power of two

    def cell(x: Column, width: Column) -> Column:
        return F.floor(x / F.pow(F.lit(2.0), width))

    cells = live.select("*", F.explode(F.sequence(cell(F.col("lo"), F.col("width")), cell(F.col("hi"), F.col("width")))).alias("cell"))
    own = "value_"
    while own in stats.columns:
        own += "_"
    values = stats.select(F.col(on).cast("double").alias(own)).where(~F.isnan(own)) if mode == "last" else stats.where(
        ~F.isnan(on)
    ).withColumn(own, F.col(on).cast("double"))
    if mode == "last":
        values = values.distinct()
    asked = values.select("*", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<bigint>")).alias("width"))
    asked = asked.withColumn("cell", cell(F.col(own), F.col("width")))
    matched = asked.join(cells, ["width", "cell"]).where((F.col("lo") <= F.col(own)) & (F.col(own) <= F.col("hi")))
    if mode == "all":
        return matched.select(*stats.columns, "bucket_id")
    last = matched.groupBy(own).agg(F.max("bucket_id").alias("bucket_id"))
    found = stats.withColumn(own, F.col(on).cast("double")).join(last, own, "inner" if drop_unmatched else "left")
    return found.select(*stats.columns, F.coalesce("bucket_id", F.lit(UNMATCHED)).alias("bucket_id"))


def _range_totals(stats: DataFrame, live: DataFrame, on: str, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``(bucket_id, ...)``: totals over the values within each range, of the ranges that hold any.

    Sums and exclusive-ors can be taken back: a range's total is that of the values up to
    its end less that of the values before its start. Both come from running totals over
    the sorted values and ends of ranges.
    """
    stages = Stages(stats.sparkSession)
    zero = F.lit(0).cast("bigint")
    empty = F.lit(None).cast("double")
    # Null stays null if no value of a range has one, so those that have are counted too.
    parts = {"all_": ("sum", F.lit(1))}
    for i, (how, value) in enumerate(totals.values()):
        if how not in ("sum", "xor"):
            raise ValueError("totals are 'sum' or 'xor'")
        parts[f"total{i}_"] = (how, value)
        parts[f"known{i}_"] = ("sum", F.when(value.isNotNull(), F.lit(1)))
    added = {"sum": F.sum, "xor": F.bit_xor}
    at = (F.col(on).cast("double") + F.lit(0.0)).alias("at")
    values = stats.where(F.col(on).isNotNull() & ~F.isnan(on)).groupBy(at).agg(
        *[F.coalesce(added[how](value), zero).alias(c) for c, (how, value) in parts.items()]
    )
    ranges = live.select("bucket_id", (F.col("lo") + F.lit(0.0)).alias("lo"), (F.col("hi") + F.lit(0.0)).alias("hi"))
    spans = ranges.select("lo", "hi").distinct()
    # At one place the starts come first, then the values, then the ends.
    starts, ends = [
        spans.select(F.col(c).alias("at"), F.lit(kind).alias("kind"), "lo", "hi", *[zero.alias(x) for x in parts])
        for c, kind in (("lo", 0), ("hi", 2))
    ]
    valued = values.select("at", F.lit(1).alias("kind"), empty.alias("lo"), empty.alias("hi"), *parts)
    events = stages.table(starts.unionByName(valued).unionByName(ends), "events")
    running = {f"run_{c}": (how, F.col(c)) for c, (how, _) in parts.items()}
    swept = before(events, [], ["at", "kind", "lo", "hi"], running, stages).where(F.col("kind") != 1)
    less = F.when(F.col("kind") == 0, F.lit(-1)).otherwise(F.lit(1))
    per_span = swept.groupBy("lo", "hi").agg(
        *[(F.sum(less * F.col(f"run_{c}")) if how == "sum" else F.bit_xor(f"run_{c}")).alias(c) for c, (how, _) in parts.items()]
    )
    found = ranges.join(per_span.where(F.col("all_") > 0), ["lo", "hi"])
    return found.groupBy("bucket_id").agg(
        *[added[how](F.when(F.col(f"known{i}_") > 0, F.col(f"total{i}_"))).alias(name) for i, (name, (how, _)) in enumerate(totals.items())]
    )


def max_cv(stats: DataFrame, limit: float | None, abs_mean: bool = False) -> DataFrame:
    """Keep triples with ``cv <= limit``; ``None`` keeps all.

    A negative mean gives a negative cv, which passes unless ``abs_mean`` is set.
    A missing cv (mean 0) or NaN does not pass.
    """
    if limit is None:
        return stats
    cv = F.abs("cv") if abs_mean else F.col("cv")
    return stats.where(cv.isNotNull() & ~F.isnan(cv) & (cv <= limit))


def bucket_summary(bucketed: DataFrame) -> DataFrame:
    """Per range: triples, distinct rows, and mean cv of the triples that have one."""
    per_row = bucketed.groupBy("bucket_id", "row_id").agg(
        F.count("*").alias("n"), F.sum("cv").alias("cv"), F.count("cv").alias("n_cv")
    )
    return per_row.groupBy("bucket_id").agg(
        F.sum("n").alias("n_triples"),
        F.count("*").alias("n_rows"),
        F.try_divide(F.sum("cv"), F.sum("n_cv")).alias("mean_cv"),
    )
