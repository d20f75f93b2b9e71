"""Sliding groups of consecutive cells of a sorted row, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bicspark.functions.numeric import (
    population_variance,
    round_half_up,
    running_mean,
    sum_mean,
)


def triples(sorted_rows: DataFrame, width: int = 3) -> DataFrame:
    """All runs of ``width`` consecutive cells: ``(row_id, pos, cols, values)``.

    A row of n cells gives n - width + 1 runs, none if it is shorter. Shifted
    slices of the sorted row are zipped and exploded, so there is no shuffle and
    a record carries just its own cells.
    """
    long_enough = sorted_rows.where(F.size("cells") >= width)
    n_runs = F.size("cells") - (width - 1)
    shifted = [F.slice("cells", F.lit(i + 1), n_runs).alias(f"c{i}") for i in range(width)]
    runs = long_enough.select("row_id", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "run"))
    return runs.select(
        "row_id",
        "pos",
        F.array(*[F.col(f"run.c{i}.col") for i in range(width)]).alias("cols"),
        F.array(*[F.col(f"run.c{i}.value") for i in range(width)]).alias("values"),
    )


def cell_triples(cells: DataFrame, width: int = 3) -> DataFrame:
    """As :func:`triples`, straight from cells ``(row_id, col, value)``.

    One shuffle on ``row_id``, then each cell looks ahead in its sorted row. Rows are
    streamed, not gathered, and later groupings that include ``row_id`` reuse the
    partitioning.
    """
    row = Window.partitionBy("row_id").orderBy("value", "col")
    ahead = [F.lead(c, i).over(row).alias(f"{c}{i}") for i in range(1, width) for c in ("col", "value")]
    runs = (
        cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .select(
            "row_id",
            (F.row_number().over(row) - 1).alias("pos"),
            F.col("col").alias("col0"),
            F.col("value").alias("value0"),
            *ahead,
        )
        .where(F.col(f"col{width - 1}").isNotNull())
    )
    return runs.select(
        "row_id",
        "pos",
        F.array(*[F.col(f"col{i}") for i in range(width)]).alias("cols"),
        F.array(*[F.col(f"value{i}") for i in range(width)]).alias("values"),
    )


def triple_stats(
    runs: DataFrame,
    width: int = 3,
    mean_method: str = "running",
    cv_of: str = "variance",
    exact_rounding: bool = False,
) -> DataFrame:
    """Add ``mean``, ``variance`` (population), ``cv``, and rounded forms.

    ``mean2`` is the mean to 2 decimals, by which the range is chosen, and
    ``variance7`` the variance to 7. ``cv`` is ``sqrt(variance) / mean``, taken
    from the rounded variance with ``cv_of='variance7'``; it is null for mean 0.
    """
    if mean_method not in ("running", "sum") or cv_of not in ("variance", "variance7"):
        raise ValueError("mean_method is 'running' or 'sum', cv_of 'variance' or 'variance7'")
    values = [F.col("values")[i] for i in range(width)]
    mean = running_mean(values) if mean_method == "running" else sum_mean(values)
    return (
        runs.withColumn("mean", mean)
        .withColumn("variance", population_variance(values, F.col("mean"), mean_method))
        .withColumn("mean2", round_half_up(F.col("mean"), 2, exact_rounding))
        .withColumn("variance7", round_half_up(F.col("variance"), 7, exact_rounding))
        .withColumn("cv", F.try_divide(F.sqrt(cv_of), F.col("mean")))
    )
