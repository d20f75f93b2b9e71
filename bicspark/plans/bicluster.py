"""From matrix cells to ranked biclusters in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bicspark.operators import concepts as con
from bicspark.operators.grid import Grid, assign_bucket, default_grid, max_cv
from bicspark.operators.itemsets import ClosedSets, closed_itemsets, transactions
from bicspark.operators.triples import cell_triples, triple_stats, triples
from bicspark.plans.stages import Stages


def bucketed_triples(
    matrix: DataFrame,
    grid: Grid | None = None,
    mode: str = "last",
    cv_limit: float | None = None,
    drop_unmatched: bool = False,
    mean_method: str = "running",
    cv_of: str = "variance",
    exact_rounding: bool = False,
) -> DataFrame:
    """Triples with their statistics and ``bucket_id``.

    ``matrix`` has cells ``(row_id, col, value)`` or sorted rows ``(row_id, cells)``.
    """
    runs = triples(matrix) if "cells" in matrix.columns else cell_triples(matrix)
    stats = triple_stats(
        runs, mean_method=mean_method, cv_of=cv_of, exact_rounding=exact_rounding
    )
    return assign_bucket(max_cv(stats, cv_limit), grid or default_grid(), mode, drop_unmatched)


def mine(
    matrix: DataFrame,
    grid: Grid | None = None,
    minsup: int = 3,
    item: str = "col",
    mining_min_cols: int = 1,
    max_level: int | None = None,
    by_joins: bool | None = None,
    stages: Stages | None = None,
    rows: DataFrame | None = None,
    **bucket_options,
) -> ClosedSets:
    """Closed itemsets of the ranges of a matrix, given as cells or sorted rows.

    ``rows`` names the rows of the whole matrix, if it has some without cells; otherwise
    they are the ``row_id`` of ``matrix``.

    ``mining_min_cols`` prunes rows before the search. It leaves the sets of at
    least that many columns as they are, but smaller ones are no longer counted
    in ``n_sets`` and ``n_dup``.
    """
    trans = transactions(bucketed_triples(matrix, grid, **bucket_options), item)
    rows = (matrix if rows is None else rows).select("row_id").distinct()
    return closed_itemsets(trans, minsup, mining_min_cols, max_level, stages, by_joins, rows)


def biclusters(
    matrix: DataFrame,
    grid: Grid | None = None,
    minsup: int = 3,
    least_cols: int = 4,
    item: str = "col",
    limit: int | None = None,
    include_subsupport: bool = False,
    stages: Stages | None = None,
    **options,
) -> tuple[ClosedSets, DataFrame]:
    """Mine a matrix and rank its concepts over all ranges.

    Returns the closed sets, which lead to the rows, and the ranked concepts.
    ``include_subsupport`` adds single items with fewer than ``minsup`` rows, listed in ``rows``. The
    other options are those of :func:`mine` and :func:`bucketed_triples`.
    """
    stages = stages or Stages(matrix.sparkSession)
    closed = mine(matrix, grid, minsup, item, stages=stages, **options)
    found = con.distinct_concepts(con.number_row_sets(closed, stages=stages))
    if include_subsupport:
        rare = con.subsupport_concepts(closed.transactions, minsup, stages)
        found = found.unionByName(rare, allowMissingColumns=True)
    return closed, con.rank_concepts(found, least_cols, limit)
