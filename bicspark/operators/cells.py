"""Matrix cells ``(row_id, col, value)`` and rows sorted by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_cells(
    matrix: DataFrame,
    row_id: str = "row_id",
    values: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Unpivot a matrix with one record per row into ``(row_id, col, value)``.

    The values lie either in one array column (``values``) or in several numeric
    columns (``columns``). ``col`` is the 0-based position. Null and NaN cells are
    left out.
    """
    array = F.col(values) if values else F.array(*[F.col(c).cast("double") for c in columns])
    cells = matrix.select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.posexplode(array.cast("array<double>")).alias("col", "value"),
    )
    return cells.where(F.col("value").isNotNull() & ~F.isnan("value"))


def sort_cells(cells: DataFrame) -> DataFrame:
    """Gather cells into ``(row_id, cells)``, sorted by value, ties by column.

    ``cells`` is an array of ``(value, col)``; its length is at most the number of
    matrix columns. The one shuffle is on ``row_id``, and later groupings that
    include ``row_id`` reuse it.
    """
    present = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return present.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("value", "col"))).alias("cells")
    )


def sort_row_arrays(matrix: DataFrame, row_id: str = "row_id", values: str = "values") -> DataFrame:
    """As :func:`sort_cells` for a matrix with one array per row: no shuffle."""
    paired = F.transform(
        F.col(values).cast("array<double>"),
        lambda x, i: F.struct(x.alias("value"), i.cast("int").alias("col")),
    )
    present = F.filter(paired, lambda c: c["value"].isNotNull() & ~F.isnan(c["value"]))
    return matrix.select(
        F.col(row_id).cast("bigint").alias("row_id"),
        F.sort_array(present).alias("cells"),
    )


def ranked_cells(sorted_rows: DataFrame) -> DataFrame:
    """Sorted rows back in long form ``(row_id, pos, col, value)``, ``pos`` from 0."""
    return sorted_rows.select("row_id", F.posexplode("cells").alias("pos", "cell")).select(
        "row_id", "pos", "cell.col", "cell.value"
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` records of a table."""
    return df.limit(n)


