"""Text forms of rows, triples and concepts, for the text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_text(cells: Column, row_id: Column) -> Column:
    """``value$col value$col ...%row`` of an array of (value, col) cells."""
    return F.concat(cells_text(cells), F.lit("%"), row_id.cast("string"))


def cells_text(cells: Column) -> Column:
    """``value$col value$col ...`` of an array of (value, col) cells."""
    return F.array_join(
        F.transform(cells, lambda c: F.concat(c["value"].cast("string"), F.lit("$"), c["col"].cast("string"))),
        " ",
    )


def triple_text(variance: Column, cols: Column, values: Column, row_id: Column) -> Column:
    """``variance$col#value,col#value,col#value$row``."""
    cells = F.array_join(F.zip_with(cols, values, item_text), ",")
    return F.concat(variance.cast("string"), F.lit("$"), cells, F.lit("$"), row_id.cast("string"))


def item_text(col: Column, value: Column) -> Column:
    """``col#value``, the item that keeps the value with the column."""
    return F.concat(col.cast("string"), F.lit("#"), value.cast("string"))


def concept_text(rows: Column, cols: Column, *counts: Column) -> Column:
    """``rows,cols % n_rows,n_cols``, and more counts, with ids joined by spaces."""
    return F.concat(
        F.array_join(rows.cast("array<string>"), " "),
        F.lit(","),
        F.array_join(cols.cast("array<string>"), " "),
        F.lit(" % "),
        F.concat_ws(",", *[n.cast("string") for n in counts]),
    )
