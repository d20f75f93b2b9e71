"""Writers, and the text lines they write.

A text line that lists rows or triples is bounded: it has those of one block of row ids,
and further blocks go on further lines, so no task gathers a hot group whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bicspark.functions.text import cells_text, concept_text, triple_text
from bicspark.operators.concepts import RANKED, rank_keys
from bicspark.operators.itemsets import NODE, ClosedSets


def prepared_lines(sorted_rows: DataFrame) -> DataFrame:
    """``row TAB value$col value$col ...`` of sorted rows."""
    return sorted_rows.select(
        F.concat(F.col("row_id").cast("string"), F.lit("\t"), cells_text(F.col("cells"))).alias("value")
    )


def bucket_lines(bucketed: DataFrame, per_line: int = 10_000) -> DataFrame:
    """``range TAB triple;triple;...`` of triples with a ``bucket`` label.

    A line has the triples of rows whose ids agree in ``row_id div per_line``, whatever the
    size of the range, so lines are made in one pass and never gather a range.
    """
    triples = bucketed.select(
        "bucket",
        F.col("row_id"),
        "pos",
        triple_text(F.col("variance7"), F.col("cols"), F.col("values"), F.col("row_id")).alias("triple"),
    )
    return (
        triples.groupBy("bucket", _block(per_line).alias("line"))
        .agg(F.sort_array(F.collect_list(F.struct("row_id", "pos", "triple"))).alias("triples"))
        .select(F.concat("bucket", F.lit("\t"), F.array_join(F.col("triples.triple"), ";")).alias("value"))
    )


def concept_lines(closed: ClosedSets, concepts: DataFrame, per_line: int = 100_000, item_order: str = "value") -> DataFrame:
    """``rows,cols % n_rows,n_cols`` of concepts: ``(level, node, line, n_rows, n_cols, value)``.

    A line has the rows that agree in ``row_id div per_line``, and ``line`` is that number;
    a concept with rows in several blocks has several lines, each with the columns and
    counts of the whole. If the concepts have ``n_dup``, it follows as a third count.
    Ranked concepts keep the columns that they are ranked by. ``item_order='text'``
    writes the columns in the order of their text.
    """
    if item_order not in ("value", "text"):
        raise ValueError("item_order is 'value' or 'text'")
    ranked = [c for c in RANKED if c not in ("n_rows", "cols")] if set(RANKED) <= set(concepts.columns) else []
    counts = ["n_rows", "n_cols", *(["n_dup"] if "n_dup" in concepts.columns else [])]
    shape = concepts.select(*NODE, "cols", *counts, *ranked)
    rows = (
        closed.extents(concepts)
        .groupBy(*NODE, _block(per_line).alias("line"))
        .agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
    )
    cols = F.col("cols") if item_order == "value" else F.sort_array(F.col("cols").cast("array<string>"))
    text = concept_text(F.col("rows"), cols, *[F.col(c) for c in counts])
    return rows.join(shape, NODE).select(
        *NODE, "line", "n_rows", "n_cols", text.alias("value"), *ranked, *(["cols"] if ranked else [])
    )


def _block(per_line: int) -> Column:
    if per_line < 1:
        raise ValueError("per_line must be at least 1")
    return F.expr(f"row_id div {per_line}L")


def write_concepts(concepts: DataFrame, path: str, format: str = "parquet", files: int | None = None) -> None:
    """Write a concept table, or with ``format='text'`` its ``value`` lines.

    Lines of ranked concepts are sorted by rank as the last step, over the files in
    turn. ``files`` sets their number by a shuffle, so that only the write is narrow.
    """
    lines = format == "text"
    if lines and {*RANKED, "line"} <= set(concepts.columns):
        keys = [*rank_keys(), F.asc("line")]
        out = (
            concepts.orderBy(*keys)
            if files is None
            else concepts.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
        )
    else:
        out = concepts if files is None else concepts.repartition(files)
    (out.select("value") if lines else out).write.mode("error").format(format).save(path)


def write_stage(df: DataFrame, folder: str, stage: str, format: str = "parquet", files: int | None = None) -> DataFrame:
    """Write one step of a run under ``folder`` and return the written table.

    Text takes one string column. ``files`` sets the number of files by a shuffle.
    """
    out = df if files is None else df.repartition(files)
    path = f"{folder.rstrip('/')}/{stage}"
    out.write.mode("error").format(format).save(path)
    reader = df.sparkSession.read
    return reader.text(path) if format == "text" else reader.schema(df.schema).format(format).load(path)
