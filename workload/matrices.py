"""Matrices made from the driver tables, as cells ``(row_id, col, value)``.

All values are whole numbers, so that no mean or variance is a rounding tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bicspark.operators.grid import range_grid

MINSUP = 10
ORDER_GRID = range_grid(0, 200, 10, 2)
ORDER_GRID_TO_60 = range_grid(0, 60, 10, 2)
PART_GRID = range_grid(0, 400, 20, 4)
VECTOR_GRID = range_grid(-60, 60, 5, 1)
LETTER_GRID = range_grid(0, 200, 20, 2)
LETTERS = "entaosrd"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per order and line number. The key pair repeats, so it is summed."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("col"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def parts_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per part and month of shipping."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("row_id"), F.month("l_shipdate").alias("col"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def orders_by_line_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of :func:`orders_by_line` and a copy of it, ten columns on."""
    return orders_by_line(spark, sf_dir).select(
        "row_id", F.explode(F.array("col", F.col("col") + 10)).alias("col"), "value"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, values)``: embeddings in hundredths, rounded down."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("double")).alias("values"),
    )


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")


def vector_beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, values)``: the first five elements of every vector, not rounded."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("values"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")


def letter_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of documents: how many of 1,000 characters are one of :data:`LETTERS`.

    Empty and missing texts have no cells.
    """
    length = F.length("text")

    def share(letter: str) -> Column:
        return F.floor(1000 * (length - F.length(F.replace("text", F.lit(letter), F.lit("")))) / length).cast("double")

    cells = F.array(*[F.struct(F.lit(k).alias("col"), share(c).alias("value")) for k, c in enumerate(LETTERS)])
    return documents(spark, sf_dir).where(length > 0).select("row_id", F.inline(cells))
