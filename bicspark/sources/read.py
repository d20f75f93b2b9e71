"""Readers of matrix text, prepared rows and bucketed triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bicspark.plans.stages import Stages

CELL = "struct<value:double,col:int>"


def number(text: Column | str, kind: str = "double") -> Column:
    """Text as a number. Any other text fails the job, whatever the session's ANSI setting."""
    text = F.col(text) if isinstance(text, str) else text
    bad = F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(text, F.lit("(nothing)")))).cast(kind)
    return F.coalesce(text.try_cast(kind), bad)


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One matrix row per line: ``(row_id, values)``, ``row_id`` the 0-based line.

    Lines may differ in width, and empty cells at the end of a line are none. Any other
    cell that is not a number fails the job.
    """
    lines = number_lines(spark, path)
    whole = F.regexp_replace("value", f"(\\Q{sep}\\E)+$", "")
    return lines.select("row_id", F.transform(F.split(whole, f"\\Q{sep}\\E"), lambda c: number(c)).alias("values"))


def number_lines(spark: SparkSession, path: str, stages: Stages | None = None) -> DataFrame:
    """Text lines with their dense 0-based number, files in path order: ``(row_id, value)``.

    A first pass counts the lines of each file split. The second adds to each line's
    place in its split the lines before the split. What is ordered in between is one
    small record per split, less than the scan itself keeps per split on the driver. It
    is written as a stage table, so that the optimizer sees its size and broadcasts it
    only if small. A line whose split was cut differently in the first pass fails the
    job, so no line can get a wrong number.
    """
    stages = stages or Stages(spark)
    lines = spark.read.text(path).select(
        "value",
        F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().alias("at"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
    )
    splits = lines.groupBy("task", "path", "file", "start", "length").agg(
        F.min("at").alias("first"), F.count("*").alias("n")
    )
    before = F.sum("n").over(Window.orderBy("path", "start")) - F.col("n")
    offsets = (
        splits.withColumn("shift", before - F.col("first"))
        .groupBy("task")
        .agg(F.collect_list(F.struct("file", "start", "length", "first", "shift")).alias("splits"))
    )
    placed = lines.drop("path").join(stages.new_table(offsets, "splits"), "task", "left")
    own = F.filter(
        "splits",
        lambda s: (s["file"] == F.col("file"))
        & (s["start"] == F.col("start"))
        & (s["length"] == F.col("length"))
        & (s["first"] <= F.col("at")),
    )
    shift = F.coalesce(
        F.get(own, F.lit(0))["shift"],
        F.raise_error(F.lit("the input splits changed while lines were numbered")).cast("bigint"),
    )
    return placed.select((F.col("at") + shift).alias("row_id"), "value")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``row TAB value$col value$col ...`` as sorted rows ``(row_id, cells)``.

    Cells keep the order of the line. Lines of at most one character are skipped.
    """
    lines = spark.read.text(path).where(F.length("value") > 1)
    parts = F.split("value", "\t")
    cells = F.transform(
        F.split(parts[1], " "),
        lambda cell: F.struct(
            number(F.substring_index(cell, "$", 1)).alias("value"),
            number(F.substring_index(cell, "$", -1), "int").alias("col"),
        ),
    )
    return lines.select(number(parts[0], "bigint").alias("row_id"), cells.alias("cells"))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``range TAB triple;triple;...`` as ``(bucket, row_id, cols, values, variance)``.

    A triple is ``variance$col#value,col#value,col#value$row``. A range may be
    spread over many lines.
    """
    lines = spark.read.text(path)
    parts = F.split("value", "\t")
    triples = lines.select(parts[0].alias("bucket"), F.explode(F.split(parts[1], ";")).alias("triple"))
    fields = F.split("triple", "\\$")
    cells = F.split(fields[1], ",")
    return triples.select(
        "bucket",
        number(fields[2], "bigint").alias("row_id"),
        F.transform(cells, lambda c: number(F.substring_index(c, "#", 1), "int")).alias("cols"),
        F.transform(cells, lambda c: number(F.substring_index(c, "#", -1))).alias("values"),
        number(fields[0]).alias("variance"),
    )
