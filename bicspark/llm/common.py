"""What several operators share: columns, stage tables and the code path of the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bicspark.plans.stages import Stages, ship_code  # noqa: F401

#: Words of a text: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def source_key(source: str = "source") -> Column:
    """A source as a string that is never null; sources keep their order, null is last."""
    return F.coalesce(F.concat(F.lit("+"), F.col(source)), F.lit("~"))


def seeded(seed: str, *columns: Column) -> Column:
    """32 uniform bits as a long, from a seed and the text of the columns."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def in_share(column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the column as text leaves the remainder; false for null."""
    return F.coalesce(F.crc32(column.cast("string")) % modulus == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """``(text, label)`` of at most ``limit`` labelled documents outside the held-out share.

    The documented bound of a training set. Which rows are taken depends on a hash of
    ``doc_id`` only; the labels taken are at most ``limit`` small records, so that join
    may broadcast them. Labels other than 0 and 1 are not used.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~in_share(F.col("doc_id"), modulus, held_out)
    )
    taken = (
        known.groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "label")


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, whose Python objects take little memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: From a batch's texts to its new columns, by name.
FromTexts = Callable[[list[str | None]], dict[str, list]]


def from_texts(rows: DataFrame, keep: list[str], added: dict[str, T.DataType], start: Callable[[], FromTexts]) -> DataFrame:
    """The kept columns as they are, and new ones made from ``text``.

    Kept columns never leave their Arrow form, so a long next to a null stays the same
    long. A new column of a kept one's name takes its place. ``start`` is called once per
    task.
    """
    order = [*keep, *[c for c in added if c not in keep]]
    schema = T.StructType([T.StructField(c, added[c] if c in added else rows.schema[c].dataType) for c in order])
    kinds = {c: to_arrow_type(t) for c, t in added.items()}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        for batch in slices(batches):
            new = made(batch.column("text").to_pylist())
            columns = [pa.array(new[c], kinds[c]) if c in added else batch.column(c) for c in order]
            yield pa.RecordBatch.from_arrays(columns, names=order)

    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(compute, schema)


def with_row_key(rows: DataFrame, key: str, stages: Stages) -> DataFrame:
    """The rows with a long of their own, the same whenever they are read.

    Rows that are read straight from Parquet files are known by their file and their place
    in it, so only a small table of the files is written. Others are written with a number.
    A file holds less than 2**40 rows.
    """
    if rows._jdf.queryExecution().analyzed().nodeName() not in ("LogicalRelation", "Relation parquet"):
        return stages.new_table(rows.withColumn(key, F.monotonically_increasing_id()), "keyed")
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    at, number = free_name("path", rows.columns), free_name("number", rows.columns)
    paths = rows.select(path.alias(at)).distinct()
    # One small record per file goes through this window.
    files = stages.new_table(paths.select(at, (F.row_number().over(Window.orderBy(at)) - 1).cast("bigint").alias(number)), "files")
    found = rows.select("*", path.alias(at), place.alias(key)).join(files, at)
    return found.withColumn(key, F.shiftleft(number, 40).bitwiseOR(F.col(key))).select(*rows.columns, key)
