"""Token ids of documents as binary blocks, written and read by Spark.

Documents are range-partitioned and sorted by ``doc_id``. Each task encodes its texts and
codes them in blocks that end with a document (:mod:`bicspark.llm.rangecoder`); a block
stands in one record of a Parquet file, with its place, its documents and their lengths.
Blocks are decoded independently of each other, by whichever task reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bicspark.llm import ids as token_ids
from bicspark.llm import rangecoder

#: Ids from which a block is closed; one very long document makes a longer block.
BLOCK_IDS = 1 << 19
BLOCKS = "part int, block int, doc_ids array<{kind}>, lengths array<long>, n_ids long, payload binary"


def write_blocks(docs: DataFrame, folder: str, path: str, end_id: int, vocabulary: int, spaces_kept: bool = True) -> None:
    """Encode every text, a null one as empty, and write the blocks.

    Documents go in ascending ``doc_id`` order, null first, and repeated ids by text.
    An empty table gives files without blocks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = BLOCKS.format(kind=kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, waiting, doc_ids, lengths, n = 0, [], [], [], 0
        id_type = None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(waiting)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([doc_ids], pa.list_(id_type)),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([rangecoder.encode_block(ids, vocabulary)], pa.binary()),
                ],
                names=["part", "block", "doc_ids", "lengths", "n_ids", "payload"],
            )

        for batch in token_ids.chunks(batches):
            id_type = batch.column("doc_id").type
            ids, counts = token_ids.encode(batch.column("text"), path, spaces_kept)
            ids, counts = token_ids.with_end(ids, counts, end_id)
            names, ends, done = batch.column("doc_id").to_pylist(), np.cumsum(counts), 0
            first = 0
            while first < len(counts):
                # Up to the document that fills the block, or all that are left.
                last = int(np.searchsorted(ends, done + BLOCK_IDS - n, side="left")) + 1
                last = min(last, len(counts))
                waiting.append(ids[done : ends[last - 1]])
                doc_ids += names[first:last]
                lengths += counts[first:last].tolist()
                n += int(ends[last - 1]) - done
                done, first = int(ends[last - 1]), last
                if n >= BLOCK_IDS:
                    yield flush()
                    block, waiting, doc_ids, lengths, n = block + 1, [], [], [], 0
        if n:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, schema).write.mode("error").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, from the blocks alone.

    A damaged block fails the job.
    """
    blocks = spark.read.parquet(folder)
    # One small record per task of the writer, then the blocks of each.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_part").over(above), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", "n_ids").join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("first")
    )
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = rangecoder.decode_block(row.column("payload")[0].as_py())
                counts = row.column("lengths").flatten().to_numpy()
                start = row.column("first")[0].as_py() + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids").flatten(), pa.array(start), pa.array(counts), token_ids.binary_column(ids, counts)],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = blocks.select("part", "block", "doc_ids", "lengths", "payload").join(places, ["part", "block"])
    return placed.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")
