"""Mixture-controlled packing by deficit round-robin over source queues.

Documents wait in one queue per source, in a seeded order, and are served in packets of
at most ``PACKET`` tokens. In every round each queue's credit grows by its share of a
window, and it sends packets while the credit lasts; what is left, its deficit, goes on
to the next round. So a packet that ends at token ``e`` of its queue is sent in round
``ceil(e / quantum)``: the state of every queue at any round is known without running
the rounds before it, and windows of all partitions are filled at the same time. The
packets, in the order of rounds, are cut into windows; those of one document that meet
in a round are one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bicspark.llm import ids as token_ids
from bicspark.llm.common import seeded, slices, source_key
from bicspark.llm.prefix import SPAN, running
from bicspark.plans.stages import Stages

#: Tokens of a packet, by which a window may be off a source's share.
PACKET = 256


def tokenise(docs: DataFrame, path: str, end_id: int, spaces_kept: bool, zipped: bool = False) -> DataFrame:
    """``(doc_id, stratum, n_tokens, ids)``; ids are 32-bit little-endian, with the end id.

    With ``zipped`` they are in a column of that name instead, each document's compressed
    (zstd), as :func:`pack` writes and shuffles them; as 16-bit integers if a document's ids
    are all that small.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    name = "zipped" if zipped else "ids"

    def encode(batches):
        zip_ = zstandard.ZstdCompressor(level=2).compress
        for batch in token_ids.chunks(batches):
            ids, counts = token_ids.encode(batch.column("text"), path, spaces_kept)
            ids, counts = token_ids.with_end(ids, counts, end_id)
            if zipped:
                parts = np.split(ids, np.cumsum(counts)[:-1])
                column = pa.array([zip_(_narrow(part).tobytes()) for part in parts], pa.binary())
            else:
                column = token_ids.binary_column(ids, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("stratum"), pa.array(counts), column],
                names=["doc_id", "stratum", "n_tokens", name],
            )

    return docs.select("doc_id", source_key().alias("stratum"), "text").mapInArrow(
        encode, f"doc_id {kind}, stratum string, n_tokens long, {name} binary"
    )


def _narrow(ids: np.ndarray) -> np.ndarray:
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")


def pack(tokenised: DataFrame, window: int = 2048, seed: str = "queues", packet: int = PACKET) -> DataFrame:
    """``(doc_id, stratum, start, length, doc_tokens, sequence_id, offset, ids)`` per piece.

    Takes :func:`tokenise`'s rows. Windows are full but for the last, so there is no
    other padding. Rows without a ``doc_id`` or source and repeated rows are packed like
    others; documents without tokens have no piece; no rows give no pieces. Ties in the
    seeded order go by doc_id and number of tokens.
    """
    stages = Stages(tokenised.sparkSession)
    stored, seen = stages.observed_table(
        tokenised.withColumn("row_", F.monotonically_increasing_id()),
        "ids",
        n=F.count("*"),
        total=F.coalesce(F.sum("n_tokens"), F.lit(0)),
    )
    total = max(seen["total"], 1)
    n_rounds = -(-total // window)
    queue = running(
        stored.where("n_tokens > 0").select("row_", "doc_id", "stratum", "n_tokens", seeded(seed, F.col("doc_id")).alias("unit")),
        seen["n"],
        ["stratum"],
        F.col("unit"),
        ["unit", "doc_id", "n_tokens", "row_"],
        F.col("n_tokens"),
    )
    totals = stored.groupBy("stratum").agg(F.sum("n_tokens").alias("queue_tokens"))
    quantum = F.col("queue_tokens") * F.lit(float(window)) / F.lit(float(total))

    def round_of(start):  # the round in which the packet that starts there is sent
        end = F.col("before") + F.least(start + packet, F.col("n_tokens"))
        return F.least(F.greatest(F.ceil(end / quantum), F.lit(1)), F.lit(n_rounds)) - 1

    # A document's packets of one round follow each other, so they go as one piece: those
    # are kept whose round the packet before them is not in.
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(packet).cast("bigint"))
    firsts = F.filter(starts, lambda s: (s == 0) | (round_of(s) != round_of(s - packet)))
    parts = queue.join(totals, "stratum").select("row_", "stratum", "n_tokens", "before", "queue_tokens", firsts.alias("firsts"))
    ends = F.concat(F.slice("firsts", 2, F.size("firsts")), F.array("n_tokens"))
    parts = parts.select(
        "row_", "stratum", "n_tokens", "before", "queue_tokens",
        F.explode(F.arrays_zip(F.col("firsts").alias("start"), ends.alias("end"))).alias("part"),
    )
    sent, counted = stages.observed_table(
        parts.select(
            "row_",
            "stratum",
            F.col("part.start").alias("start"),
            (F.col("part.end") - F.col("part.start")).alias("length"),
            round_of(F.col("part.start")).alias("round"),
            (F.col("before") + F.col("part.start")).alias("at"),
        ),
        "packets",
        n=F.count("*"),
    )
    unit = F.floor(F.col("round") * F.lit(SPAN / n_rounds))
    ordered = running(sent, counted["n"], [], unit, ["round", "stratum", "at"], F.col("length"))
    first, last = F.floor(F.col("before") / window), F.floor((F.col("before") + F.col("length") - 1) / window)
    pieces = ordered.select("*", F.explode(F.sequence(first, last)).alias("sequence_id"))
    low = F.greatest(F.col("before"), F.col("sequence_id") * window)
    high = F.least(F.col("before") + F.col("length"), (F.col("sequence_id") + 1) * window)
    slim = pieces.select(
        "row_",
        (F.col("start") + low - F.col("before")).alias("start"),
        (high - low).alias("length"),
        "sequence_id",
        (low - F.col("sequence_id") * window).alias("offset"),
    )
    # One record per document and its pieces, so that its ids are taken apart once. These
    # are the small side of a partition: the ids stream past a hash of them.
    cuts = slim.groupBy("row_").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    name = "zipped" if "zipped" in stored.columns else "ids"
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.join(cuts.hint("shuffle_hash"), "row_").select("doc_id", "stratum", "n_tokens", name, "cuts").mapInArrow(
        _cut, f"doc_id {kind}, stratum string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


#: About so many bytes of pieces go back at a time.
_BATCH = 1 << 22


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of documents, with the ids of each."""
    unzip = zstandard.ZstdDecompressor().decompress
    names = ["start", "length", "sequence_id", "offset"]
    for batch in slices(batches):
        zipped = "zipped" in batch.schema.names
        whole = batch.column("zipped" if zipped else "ids")
        sizes = batch.column("n_tokens").to_pylist()
        rows, found, size = [], {c: [] for c in [*names, "ids"]}, 0

        def pieces(batch=batch):
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "stratum", "n_tokens")]
            start, length, sequence, offset = (pa.array(found[c], pa.int64()) for c in names)
            return pa.RecordBatch.from_arrays(
                [*taken[:2], start, length, taken[2], sequence, offset, pa.array(found["ids"], pa.binary())],
                names=["doc_id", "stratum", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for k, cuts in enumerate(batch.column("cuts").to_pylist()):
            ids = whole[k].as_py()
            if zipped:
                # Two or four bytes per id, as the document's length tells.
                ids = unzip(ids)
                ids = np.frombuffer(ids, f"<u{len(ids) // sizes[k]}").astype("<u4").tobytes()
            for cut in cuts:
                rows.append(k)
                for c in names:
                    found[c].append(cut[c])
                found["ids"].append(ids[4 * cut["start"] : 4 * (cut["start"] + cut["length"])])
                size += 4 * cut["length"]
                if size >= _BATCH:
                    yield pieces()
                    rows, found, size = [], {c: [] for c in [*names, "ids"]}, 0
        if rows:
            yield pieces()


def windows(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed windows, each at most one window of ids long."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.array_join(F.transform(ordered, lambda p: F.hex(p["ids"])), "").alias("hex_")).select(
        "sequence_id", F.unhex("hex_").alias("ids")
    )


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
