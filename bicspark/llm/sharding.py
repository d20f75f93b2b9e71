"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked. The fractional rank
``(rank + 1/2) / rows of the source`` spreads every source evenly over [0, 1), so any
run of the rows in that order has the mixture of the whole. The order is cut into
shards whose row counts differ by at most one (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bicspark.llm.common import seeded, source_key
from bicspark.llm.prefix import SPAN, running
from bicspark.plans.stages import Stages


def interleave(docs: DataFrame, n_shards: int, seed: str = "shards") -> DataFrame:
    """``(doc_id, source, size, text_crc32, shard, slot)`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1. A null text counts as empty, with
    crc 0; rows of a null source form a source of their own; rows without a ``doc_id``
    and repeated rows are rows like others. Rows that tie in hash go by doc_id, crc and
    size. An empty table gives no rows; with fewer rows than shards some are empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    stages = Stages(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows, seen = stages.observed_table(
        docs.select(
            "doc_id",
            "source",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            source_key().alias("stratum"),
            seeded(seed, F.col("doc_id")).alias("unit"),
        ),
        "rows",
        n=F.count("*"),
    )
    n_rows = seen["n"]
    order = ["doc_id", "text_crc32", "size"]
    ranked = running(rows, n_rows, ["stratum"], F.col("unit"), ["unit", *order], F.lit(1))
    totals = rows.groupBy("stratum").agg(F.count("*").alias("n_stratum"))
    share = (F.col("place") + F.lit(0.5)) / F.col("n_stratum")
    ranked = stages.table(
        ranked.join(totals, "stratum").select(*rows.columns, share.alias("share")), "ranked"
    )
    total = F.lit(max(n_rows, 1)).cast("bigint")
    placed = running(
        ranked, n_rows, [], F.floor(F.col("share") * SPAN), ["share", "stratum", *order], F.lit(1)
    )
    shard = F.floor(F.col("place") * n_shards / total)
    first = F.ceil(shard * total / F.lit(n_shards))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        shard.cast("int").alias("shard"),
        (F.col("place") - first).cast("bigint").alias("slot"),
    )
