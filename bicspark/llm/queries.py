"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline

from bicspark.llm import (
    binarycodes,
    conversations,
    gam,
    jaccard,
    langid,
    mixing,
    multiprobe,
    packing,
    sharding,
    skipchain,
    tokenfile,
    toxicity,
    whitening,
)
from bicspark.llm.common import read, ship_code
from bicspark.llm.oracles import CONVERSATIONS, MIXING
from bicspark.plans.stages import Stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {"op3_mixing": MIXING, "op11_conversations": CONVERSATIONS}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_near_duplicate_vectors(spark, sf_dir):
    """Every vector with its links and its component at cosine 0.9."""
    return binarycodes.near_duplicates(read(spark, sf_dir, "embeddings"), 0.9)


@query
def op2_nearest_neighbours(spark, sf_dir):
    """The 20 nearest rows of every query, by inner product."""
    table = read(spark, sf_dir, "embeddings")
    return multiprobe.search(table, table.where("vec_id % 20 = 0"), 20)


@query
def op3_mixing(spark, sf_dir):
    """Every document with the words that the mix takes of it."""
    return mixing.mix_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op4_sharding(spark, sf_dir):
    """Every document in one of eight shards of equal row counts."""
    placed = sharding.interleave(read(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_packing(spark, sf_dir):
    """Every document's pieces in sequences of at most 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenised = packing.tokenise(read(spark, sf_dir, "documents"), path, end_id=1, spaces_kept=False, zipped=True)
    return packing.digest(packing.pack(tokenised, 2048))


@query
def op6_jaccard_join(spark, sf_dir):
    """Every document with its group of documents alike."""
    return jaccard.join(read(spark, sf_dir, "documents"), 75)


@query
def op7_personal_data(spark, sf_dir):
    """Every document with its personal data."""
    return skipchain.personal_data(read(spark, sf_dir, "documents"))


@query
def op8_token_file(spark, sf_dir):
    """Every document as read back from the token files."""
    folder = Stages(spark).path("blocks")
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenfile.write_blocks(read(spark, sf_dir, "documents"), folder, path, end_id=0, vocabulary=50_257)
    read_back = tokenfile.read_documents(spark, folder)
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_toxicity(spark, sf_dir):
    """Every document with its toxicity score."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_quality(spark, sf_dir):
    """Every document with its quality score."""
    return gam.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op11_conversations(spark, sf_dir):
    """Every conversation, damaged, with its faults and the cheapest edits that mend it."""
    return conversations.audit(conversations.damaged(read(spark, sf_dir, "conversations")))


@query
def op12_whitening(spark, sf_dir):
    """Every vector on the first four whitened components."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), 4)


@query
def op13_language(spark, sf_dir):
    """Every document with its predicted language."""
    return langid.languages(read(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    """The documents of the corpus pipeline, packed."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
