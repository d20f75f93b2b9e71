"""A training corpus from ``documents``: five stages, each over all that the last one kept.

Quality classifier, near duplicates, personal data, mixture of sources, packing. Each
stage function takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bicspark.llm import gam, jaccard, mixing, packing, skipchain
from bicspark.llm.common import read, ship_code
from bicspark.plans.stages import Stages, dropped_after

#: SQL can't express the learnt stages; they are tested against plain versions.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Every row is judged by its
    text alone; null, blank and repeated ones like others. Columns keep names and values."""
    ship_code(spark)
    return gam.kept_by_quality(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Texts without words
    and null texts stay, one for each ``doc_id``. Columns keep names and values."""
    ship_code(spark)
    return jaccard.representatives(docs, 75)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null and empty
    texts stay. Columns other than ``text`` and ``n_chars`` keep names and values."""
    ship_code(spark)
    return skipchain.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it. Null texts and
    texts without words are never taken. Columns keep names and values."""
    ship_code(spark)
    return mixing.mixture(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with a digest of their ids."""
    ship_code(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenised = packing.tokenise(docs, path, end_id=1, spaces_kept=False, zipped=True)
    return packing.digest(packing.pack(tokenised, 2048))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("personal_data", without_personal_data),
    ("mixture", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    A stage's own tables go when its result is written, and that goes when the next one
    is, so that disk holds two stages at a time; ``keep`` keeps all results.
    """
    stages, docs, last = Stages(spark), read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with dropped_after():
            docs = stages.table(stage(spark, docs, sf_dir), name)
        if last and not keep:
            stages.drop(last)
        last = name
    return docs
