"""A corpus pipeline of five stages, each written and read again: language ID, line dedup, SimHash near-dedup, mixing, BPE.

Every stage handles null, empty and very long texts, repeated rows, ties and empty tables as its operator says, and passes on columns
beyond those of `documents` as long as it returns documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, langid, lines, mixing, simhash
from paperloom.llm.common import settle


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language (op8): those without a letter go. With four languages or fewer the limit rejects no other text.

    The network is trained on documents of this stage's own input that are not held out.
    """
    return langid.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, but for a word, in an earlier place (op9); n_chars is counted anew."""
    return lines.dedup_lines(docs, length_col="n_chars")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (op2)."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights (op5): documents repeated or left out as it takes them."""
    return mixing.mix_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and digests of them and of what they decode to (op7)."""
    import public_tokenizers

    return bpe.token_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("source_mix", mix),
    ("byte_bpe", tokenise),
]

#: A trained network and sha256 over merged ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
