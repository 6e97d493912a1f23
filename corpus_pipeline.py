"""Corpus cleaning in five stages, each an operator over all documents that the stage before it kept.

Every stage is written as Parquet to the shared folder and read again as the next one's input, so a lost
executor repeats at most the stage it was in. All but the last return the columns of documents; the last
returns doc_id, n_tokens and the ids of the SentencePiece model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from waymark.llm import decontaminate, minhash, piece_codec, secret_scan, toxicity
from waymark.llm.common import materialize, release, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id."""
    return minhash.keep_one(docs, 5, 80)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every text."""
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids")


def fresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun when the executors have given back the heap that the stages before it left."""

    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES = [(name, fresh(stage)) for name, stage in (("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", contaminated), ("secrets", secrets), ("sentencepiece", tokens))]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = materialize(docs, f"stage{k}")
    return docs
