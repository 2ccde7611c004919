"""The corpus pipeline: five stages over `documents`, each an operator of `refloom.llm`.

Quality, toxicity, near-duplicates, benchmark leaks, token ids. Every stage works on all documents that the one before
kept; the first four return the columns of `documents`, the last one the token ids. Models are fitted on the labelled
documents of the whole table. Documents with a null doc_id pass the near-duplicate and leak stages, which speak of
documents by their id; rows equal in doc_id and text become one row in the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from refloom.llm import benchmark_leaks, common, ordinal_quality, piece_bpe, similar_texts, toxicity_chain


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ordinal_quality.select(docs, ordinal_quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_chain.select(docs, toxicity_chain.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar_texts.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaked = benchmark_leaks.leaks(docs, _table(spark, sf_dir, "benchmark"), short=True).select("doc_id").distinct()
    return common.drop_rows(docs, leaked, "doc_id")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("token_ids", token_ids)]

#: Fitted models, SimHash and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done, path = path, common.fresh_dir(spark, f"stage-{name}")
        with common.scratch(spark):  # what the stage wrote on its way is removed
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if done:  # nothing reads the stage before any more
            common.remove(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)
