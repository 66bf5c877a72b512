"""Corpus preparation: language, near duplicates, benchmark passages, subword ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. `run` writes each stage's result to the shared
folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowgauge.llm import decontam, langid, simhash, sp_dropout
from flowgauge.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or without a clear language go."""
    return langid.keep_identified(docs, langid.train(docs, only=~langid.held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of fingerprints linked at two bits or fewer."""
    return simhash.drop_near_duplicates(docs, width=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words, nor a whole shorter item, with the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document under merge-dropout; texts decode from them without loss."""
    return sp_dropout.encode(docs).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("subwords", subwords),
]

#: The stages learn a model, hash with XXH64, follow links of any length and segment by a vocabulary file: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
