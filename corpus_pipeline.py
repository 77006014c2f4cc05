"""The corpus pipeline: raw documents to a training mix in five stages.

Every stage is one operator of ``adflow.llm`` with production parameters. It takes
the rows its predecessor kept and returns the rows it keeps, with the columns of
``documents``; its result is written as Parquet and read again, so a lost executor
costs at most the stage it worked on. The last stage returns a row for each copy
that the mix takes.

Defined results for odd input are those of the operators: a document without
letters is rejected by the first stage; repeated rows are exact copies, of which
one stays; empty tables stay empty; other columns travel along untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from adflow.llm import decontam, exact_dedup, langid, mixing, simhash
from adflow.operators.materialize import intermediates
from adflow.session import ensure_checkpoint_dir
from adflow.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told with confidence go."""
    return langid.accepted(docs, sample_per_lang=1500)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints, the one with the smallest id stays."""
    return simhash.near_dedup(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or sampled to their target weights."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("simhash_near_dedup", near_copies),
          ("decontamination", decontamination), ("mixing", mix)]

#: A trained model and connected components have no SQL form; the tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Stage results lie in the shared checkpoint
    folder; the intermediates of a stage are deleted once it has been written."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with intermediates(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
