"""The cleaning pipeline: four stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of ``documents``.
``run`` writes each stage's rows as Parquet in the shared folder and rereads them for the next; what a stage staged, and
what it read of its predecessor, is deleted once its own rows are written.

Nulls, empty and long texts, ties and repeated rows: a null or empty text fails the base rules of the first stage, so
the later ones meet it only when called by themselves; then it is not toxic, is kept as a document of its own, and packs
to its end id. Of rows that repeat an id and a text one stays after near_copies. Null ids are documents like others. An
empty table passes through as one. Stages but the last carry every column as it is, whatever its name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import packing, quality, shingle_join, toxicity
from lattica.llm.queries import BYTE_BPE, END_ID, SEQUENCE
from lattica.shared import drop, scratch, stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and every certified rule let pass."""
    return quality.keep(docs, _labels(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field does not call toxic."""
    return toxicity.keep(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return shingle_join.keep(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), SEQUENCE, END_ID)


STAGES = [("quality", quality_rules), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("packing", pack_sequences)]
#: The fitted field and the tokenizer have no SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        with scratch(spark):
            kept = stage(function(spark, docs, sf_dir), name, keep=True)
        if k:
            drop(docs)
        docs = kept
    return docs
