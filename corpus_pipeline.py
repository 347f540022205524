"""Documents to packed training sequences: each stage is one operator of tidemark.llm.

Defined cases, for every stage: a null text is empty, is never toxic, holds no passage and no secret, and is packed as its end
sign; rows without a doc_id stay unless a copy of theirs stays; repeated rows are copies, of which one stays; long texts are
taken whole; other columns of the input are dropped; an empty table gives an empty one with the columns of documents (packing:
no sequences). What is written between the stages is removed when it has been read for the last time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, packing, secrets, simhash, toxicity
from tidemark.llm.common import DOCUMENT_COLUMNS, read
from tidemark.operators.lineage import forget, shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs.select(*DOCUMENT_COLUMNS), read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs.select(*DOCUMENT_COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs.select(*DOCUMENT_COLUMNS), read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs.select(*DOCUMENT_COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the trained scores nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written as Parquet in the shared folder and reread."""
    docs, before = read(spark, sf_dir, "documents"), None
    shared = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{shared}/corpus-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # it has cut the lineage of its pieces
    forget(spark, before)
    return packed
