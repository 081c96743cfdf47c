"""Corpus pipeline: five stages over `documents`, each calling one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet in the shared checkpoint folder and reads it back as
the next one's docs, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.jaccard_join import keep_one
from sluice.llm.language_crf import annotate, fit
from sluice.llm.mixing import mix_sources
from sluice.llm.packing import pack_documents
from sluice.llm.secret_scan import redact
from sluice.llm.textcore import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if it has no letter or if fewer of its trigrams are known from the learned languages.
LEAST_FAMILIAR = 0.6
#: Share of tokens that the mixing stage aims to keep.
TOKEN_BUDGET = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach stay; lang becomes the predicted one.

    Texts without a letter (null and empty ones too) go, and texts in other
    languages or junk.  Nothing is learned from a table without labels: then
    all go.
    """
    found = annotate(docs.select(*COLUMNS), fit(docs), lang_name="__lang", score_name="__score", known_name="__known")
    kept = found.where((F.col("__lang") != "und") & (F.col("__known") >= LEAST_FAMILIAR))
    return kept.withColumn("lang", F.col("__lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest id."""
    return keep_one(docs).select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities calibrated to the target weights.

    Texts without a word (null and empty ones too) have probability 0 and go;
    equal ids share a draw; an empty table stays empty.
    """
    return mix_sources(docs, budget=TOKEN_BUDGET).where("mix_kept").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences, with their token ids.

    A null or empty text is its end mark alone; repeated rows are packed each;
    an empty table has no pieces.
    """
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing),
    ("packing", packing),
]

#: Language ID, the verified join and column generation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.

    Only that stage's folder stays, as the result is read from it; the others
    are removed as soon as the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(docs)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    last = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            remove(spark, last)
        last = path
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file system has it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
