"""Corpus pipeline: from raw documents to packed training sequences.

Five stages, each over everything its predecessor kept. The first four return
the columns of documents: toxic documents go, low-quality documents go, one
document of each group of near copies stays (the lowest id), and secrets are
replaced in the texts that hold them. The last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, packing, quality, secrets, toxicity
from lodestone.runtime import materialise, scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # two runs, as of op2_secrets: English documents fill the ledger, then the blobs that it lacks are scanned
    folder = scratch(spark, "secrets")
    found, added = secrets.scan_places(docs.where("lang = 'en'"))
    secrets.save(folder, 1, added, found)
    ledger, reported = secrets.load(spark, folder)
    return secrets.redact_found(docs, secrets.scan_places(docs, ledger, reported=reported)[0])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
"""The trained classifiers can't be written in SQL; tests hold the stages against brute force."""
