"""A training-data pipeline over the documents table: classify, deduplicate, mix, pack.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet, and the next stage reads that. All stages but the last return
the columns of documents; stage 4 may return a document several times or not at all, as its Poisson draw says. With labels of one class only,
nothing can be learnt and stage 1 keeps all documents.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import scratch, shared_dir
from gridloom.llm.dedup import drop_duplicates
from gridloom.llm.jaccard import drop_near_duplicates
from gridloom.llm.mixing import mix
from gridloom.llm.packing import pack, pieces_digest
from gridloom.llm.quality import NoClasses, score, train
from gridloom.llm.tokens import public_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this table's labels, takes for good ones."""
    try:
        model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    except NoClasses:
        logging.getLogger(__name__).warning("labels of one class only: the quality stage keeps all documents")
        return docs
    return score(docs, model, keep_text=True).where("predicted = 1").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the flattened source weights."""
    return mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens."""
    return pieces_digest(pack(docs, public_path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
