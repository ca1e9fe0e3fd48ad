"""A training-data pipeline over documents: five stages, each one corpus operator, each written as Parquet and reread.

Toxic documents go; of each group of near duplicates one document stays; personal values become pseudonyms; sources are
mixed to their target weights; the texts are encoded. All stages but the last carry all columns along, whatever their
names; the last returns doc_id and the encoding. A document with a null or empty text goes through every stage, and doc_id may
be of any type. What a stage wrote is deleted once the next stage has written its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwarden.llm import bpe, mixing, pii, similar, toxicity
from fieldwarden.llm.queries import PII_KEY, RANKS, fold
from fieldwarden.session import table, with_checkpoint_dir


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic. It learns from all documents' labels of the training fold."""
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(table(spark, sf_dir, "documents"), labels)
    return toxicity.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least doc_id, of each group of copies and of texts alike in 0.8 of their five-word shingles."""
    return similar.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.apply(docs, PII_KEY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words; the part of a whole copy is rounded by a seeded draw."""
    return mixing.copies(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    return bpe.tokens(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_duplicates),
    ("pii", pseudonyms),
    ("source_mix", source_mix),
    ("byte_bpe", encoded),
]

#: The classifier and the pseudonyms have no SQL form; tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each one returns is written to the shared folder of checkpoints and read again."""
    with_checkpoint_dir(spark)
    home = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            _delete(spark, before)
        before = f"{home}/{name}"
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
