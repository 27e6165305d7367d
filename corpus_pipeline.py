"""A cleaning and packing pipeline over ``documents``; see ``STAGES``.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``.
Rows without a doc_id are treated like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupstats.llm.packing import pack
from groupstats.llm.queries import in_training
from groupstats.llm.repeats import remove_repeats
from groupstats.llm.simhash import first_of_classes
from groupstats.llm.toxicity import score_toxicity, train_toxicity
from groupstats.session import shared_folder

#: Score from which a document is rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_FROM``; the labels of the table train the model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels, in_training)
    scored = score_toxicity(docs, model)
    return scored.filter(F.col("score") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash fingerprints of three-word shingles linked at up to two bits.

    The smallest id stays, rows without id come last and take part like others.
    """
    return first_of_classes(docs, shingle=3, max_bits=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; a character that loses a byte goes."""
    cut = remove_repeats(docs, width=100, keep_text=True)
    text = F.when(F.col("text").isNull(), None).otherwise(F.col("kept_text"))
    cut = cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), length=4096, closing_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_documents),
]

#: SQL cannot express a trained score or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; each result is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
