"""From raw documents to packed sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peaklight.llm import dedup, jaccard, langid, packing, pii
from peaklight.llm._base import Stage, gathered


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which the network sees one language clearly likelier than guessing would, and fills in languages that are missing.

    Null texts and texts without any letter go.  Where no document has a language nothing can be learned, and all others stay.
    """
    return langid.drop_unidentified(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, keeps the longest, then the smallest doc_id."""
    return dedup.drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, keeps the smallest doc_id."""
    return jaccard.keep_one_of_each(docs, k=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text; keeps all rows."""
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 8192 byte tokens in length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("personal_data", personal_data), ("packing", pack)]

#: A trained network decides the first stage and graph components the third; no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes its rows to the shared folder, where the next one reads them.

    Once a stage is written, the one before it and all tables it worked with are deleted: the last stage alone stays.
    An empty table gives no rows; other columns of documents, whatever their names, are kept up to the last stage.
    """
    docs, stage = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stage(spark, "pipeline")
    for name, step in STAGES:
        with gathered() as made:
            docs = stage(step(spark, docs, sf_dir), name)
        for own in made:
            own.keep_only()
        stage.keep_only(docs)
    return docs
