"""A corpus from raw documents to packed training sequences, in five stages over whole tables.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, further columns of any name, and
empty tables, which stay empty; all but the last keep the columns.  What each does with these is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.llm import exact, minhash, packing, pii, toxicity
from contactsheet.llm.common import table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    Texts that are null, empty or without words score 0 and stay, as all do without labels of both classes; repeated
    rows score alike and stay or go together.  It learns from the rows of `docs` that have labels.  The rows come from a
    table written here, since whoever writes a lazy result decides how large the workers' batches are.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return written(toxicity.score(docs, model).where("predicted = 0").select(docs.columns), "clean", small=True)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the most code points, then the smallest doc_id, null last.

    Null, empty and blank texts are equal.  Of rows with the same doc_id too the one with the smallest hash stays.
    """
    return exact.keep(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the smallest doc_id, null last, and of its rows just one.

    Texts without words, null and empty ones too, are near equal texts only.
    """
    return minhash.keep(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data and `n_chars` counted anew; a null text stays null, as does its count."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences.

    A null or empty text is its end id alone; repeated rows are packed as often as they occur.
    """
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("near dedup", different), ("pii", private), ("packing", packed)]

#: The classifier, the signatures and the tokenizer are beyond SQL; tests hold the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
