"""A training-data pipeline of five operators over documents.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's docs. All stages but the last return the
columns of their docs, extra ones with clashing names included. Every stage takes
nulls in any column, empty and very long texts, repeated rows and empty tables; what
becomes of them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.llm import decontaminate, langid, mixing, pii, simhash
from glossaflow.llm.common import read_table, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null and empty texts, those without a letter, and texts that their predicted language's filter hardly contains.

    Repeated rows fare alike.
    """
    filters = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    return langid.keep_known(docs, filters)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id (null last) of each near-duplicate group; wholly equal rows once. Texts without words are one group."""
    return simhash.keep_one(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth or more. Texts without words stay; repeated rows fare alike."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [EMAIL], [IP], [CARD] and [PHONE] in the place of personal data; n_chars, if there, follows the new text. Null texts stay null."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows that it leaves out go, the others stand once an epoch that takes them.

    Adds size, source_size, target, taken (words that this copy gives) and epoch. Rows
    without words go; a null source is a source of its own; rows with equal doc_id are
    taken alike.
    """
    return mixing.apply(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Trained filters, fingerprint components and boosted trees are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
