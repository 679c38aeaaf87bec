"""The corpus pipeline: quality, near-duplicates, decontamination, PII, packing.

Each stage applies one training-data operator to all that the stage before it
kept, and all but the last return the columns of `documents`; other columns of
their input are left out.  In every stage nulls may stand in any column, rows may
repeat, texts may be empty or very long, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm import decontamination, packing, pii, quality, similar_groups
from streamweave.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    It learns from all labelled rows of `docs` (a bounded draw of them).  Null and
    empty texts are scored by the statistics zero; null ids are never learned from,
    but scored; repeated rows are scored alike and each kept or not.  Without
    labels all scores are 0.5, so everything stays.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, model).where(F.col("predicted") == 1).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    The smallest id stays, null ids last.  Equal word sequences are one group, so
    null, empty and blank texts are one; rows equal in id and text are one row.
    Texts of fewer than five words are one shingle.
    """
    return similar_groups.keep_one(docs, size=5, similarity=0.8).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go.

    Null and empty texts hold none and stay; benchmark rows with null id or text
    aren't looked for; repeated rows go or stay alike.
    """
    found = decontamination.with_leaks(docs, table(spark, sf_dir, "benchmark"), name="__leaks")
    return found.where(F.size("__leaks") == 0).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.

    No row goes.  Null texts stay null and empty ones empty, n_chars as it was;
    where something was replaced n_chars is the new length.
    """
    found = pii.redact_found(docs, pii.train(docs), name="__spans")
    return found.withColumn("n_chars", F.when(F.col("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens.

    Null and empty texts are the end id alone; null and repeated ids are packed
    row by row.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
#: The learned stages can't be stated in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, cut between stages so that none runs twice."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
