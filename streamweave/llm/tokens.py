"""Token counts (operator 1)."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamweave.llm import bpe
from streamweave.llm.common import arrow_udf, drop_clashing, fresh, table

DEFAULT_FILE = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> tuple[str, str]:
    """The tokenizer file and its proven whole tokens, as text (fixed size: one vocabulary)."""
    config = Path(path).read_text(encoding="utf-8")
    return config, json.dumps(bpe.prove_whole_tokens(config))


def shipped(spark: SparkSession, path: str | None):
    """Broadcast the tokenizer (a vocabulary file of a few MB, whatever the corpus)."""
    return spark.sparkContext.broadcast(_tokenizer(str(path or public_tokenizers.path(DEFAULT_FILE))))


def count_tokens(df: DataFrame, text_col: str = "text", tokenizer_path: str | None = None, limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens (long) and over_limit (boolean: n_tokens > limit).

    Counts are those of the tokenizer file's own library without added special
    tokens.  A map-only job: no shuffle, one Arrow batch of texts at a time.
    Null and empty texts count zero bytes and zero tokens; repeated rows are
    counted each; an empty table gives an empty result; input columns of the
    three produced names are replaced, all others are kept.
    """
    shared = shipped(df.sparkSession, tokenizer_path)

    def counts(batches):
        config, whole = shared.value
        ids = bpe.encoder(config, whole).ids
        for texts in batches:
            yield pa.array([len(ids(t)) >> 2 for t in texts.to_pylist()], pa.int64())

    udf = arrow_udf(df.sparkSession, counts, "long")
    (text,) = fresh(df, "text")
    kept = drop_clashing(df.withColumn(text, F.col(text_col)), ["n_bytes", "n_tokens", "over_limit"])
    out = kept.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": udf(F.col(text))})
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit)).drop(text)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
