"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, substring dedup and packing.

Every stage takes any columns and, but for the last, returns those of documents; others are left out. Null texts stay
null and empty ones empty; rows with a null doc_id are never copies of others and stay; rows that repeat are treated
alike, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidq.llm import lines, packing, substrings, toxicity
from evidq.llm.common import stored, table
from evidq.llm.minhash import near_duplicates

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades 1 or more go; the model is fitted on the labelled ones of ``docs``."""
    return toxicity.reject_toxic(docs.select(_COLUMNS), toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten sources or more stay where they come first only; every document stays."""
    return _documents(lines.dedup_lines(docs.select(_COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near-equal sets of five-word shingles, the smallest doc_id stays."""
    found = near_duplicates(docs, width=5, percent=80)
    gone = stored(found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.select(_COLUMNS).join(gone, docs.doc_id == F.col("_gone"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that stand in an earlier document are cut out."""
    return _documents(substrings.remove_repeats(docs, carried=[c for c in _COLUMNS if c not in ("doc_id", "text")]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 ids, filled by best fit."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: Model fitting, sketches and tokenisation are beyond SQL; stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
