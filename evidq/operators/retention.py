"""Bounded retention: a ring per stream, a history overall, and what a snapshot keeps of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocabulary import FAMILIES, STREAM, rank

RING, HISTORY = 64, 65_536


def ring(evidence: DataFrame, size: int | None = RING, key: list[str] | None = None) -> DataFrame:
    """The last ``size`` rows of each stream by arrival; all rows if it is None."""
    if size is None:
        return evidence
    newest = Window.partitionBy(*(key or STREAM)).orderBy(F.desc("ordinal"))
    return evidence.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= size).drop("_n")


def history(evidence: DataFrame, size: int = HISTORY) -> DataFrame:
    """The last ``size`` rows by arrival; ``size`` bounds what meets in one task."""
    return evidence.orderBy(F.desc("ordinal")).limit(size)


def retained(evidence: DataFrame, size: int = RING) -> DataFrame:
    """Ring rows and each stream's newest fed row, once per sequence."""
    # windows, not aggregates of whole rows: columns that nobody asks for are never carried through the sorts
    newest = F.max(F.when(F.col("fence") == "accepted", F.col("sequence"))).over(Window.partitionBy(*STREAM))
    back = Window.partitionBy(*STREAM).orderBy(F.desc("ordinal"), F.desc("sequence"))
    rows = evidence.withColumn("_n", F.row_number().over(back)).withColumn("_newest", newest)
    rows = rows.where((F.col("_n") <= size) | ((F.col("fence") == "accepted") & (F.col("sequence") == F.col("_newest"))))
    # of equal sequences the first arrival stays
    first = Window.partitionBy(*STREAM, "sequence").orderBy("ordinal")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*evidence.columns)


def in_order(records: DataFrame) -> DataFrame:
    """By link, metric, lane (lanes first, aggregate last), source and sequence."""
    metric = rank("family", FAMILIES)
    return records.orderBy("link_id", "link_generation", metric, "name", F.col("lane").isNull(), "lane", "source_id", "source_incarnation", "sequence")
