"""The replay fence: a watermark of sequences per stream, and a window behind it in which repeats are recognised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.vocabulary import STREAM

WINDOW = 256


def digest() -> Column:
    """Of what a reading says: metric, lane, unit, reading, time, authority and class; not of how it came."""
    parts = [
        text.metric_id(), F.coalesce(F.col("lane").cast("string"), F.lit("aggregate")), F.col("unit"), text.reading(),
        F.col("observed_ns").cast("string"), F.col("authority").cast("string"), F.col("evidence_class"),
    ]
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("\x1e")) for p in parts)), 256)


def fenced(rows: DataFrame, window: int = WINDOW, key: list[str] | None = None, digest_column: str | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """``rows`` with fence: accepted, reordered, duplicate, id-mismatch or fenced.

    ``rows`` are admitted readings in the order of ``ordinal``, then sequence and digest. The watermark is the largest sequence so far; a sequence
    less than ``window`` behind it that was seen is a duplicate or, with another digest, an id-mismatch; one more than
    ``window`` behind is fenced; others behind it are reordered and feed nothing. Repeats and fenced rows never raise
    the watermark, so plain running windows over all rows give it. ``seeds`` (key, sequence, ordinal, digest) are
    arrivals that are known of but no longer held.
    """
    key = key or STREAM
    # two arrivals with one ordinal come in the order of sequence and digest, so that the answer never depends on the run
    before = Window.partitionBy(*key).orderBy("ordinal", "sequence", "_digest").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*key, "sequence").orderBy("ordinal", "_digest")
    hashed = rows.withColumn("_digest", digest() if digest_column is None else F.col(digest_column))
    if seeds is not None:
        known = seeds.select(*key, "sequence", "ordinal", F.col("digest").alias("_digest"), F.lit(True).alias("_seed"))
        hashed = hashed.withColumn("_seed", F.lit(False)).unionByName(known, allowMissingColumns=True)
    # the mark first: rows that are dealt by stream need no second shuffle for the windows of its sequences
    seen = hashed.withColumn("_mark", F.max("sequence").over(before))
    seen = seen.withColumns({"_nth": F.row_number().over(same), "_first": F.first("_digest").over(same)})
    behind = F.col("_mark") - F.col("sequence")
    status = (
        F.when((F.col("_nth") > 1) & (behind < window), F.when(F.col("_digest") == F.col("_first"), "duplicate").otherwise("id-mismatch"))
        .when(behind > window, "fenced")
        .when(behind > 0, "reordered")
        .otherwise("accepted")
    )
    out = seen.withColumn("fence", status).drop("_digest", "_mark", "_nth", "_first")
    return out if seeds is None else out.where("NOT _seed").drop("_seed")


def latest(fed: DataFrame, key: list[str] | None = None, order: str = "sequence") -> DataFrame:
    """The newest row of each stream."""
    key = key or STREAM
    rest = [c for c in fed.columns if c not in key]
    return fed.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")
