"""Link generations: which is current, which are superseded or forgotten, and what that does to evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def registry(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per link and generation seen: first arrival, number of observations, and whether a newer one came.

    ``known`` (link_id, link_generation, first_ordinal, evidence_count) is what was seen before ``rows``.
    """
    own = rows.groupBy("link_id", "link_generation").agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("evidence_count"))
    if known is not None:
        both = own.unionByName(known.select(own.columns)).groupBy("link_id", "link_generation")
        own = both.agg(F.min("first_ordinal").alias("first_ordinal"), F.sum("evidence_count").alias("evidence_count"))
    newest = F.max("link_generation").over(Window.partitionBy("link_id"))
    own = own.withColumn("current_generation", newest)
    old = F.col("link_generation") < F.col("current_generation")
    return own.withColumns({"superseded": old, "superseded_by": F.when(old, F.col("current_generation"))})


def fencing(rows: DataFrame) -> DataFrame:
    """``rows`` with fenced_generation: a newer generation of the link had already come when the row arrived.

    A row is compared with the first arrivals of the link's generations, which are few, and not with all rows of the link.
    """
    firsts = rows.groupBy("link_id", "link_generation").agg(F.min("ordinal").alias("first"))
    firsts = firsts.groupBy(F.col("link_id").alias("_link")).agg(F.collect_list(F.struct("link_generation", "first")).alias("_firsts"))
    joined = rows.join(firsts, F.col("link_id") == F.col("_link"), "left")
    newer = F.exists("_firsts", lambda f: (f["link_generation"] > F.col("link_generation")) & (f["first"] < F.col("ordinal")))
    return joined.withColumn("fenced_generation", F.coalesce(newer, F.lit(False))).drop("_link", "_firsts")


def kept_generations(rows: DataFrame, keep: int = 4, known: DataFrame | None = None) -> DataFrame:
    """The registry with evicted: only the last ``keep`` generations of a link, by first arrival, are held."""
    latest = Window.partitionBy("link_id").orderBy(F.desc("first_ordinal"))
    return (registry(rows) if known is None else known).withColumn("_n", F.row_number().over(latest)).withColumn("evicted", F.col("_n") > keep).drop("_n")


def evict(rows: DataFrame, keep: int = 4, known: DataFrame | None = None) -> DataFrame:
    """``rows`` without the evidence of evicted generations; ``known`` is their registry, if there is one."""
    gone = kept_generations(rows, keep, known).where("evicted").select("link_id", "link_generation")
    return rows.join(gone, ["link_id", "link_generation"], "left_anti")
