"""Inspection: what is fresh, what is stale and what conflicts, over all links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import FAMILIES, rank
from .assess import METRIC

ENTRIES, CLAIMANTS = 256, 8


def freshness(metrics: DataFrame, strict_parity: bool = False) -> DataFrame:
    """Per link and metric the number of sources declared, fresh, stale and recovered, and the least fresh age.

    With ``strict_parity`` the age is 0 wherever something is fresh, and the age of nothing else is given.
    """
    n = lambda f: F.size(F.filter("evidence", f))
    age = F.array_min(F.transform(F.filter("evidence", lambda e: e["fresh"]), lambda e: e["age_ns"]))
    return metrics.select(
        *METRIC, F.col("sources_declared").alias("declared_sources"), F.col("sources_fresh").alias("fresh_sources"),
        (F.col("sources_fresh") > 0).alias("has_fresh_evidence"),
        n(lambda e: (e["origin"] == "live") & ~e["fresh"]).alias("stale_sources"), n(lambda e: e["origin"] == "recovered").alias("recovered_sources"),
        F.coalesce(F.lit(0).cast("long") if strict_parity else age, F.lit(0)).alias("newest_age_ns"),
    )


def stale(metrics: DataFrame) -> DataFrame:
    """Live evidence that has expired, one row per source."""
    rows = metrics.select(*METRIC, F.explode("evidence").alias("e")).where("e.origin = 'live' AND NOT e.fresh")
    return rows.select(*METRIC, "e.lane", "e.source_id", "e.source_incarnation", "e.age_ns", F.lit("evidence-expired").alias("reason"))


def conflicts(metrics: DataFrame, policy) -> DataFrame:
    """Metrics in conflict with their spread, the tolerance of their rule, and who claims what."""
    rules = policy.rule_frame(metrics.sparkSession).select("family", "name", "tolerance")
    rows = metrics.where("state = 'conflicting'").join(F.broadcast(rules), ["family", "name"], "left")
    claims = F.transform(F.slice("evidence", 1, CLAIMANTS), lambda e: F.concat_ws("=", e["source_id"], e["rendered"]))
    return rows.select(*METRIC, F.coalesce("disagreement", F.lit(0.0)).alias("spread"), F.coalesce("tolerance", F.lit(0.0)).alias("tolerance"), claims.alias("claimants"))


def capped(entries: DataFrame, most: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` entries by link and metric, and one row with how many were dropped."""
    order = ["link_id", "link_generation", rank("family", FAMILIES), "name"]
    dropped = entries.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"), (F.count("*") > most).alias("truncated"))
    return entries.orderBy(*order).limit(most), dropped
