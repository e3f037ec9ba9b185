"""Admission: every refusal is a status, decided by one ordered chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocabulary import FAMILIES, SECOND

_TEXT = r"^[\x21-\x7E]{1,128}$"
_NAME = r"^[a-z0-9_-]+(\.[a-z0-9_-]+)*$"
MAX_AGE_NS = 300 * SECOND


def _identity(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(_TEXT), F.lit(False))


def _at_least_one(column: str) -> Column:
    return F.coalesce(F.col(column) >= 1, F.lit(False))


def _optional(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(r"^[\x21-\x7E]{0,128}$")


def structural_fault(max_lanes: int = 4096) -> Column:
    """Name of the first fault in the reading itself, or null."""
    gauge, counter = F.col("semantics") == "gauge", F.col("semantics") == "counter"
    counted = F.col("unit").isin("count", "bytes")
    value = F.col("gauge_value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    fits = (F.col("counter_value") >= 0) & ((F.coalesce("counter_width", F.lit("")) != "u32") | (F.col("counter_value") <= 4294967295))
    faults = [
        ("link identity", ~(_identity("link_id") & _at_least_one("link_generation"))),
        ("source identity", ~(_identity("source_id") & _at_least_one("source_incarnation"))),
        ("metric id", ~(F.coalesce(F.col("name").rlike(_NAME) & (F.length("name") <= 96), F.lit(False)) & F.col("family").isin(*FAMILIES[1:]))),
        ("provenance", ~(_optional("prov_origin") & _optional("producer"))),
        ("no unit", F.coalesce(F.col("unit") == "none", F.lit(True))),
        ("lane range", (F.col("lane") < 0) | (F.col("lane") >= max_lanes)),
        ("interval", F.col("interval_ns") <= 0),
        ("no reading", ~F.coalesce(gauge | counter, F.lit(False))),
        ("gauge not finite", gauge & ~finite),
        ("gauge validity", gauge & (F.col("gauge_validity_ns") < 0)),
        ("gauge unit", gauge & counted),
        ("counter unit", counter & ~counted),
        ("counter range", counter & ~F.coalesce(fits, F.lit(False))),
    ]
    out = None
    for name, met in faults:
        out = F.when(met, name) if out is None else out.when(met, name)
    return out


def validate(observations: DataFrame, catalog: DataFrame, max_lanes: int = 4096) -> DataFrame:
    """``observations`` with status_code and fault: the metric is registered, the reading sound and as registered."""
    known = catalog.select("family", "name", *(F.col(c).alias(f"cat_{c}") for c in ("unit", "semantics", "lanes")))
    rows = observations.join(F.broadcast(known), ["family", "name"], "left")
    fault = F.coalesce(
        structural_fault(max_lanes),
        F.when(F.col("cat_semantics") != F.col("semantics"), "semantics differ")
        .when(F.col("cat_unit") != F.col("unit"), "units differ")
        .when(~F.col("cat_lanes") & F.col("lane").isNotNull(), "no lanes"),
    )
    status = F.when(F.col("cat_unit").isNull(), "unsupported").when(F.col("fault").isNotNull(), "invalid").otherwise("ok")
    rows = rows.withColumn("fault", F.when(F.col("cat_unit").isNull(), "unknown metric").otherwise(fault)).withColumn("status_code", status)
    return rows.select(*observations.columns, "status_code", "fault")


def capability_gate(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """``rows`` whose status is ok are checked against what their source declared; others pass through."""
    key = ["link_id", "link_generation", "source_id", "source_incarnation", "family", "name"]
    kept = rows.columns
    rows = rows.join(gate, key, "left")
    counter = F.col("semantics") == "counter"
    own, cap = (F.coalesce(c, F.lit("unspecified")) for c in ("counter_width", "cap_width"))
    checks = [
        (F.col("cap_unit").isNull(), "rejected", "not declared"),
        (F.col("cap_unit") != F.col("unit"), "invalid", "unit differs from the declared"),
        (F.col("cap_semantics") != F.col("semantics"), "invalid", "semantics differ from the declared"),
        (F.col("lane").isNotNull() & ~F.col("cap_lanes_declared"), "rejected", "no lanes declared"),
        (F.col("lane") >= F.col("cap_lane_count"), "invalid", "lane over the declared"),
        (counter & (own == "unspecified") & (cap == "unspecified"), "invalid", "no width"),
        (counter & (own != "unspecified") & (cap != "unspecified") & (own != cap), "invalid", "width differs from the declared"),
    ]
    code, fault = F.lit("ok"), F.lit(None).cast("string")
    for met, status, name in reversed(checks):
        code, fault = F.when(met, status).otherwise(code), F.when(met, name).otherwise(fault)
    ok = F.col("status_code") == "ok"
    new = {"status_code": F.when(ok, code).otherwise(F.col("status_code")), "fault": F.when(ok, fault).otherwise(F.col("fault"))}
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in kept))


def age_gate(rows: DataFrame, now_wall_ns: int | str | Column, max_age_ns: int = MAX_AGE_NS) -> DataFrame:
    """Readings of synchronised clocks that are older than ``max_age_ns`` are stale; zero turns the gate off."""
    if max_age_ns <= 0:
        return rows
    now = F.lit(now_wall_ns) if isinstance(now_wall_ns, int) else F.col(now_wall_ns) if isinstance(now_wall_ns, str) else now_wall_ns
    old = (F.col("status_code") == "ok") & F.col("observed_synchronized") & (now - F.col("observed_ns") > max_age_ns)
    return rows.withColumns({"fault": F.when(old, "too old").otherwise(F.col("fault")), "status_code": F.when(old, "stale").otherwise(F.col("status_code"))})


def limit_firsts(rows: DataFrame, key: list[str], within: list[str], most: int, known: DataFrame | None = None) -> DataFrame:
    """Of the distinct ``key`` values in each group ``within``, only the first ``most`` by arrival are let in.

    Covers the limits on streams per link, and on links (an empty ``within``): the first ``most`` keys are cut per
    partition, and the rest are over. Keys that ``known`` holds came before all of ``rows``.
    """
    arrived = rows.where("status_code = 'ok'").select(*within, *key, "ordinal")
    if known is not None:
        arrived = arrived.unionByName(known.select(*within, *key, F.lit(-1).cast("long").alias("ordinal")))
    firsts = arrived.groupBy(*within, *key).agg(F.min("ordinal").alias("_first"))
    if within:
        over = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy("_first"))).where(F.col("_n") > most)
    else:
        let_in = firsts.orderBy("_first").limit(most).select(*(F.col(c).alias(f"_in_{c}") for c in key), F.lit(True).alias("_in"))
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_in_{c}"))
        over = firsts.join(let_in, same, "left_anti")
    names = {c: f"_k_{c}" for c in [*within, *key]}
    over = over.select(*(F.col(c).alias(n) for c, n in names.items()), F.lit(True).alias("_over"))
    met = F.lit(True)
    for c, n in names.items():
        met = met & rows[c].eqNullSafe(F.col(n))
    joined = rows.join(over, met, "left")
    hit = (F.col("status_code") == "ok") & F.coalesce("_over", F.lit(False))
    return joined.withColumn("status_code", F.when(hit, "limit-exceeded").otherwise(F.col("status_code"))).select(*rows.columns)


def outcome_columns(status: str = "status_code") -> list[Column]:
    """How many rows were read, let in, refused, and the code of the first refusal by arrival."""
    bad = F.col(status) != "ok"
    return [
        F.count("*").alias("total"),
        F.count_if(~bad).alias("accepted"),
        F.count_if(bad).alias("refused"),
        F.min_by(F.when(bad, F.col(status)), F.when(bad, F.col("ordinal"))).alias("first_code"),
    ]


def outcome(rows: DataFrame, status: str = "status_code") -> DataFrame:
    """One row with the columns of ``outcome_columns``."""
    return rows.agg(*outcome_columns(status))
