"""Observations from an event table, clean or with the dirt of real arrivals; and a synthetic generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocabulary import SECOND

EPOCH = 0x1234
# Event type to metric: family, name, unit, semantics.
METRICS = {
    "click": ("signal-power", "rx.level", "dBm", "gauge"),
    "view": ("signal-ratio", "snr", "dB", "gauge"),
    "signup": ("signal-ratio", "margin", "dB", "gauge"),
    "purchase": ("loss-ratio", "loss.ratio", "ppm", "gauge"),
    "error": ("error-counter", "errors.corrected", "count", "counter"),
}
COLUMNS = [
    "ordinal", "link_id", "link_generation", "source_id", "source_incarnation", "sequence", "family", "name", "lane", "unit",
    "semantics", "gauge_value", "gauge_validity_ns", "counter_value", "counter_width", "reset_declared", "observed_ns",
    "observed_synchronized", "interval_ns", "authority", "transport", "evidence_class", "prov_origin", "producer",
    "received_wall_ns", "received_steady_ns", "received_epoch", "origin",
]


def _of_metric(i: int) -> Column:
    out = None
    for kind, parts in METRICS.items():
        out = F.when(F.col("event_type") == kind, parts[i]) if out is None else out.when(F.col("event_type") == kind, parts[i])
    return out


def nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def _observations(rows: DataFrame, **columns: Column) -> DataFrame:
    """All columns of evidence; ``columns`` override the plain ones."""
    ns = nanos("ts")
    null = lambda t: F.lit(None).cast(t)
    all_ = {
        "ordinal": F.col("event_id"), "link_id": F.concat(F.lit("link-"), F.col("user_id") % 8), "link_generation": F.lit(1).cast("long"),
        "source_id": F.concat(F.lit("src-"), F.col("user_id") % 3), "source_incarnation": F.lit(1).cast("long"), "sequence": F.col("event_id"),
        "family": _of_metric(0), "name": _of_metric(1), "lane": null("int"), "unit": _of_metric(2), "semantics": _of_metric(3),
        "gauge_value": null("double"), "gauge_validity_ns": F.lit(0).cast("long"), "counter_value": null("decimal(20,0)"),
        "counter_width": null("string"), "reset_declared": F.lit(False), "observed_ns": ns, "observed_synchronized": F.lit(True),
        "interval_ns": null("long"), "authority": F.lit(1).cast("long"), "transport": F.lit("ethernet"), "evidence_class": F.lit("real"),
        "prov_origin": F.lit("events"), "producer": F.lit("adapter"), "received_wall_ns": ns, "received_steady_ns": ns,
        "received_epoch": F.lit(EPOCH).cast("long"), "origin": F.lit("live"),
    } | columns
    return rows.select(*(all_[c].alias(c) for c in COLUMNS))


def gauge(column: str = "value") -> Column:
    return F.when(F.col("event_type") == "click", -F.col(column) / 10).otherwise(F.col(column))


def gauges(events: DataFrame, lanes: int = 0, authorities: int = 1, links: int | None = 8) -> DataFrame:
    """Gauge readings of all events but errors; optionally on lanes, with authorities above 1, on a link per user."""
    number = F.col("user_id") if links is None else F.col("user_id") % links
    extra = {"link_id": F.concat(F.lit("link-"), number), "gauge_value": gauge(), "authority": (1 + F.col("user_id") % authorities).cast("long")}
    if lanes:
        extra["lane"] = (F.col("user_id") % lanes).cast("int")
    return _observations(events.where("event_type <> 'error'"), **extra)


def counter_rows(events: DataFrame) -> DataFrame:
    """Events with the reading of a 32-bit counter per link, source and type: seq, cv and rst."""
    rows = events.withColumns({"link_no": F.col("user_id") % 8, "src_no": F.col("user_id") % 3})
    order = Window.partitionBy("link_no", "src_no", "event_type").orderBy("event_id")
    total = F.sum(F.floor("value").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"seq": F.row_number().over(order).cast("long"), "raw": (4294000000 + 1000 * total) % 4294967296})
    cv = F.when(F.col("seq") % 19 == 0, F.floor(F.col("raw") / 2).cast("long")).otherwise(F.col("raw"))
    return rows.withColumns({"cv": cv, "rst": F.col("seq") % 29 == 0}).drop("raw")


_COUNTER_METRICS = {"click": "errors.symbol", "view": "errors.frame", "signup": "errors.corrected", "purchase": "errors.uncorrectable", "error": "octets"}


def _as_counters(rows: DataFrame, ordinal: Column, value: str) -> DataFrame:
    name = F.lit(None)
    for kind, metric in _COUNTER_METRICS.items():
        name = F.when(F.col("event_type") == kind, metric).otherwise(name)
    octets = F.col("event_type") == "error"
    return _observations(
        rows, ordinal=ordinal, sequence=F.col("seq"), family=F.when(octets, "throughput").otherwise("error-counter"), name=name,
        unit=F.when(octets, "bytes").otherwise("count"), semantics=F.lit("counter"), counter_value=F.col(value).cast("decimal(20,0)"),
        counter_width=F.lit("u32"), reset_declared=F.col("rst"),
    )


def counter_readings(events: DataFrame) -> DataFrame:
    """Counter readings that wrap, drop without proof, and declare resets; in order."""
    return _as_counters(counter_rows(events), F.col("event_id"), "cv")


def dirty_arrivals(events: DataFrame) -> DataFrame:
    """The counter readings as they might come: late, twice, and tampered with."""
    rows = counter_rows(events)
    late = F.when(F.col("seq") % 17 == 0, 30001).when(F.col("seq") % 7 == 0, 6003).otherwise(0)
    rows = rows.withColumns({"ord": F.col("event_id") * 10 + late, "again": F.col("cv")})
    twice = rows.where("seq % 11 = 0").withColumn("ord", F.col("ord") + 35)
    false = rows.where("seq % 13 = 0").withColumns({"ord": F.col("ord") + 47, "again": F.col("cv") + 1})
    return _as_counters(rows.union(twice).union(false), F.col("ord"), "again")


def generated(spark: SparkSession, n: int, link: str = "link-a", source: str = "src-a", start_ns: int = 1_700_000_000 * SECOND) -> DataFrame:
    """``n`` readings a second apart that run through five fixed levels."""
    # fixed values: the five levels
    levels = F.array(*(F.lit(x) for x in (-6.0, -6.75, -7.5, -8.25, -9.0)))
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.lit("click").alias("event_type"), F.lit(0).cast("long").alias("user_id"), F.lit(0).cast("timestamp").alias("ts"))
    at = F.lit(start_ns) + F.col("event_id") * SECOND
    return _observations(
        rows, link_id=F.lit(link), source_id=F.lit(source), sequence=F.col("event_id") + 1, gauge_value=F.get(levels, (F.col("event_id") % 5).cast("int")),
        observed_ns=at, received_wall_ns=at, received_steady_ns=at, evidence_class=F.lit("synthetic"),
    )
