"""Fixed names and orders of the data model, and expressions that rank them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
FAMILIES = (
    "unspecified", "signal-power", "signal-ratio", "error-counter", "loss-ratio", "timing", "throughput",
    "environmental", "bias", "link-state-hint",
)
SEMANTICS = ("gauge", "counter")
WIDTHS = ("unspecified", "u32", "u64")
BASES = ("gauge-value", "counter-rate-per-second", "counter-delta")
TRANSPORTS = ("unspecified", "ethernet", "optical", "electrical", "internal-fabric", "synthetic", "other")
EVIDENCE_CLASSES = ("real", "synthetic", "simulated")
ORIGINS = ("live", "recovered")
STATES = ("unknown", "unsupported", "healthy", "incomplete", "stale", "marginal", "degraded", "severe", "conflicting")
CONFIDENCES = ("none", "low", "medium", "high")
EVENTS = (
    "baseline", "advance", "wrap", "reset", "decrease-unproven", "width-changed", "source-reincarnated",
    "link-generation-changed", "out-of-range", "sequence-regressed",
)
#: The reason that a counter event gives; advances and wraps give none but the wrap's own.
EVENT_REASONS = {
    "baseline": "counter-baseline-only", "advance": "none", "wrap": "counter-wrap-inferred", "reset": "counter-reset",
    "decrease-unproven": "counter-decrease-ambiguous", "width-changed": "counter-width-changed",
    "source-reincarnated": "counter-source-reincarnated", "link-generation-changed": "counter-link-generation-changed",
    "out-of-range": "counter-out-of-range", "sequence-regressed": "counter-sequence-regressed",
}
STATUS_CODES = (
    "ok", "invalid", "not-found", "unsupported", "conflict", "stale", "fenced", "rejected", "duplicate", "id-mismatch",
    "overflow", "limit-exceeded", "corrupt", "unavailable", "busy", "cancelled", "refused", "protocol", "io", "internal",
)
UNIT_CLASSES = {
    "none": "dimensionless", "dBm": "power", "dB": "ratio", "mV": "power", "mA": "current", "uA": "current",
    "ps": "time", "ns": "time", "ms": "time", "s": "time", "count": "count", "ppm": "ratio", "percent": "ratio",
    "ratio": "ratio", "bit/s": "rate", "bytes": "count", "mC": "temperature",
}

STREAM = ["link_id", "link_generation", "family", "name", "lane", "source_id", "source_incarnation"]
SECOND = 1_000_000_000


def rank(column: str | Column, names: tuple[str, ...]) -> Column:
    """Position of a name in a fixed order; null for any other."""
    at = F.array_position(F.array(*(F.lit(x) for x in names)), F.col(column) if isinstance(column, str) else column)
    return F.when(at > 0, (at - 1).cast("int"))


def name_of(position: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*(F.lit(x) for x in names)), position)


def unit_class(column: str) -> Column:
    """The class of a unit; ``dimensionless`` for unknown ones."""
    out = F.lit("dimensionless")
    for unit, kind in UNIT_CLASSES.items():
        out = F.when(F.col(column) == unit, kind).otherwise(out)
    return out


def units_compatible(a: str, b: str) -> Column:
    """Same class, and neither is ``none``; nothing is ever converted."""
    return (F.col(a) != "none") & (F.col(b) != "none") & (unit_class(a) == unit_class(b))
