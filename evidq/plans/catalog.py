"""The registry of metrics: what may be reported, in which unit, and whether per lane."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import local_frame
from ..functions.vocabulary import FAMILIES, UNIT_CLASSES, rank

NAME = re.compile(r"[a-z0-9_-]+(\.[a-z0-9_-]+)*")


class Refused(ValueError):
    """A typed refusal: ``code`` is one of the status codes."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Metric:
    family: str
    name: str
    unit: str
    semantics: str = "gauge"
    width: str = "unspecified"
    lanes: bool = True

    @property
    def id(self) -> tuple[str, str]:
        return self.family, self.name


# The metrics that every catalog starts with.
BUILT_IN = (
    Metric("signal-power", "rx.level", "dBm"),
    Metric("signal-power", "tx.level", "dBm"),
    Metric("signal-power", "eye.height", "mV"),
    Metric("signal-ratio", "snr", "dB"),
    Metric("signal-ratio", "margin", "dB"),
    Metric("timing", "eye.width", "ps"),
    Metric("timing", "latency.roundtrip", "ns"),
    Metric("timing", "jitter.packet-delay", "ns"),
    Metric("error-counter", "errors.symbol", "count", "counter", "u64"),
    Metric("error-counter", "errors.frame", "count", "counter", "u64"),
    Metric("error-counter", "errors.corrected", "count", "counter", "u64"),
    Metric("error-counter", "errors.uncorrectable", "count", "counter", "u64"),
    Metric("loss-ratio", "loss.ratio", "ppm"),
    Metric("throughput", "octets", "bytes", "counter", "u64"),
    Metric("environmental", "temperature", "mC", lanes=False),
    Metric("bias", "bias.current", "uA", lanes=False),
    Metric("link-state-hint", "transport.hint", "ratio", lanes=False),
)


def check_metric_id(family: str, name: str) -> None:
    if family not in FAMILIES[1:] or len(name) > 96 or not NAME.fullmatch(name):
        raise Refused("invalid", f"not a metric id: {family}:{name}")


class Catalog:
    """An immutable set of metrics; ``with_metric`` adds one."""

    def __init__(self, metrics: tuple[Metric, ...] = BUILT_IN):
        self.metrics = {m.id: m for m in metrics}

    def with_metric(self, metric: Metric) -> Catalog:
        check_metric_id(*metric.id)
        if metric.unit not in UNIT_CLASSES or metric.unit == "none":
            raise Refused("invalid", f"a metric needs a unit: {metric.name}")
        if (metric.semantics == "counter") != (metric.unit in ("count", "bytes")):
            raise Refused("invalid", f"counters, and only they, are in count or bytes: {metric.name}")
        if metric.semantics == "counter" and metric.width == "unspecified":
            raise Refused("invalid", f"a counter needs a width: {metric.name}")
        if (known := self.metrics.get(metric.id)) is not None:
            same = (known.unit, known.semantics) == (metric.unit, metric.semantics)
            raise Refused("duplicate" if same else "conflict", f"already registered: {metric.name}")
        return Catalog((*self.metrics.values(), metric))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(family, name, unit, semantics, width, lanes); a few rows."""
        rows = [(m.family, m.name, m.unit, m.semantics, m.width, m.lanes) for m in self.metrics.values()]
        return local_frame(spark, rows, "family string, name string, unit string, semantics string, width string, lanes boolean")

    def scan(self, spark: SparkSession) -> DataFrame:
        """The metrics in their order: by family as declared, then by name."""
        return self.frame(spark).withColumn("family_rank", rank("family", FAMILIES)).orderBy(F.col("family_rank"), F.col("name"))
