"""Versioned policies: freshness, severity and threshold bands, checked as documents and used as small tables."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..functions.frames import local_frame
from ..functions.text import number
from ..functions.vocabulary import BASES, FAMILIES, SECOND, STATES
from .catalog import Catalog, Refused, check_metric_id

INF = math.inf


@dataclass(frozen=True)
class Band:
    id: str
    lower: float
    upper: float | None
    state: str


@dataclass(frozen=True)
class Rule:
    family: str
    name: str
    bands: tuple[Band, ...]
    basis: str = "gauge-value"
    tolerance: float = 0.0
    validity_ns: int = 0
    gap_ns: int = 0
    wrap: bool = False
    ceiling: float = 0.75
    floor: float = 0.25

    @property
    def id(self) -> tuple[str, str]:
        return self.family, self.name


def bands(prefix: str, cuts: tuple[float, ...], states: tuple[str, ...]) -> tuple[Band, ...]:
    """Contiguous half-open bands over the whole line, one more than there are cuts."""
    edges = (-INF, *cuts, None)
    return tuple(Band(f"{prefix}-{s}", edges[i], edges[i + 1], s) for i, s in enumerate(states))


_FALLING = ("severe", "degraded", "marginal", "healthy")
_RISING = _FALLING[::-1]
_RATE = BASES[1]

# Cut points of the default rules.
DEFAULT_RULES = (
    Rule("signal-power", "rx.level", bands("rx-level", (-14.0, -11.0, -7.0), _FALLING), tolerance=0.5),
    Rule("signal-ratio", "snr", bands("snr", (12.0, 16.0, 22.0), _FALLING), tolerance=0.5),
    Rule("signal-ratio", "margin", bands("margin", (0.0, 2.0, 4.0), _FALLING), tolerance=0.25),
    Rule("error-counter", "errors.uncorrectable", bands("uncorrectable", (0.001, 0.1, 10.0), _RISING), _RATE),
    Rule("error-counter", "errors.corrected", bands("corrected", (1.0, 100.0, 10000.0), _RISING), _RATE),
    Rule("error-counter", "errors.frame", bands("frame-errors", (0.1, 10.0, 1000.0), _RISING), _RATE),
    Rule("error-counter", "errors.symbol", bands("symbol-errors", (1.0, 100.0, 100000.0), _RISING), _RATE),
    Rule("loss-ratio", "loss.ratio", bands("loss", (1.0, 100.0, 1000.0), _RISING), tolerance=0.5),
)


@dataclass(frozen=True)
class Policy:
    id: str = "default"
    rules: tuple[Rule, ...] = DEFAULT_RULES
    validity_ns: int = 15 * SECOND
    family_validity_ns: tuple[tuple[str, int], ...] = (("environmental", 60 * SECOND), ("bias", 60 * SECOND), ("timing", 5 * SECOND))
    gap_ns: int = 60 * SECOND
    min_rate_ns: int = 1_000_000
    severity: tuple[str, ...] = STATES
    conflicting_dominates: bool = True
    require_capability: bool = True
    unsupported: tuple[tuple[str, str], ...] = ()
    generation: int = 1

    def with_rules(self, **changes) -> Policy:
        """Every rule with the given fields replaced."""
        return replace(self, rules=tuple(replace(r, **changes) for r in self.rules))

    @property
    def content_hash(self) -> str:
        return hashlib.sha256(canonical_text(self).encode()).hexdigest()

    def family_validity(self, family: str) -> int:
        return dict(self.family_validity_ns).get(family, self.validity_ns)

    def rule_frame(self, spark: SparkSession) -> DataFrame:
        """One row per rule, with wrap boundaries as exact integers per width."""
        edge = lambda top, part: int(Decimal(top) * Decimal(str(part)))
        rows = [
            (r.family, r.name, r.basis, float(r.tolerance), r.validity_ns, r.gap_ns or self.gap_ns, r.wrap)
            + tuple(Decimal(edge(top, part)) for top in (2**32, 2**64 - 1) for part in (r.ceiling, r.floor))
            for r in self.rules
        ]
        d = "decimal(20,0)"
        return local_frame(
            spark,
            rows,
            "family string, name string, basis string, tolerance double, rule_validity_ns long, rule_gap_ns long, wrap boolean, "
            f"ceiling_32 {d}, floor_32 {d}, ceiling_64 {d}, floor_64 {d}",
        )

    def band_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.family, r.name, b.id, b.lower, b.upper, b.state) for r in self.rules for b in r.bands]
        return local_frame(spark, rows, "family string, name string, band_id string, lower double, upper double, band_state string")

    def freshness_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, self.family_validity(f)) for f in FAMILIES]
        return local_frame(spark, rows, "family string, family_validity_ns long")


DEFAULT = Policy()


def canonical_text(p: Policy) -> str:
    """The text that a policy's hash is of: every field in a fixed order."""
    yes = lambda x: "true" if x else "false"
    order = lambda m: (FAMILIES.index(m[0]), m[1])
    lines = [
        f"policy {p.id}",
        f"require-capability {yes(p.require_capability)}",
        f"freshness default-validity-ns {p.validity_ns} continuity-gap-ns {p.gap_ns} min-rate-interval-ns {p.min_rate_ns}",
    ]
    lines += [f"freshness-family {f} {ns}" for f, ns in sorted(p.family_validity_ns, key=lambda x: FAMILIES.index(x[0]))]
    lines += [f"severity {s} {p.severity.index(s)}" for s in STATES]
    lines.append(f"conflicting-dominates {yes(p.conflicting_dominates)}")
    for r in sorted(p.rules, key=lambda r: order(r.id)):
        parts = ("rule", ":".join(r.id), r.basis, "tolerance", number(r.tolerance), "validity-ns", r.validity_ns, "gap-ns", r.gap_ns)
        lines.append(" ".join(map(str, (*parts, "wrap-inference", yes(r.wrap), "wrap-ceiling", number(r.ceiling), "wrap-floor", number(r.floor)))))
        lines += [f"  band {b.id} {number(b.lower)} {'+inf-bound' if b.upper is None else number(b.upper)} {b.state}" for b in r.bands]
    lines += [f"unsupported {':'.join(m)}" for m in sorted(p.unsupported, key=order)]
    return "\n".join(lines) + "\n"


def _refuse(when: bool, message: str, code: str = "invalid") -> None:
    if when:
        raise Refused(code, message)


def check_bands(rule: Rule, most: int = 16) -> None:
    """Bands must be named once each and cover the line without gap or overlap."""
    _refuse(not rule.bands, f"no bands: {rule.name}")
    _refuse(len(rule.bands) > most, f"too many bands: {rule.name}", "limit-exceeded")
    ids = [b.id for b in rule.bands]
    _refuse(not all(ids) or len(set(ids)) < len(ids), f"band ids must be distinct: {rule.name}")
    _refuse(any(b.state not in STATES for b in rule.bands), f"no such state: {rule.name}")
    uppers = [INF if b.upper is None else b.upper for b in rule.bands]
    _refuse(any(math.isnan(x) for b, u in zip(rule.bands, uppers, strict=True) for x in (b.lower, u)), f"a bound is NaN: {rule.name}")
    _refuse(any(not u > b.lower for b, u in zip(rule.bands, uppers, strict=True)), f"a band is empty: {rule.name}")
    _refuse([b.lower for b in rule.bands] != [-INF, *uppers[:-1]], f"bands leave values out or twice: {rule.name}")
    _refuse(any(b.upper is None for b in rule.bands[:-1]) or rule.bands[-1].upper is not None, f"only the last band is open: {rule.name}")


def check_policy(p: Policy, catalog: Catalog, most_rules: int = 128, most_bands: int = 16) -> Policy:
    """``p``, or a typed refusal."""
    _refuse(not (0 < len(p.id) <= 128 and all("!" <= c <= "~" for c in p.id)), "policy id")
    _refuse(len(p.rules) > most_rules, "too many rules", "limit-exceeded")
    seen = set()
    for r in p.rules:
        check_metric_id(*r.id)
        _refuse(r.id in seen, f"two rules for {r.name}")
        seen.add(r.id)
        metric = catalog.metrics.get(r.id)
        _refuse(metric is None, f"not in the catalog: {r.name}", "unsupported")
        _refuse(r.basis not in BASES or (metric.semantics == "gauge") != (r.basis == BASES[0]), f"basis of {r.name}")
        _refuse(not (0 <= r.tolerance < INF), f"tolerance of {r.name}")
        _refuse(r.validity_ns < 0 or r.gap_ns < 0, f"a negative window: {r.name}")
        _refuse(not (0 <= r.floor < r.ceiling <= 1), f"wrap fractions of {r.name}")
        check_bands(r, most_bands)
    for m in p.unsupported:
        check_metric_id(*m)
    _refuse(len(set(p.unsupported)) < len(p.unsupported), "a metric is unsupported twice")
    _refuse(bool(seen & set(p.unsupported)), "a metric is ruled and unsupported", "conflict")
    _refuse(p.validity_ns <= 0 or p.gap_ns <= 0 or p.min_rate_ns < 0, "freshness windows")
    _refuse(any(f not in FAMILIES or ns <= 0 for f, ns in p.family_validity_ns), "a family's freshness window")
    _refuse(sorted(p.severity) != sorted(STATES), "severity must rank every state once")
    return p


@dataclass(frozen=True)
class History:
    """Published policy generations; the oldest are forgotten beyond ``keep``."""

    kept: tuple[Policy, ...] = ()
    keep: int = 8
    catalog: Catalog = field(default_factory=Catalog)

    def publish(self, p: Policy) -> History:
        check_policy(p, self.catalog)
        nxt = self.kept[-1].generation + 1 if self.kept else 1
        return replace(self, kept=(*self.kept, replace(p, generation=nxt))[-self.keep :])

    @property
    def current(self) -> Policy:
        return self.kept[-1]
