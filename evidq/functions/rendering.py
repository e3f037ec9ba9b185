"""Reports, policies and declarations as text for people; small rows on the driver only."""

from __future__ import annotations

from collections.abc import Iterable

from ..plans.policy import Policy
from .text import number
from .vocabulary import CONFIDENCES, FAMILIES


def _value(x: float | None) -> str:
    return "-" if x is None else number(x)


def assessment(row) -> str:
    head = f"  {row.family}:{row.name} {row.state} ({CONFIDENCES[row.confidence_rank]})"
    lines = [f"{head} value {_value(row.value)} sources {row.sources_fresh} fresh of {row.sources_with_evidence}, {row.sources_declared} declared"]
    if row.missing_lanes:
        lines.append("    missing lanes " + ", ".join(map(str, row.missing_lanes)))
    for name in ("reasons", "rules"):
        if row[name]:
            lines.append(f"    {name} {', '.join(row[name])}")
    lines += [f"    {e.source_id}@{e.source_incarnation} #{e.sequence} {e.rendered}{'' if e.fresh else ' (not fresh)'}" for e in row.evidence]
    return "\n".join(lines)


def report(rows: Iterable, metrics: Iterable) -> str:
    """Link reports with their metrics, in the order of links and metrics."""
    out = []
    metrics = sorted(metrics, key=lambda m: (m.link_id, m.link_generation, FAMILIES.index(m.family), m.name))
    for r in sorted(rows, key=lambda r: (r.link_id, r.link_generation)):
        out.append(f"link {r.link_id}/gen{r.link_generation} {r.overall} ({r.confidence}) by {r.policy_id} generation {r.policy_generation}")
        out.append(f"  reasons {', '.join(r.reasons) or 'none'}")
        out += [assessment(m) for m in metrics if (m.link_id, m.link_generation) == (r.link_id, r.link_generation)]
    return "\n".join(out)


def policy(p: Policy) -> str:
    lines = [f"policy {p.id} generation {p.generation} {p.content_hash}", f"  validity {p.validity_ns} ns, gap {p.gap_ns} ns, least rate interval {p.min_rate_ns} ns"]
    for r in p.rules:
        lines.append(f"  {r.family}:{r.name} {r.basis} tolerance {number(r.tolerance)}")
        lines += [f"    [{number(b.lower)}, {'inf' if b.upper is None else number(b.upper)}) {b.state} {b.id}" for b in r.bands]
    return "\n".join(lines)


def capability_view(rows: Iterable) -> str:
    """Rows of ``capability.view_summary``."""
    rows = sorted(rows, key=lambda r: (r.link_id, r.link_generation, FAMILIES.index(r.family), r.name))
    return "\n".join(f"{r.link_id}/gen{r.link_generation} {r.family}:{r.name} by {', '.join(r.declared_by) or 'none'}, {r.lanes} lanes" for r in rows)


def _entry(name: str, r) -> str:
    if name == "freshness":
        return f"{r.fresh_sources} fresh of {r.declared_sources} declared, {r.stale_sources} stale, {r.recovered_sources} recovered, newest {r.newest_age_ns} ns"
    if name == "stale":
        return f"{'aggregate' if r.lane is None else f'lane{r.lane}'} {r.source_id}@{r.source_incarnation} {r.age_ns} ns old, {r.reason}"
    return f"spread {number(r.spread)} over {number(r.tolerance)}: {', '.join(r.claimants)}"


def inspection(parts: dict[str, list]) -> str:
    """The lists of an inspection, each entry with its figures, and what was left out."""
    lines = []
    for name, rows in parts.items():
        if name == "left_out":
            lines += [f"links {r.links_inspected}, entries dropped {r.entries_dropped}{', truncated' if r.truncated else ''}" for r in rows]
            continue
        lines.append(f"{name}: {len(rows)}")
        rows = sorted(rows, key=lambda r: (r.link_id, r.link_generation, FAMILIES.index(r.family), r.name))
        lines += [f"  {r.link_id}/gen{r.link_generation} {r.family}:{r.name} {_entry(name, r)}" for r in rows]
    return "\n".join(lines)
