"""The limits document: every bound that ingest, queries and retention keep to, checked as a whole."""

from __future__ import annotations

from dataclasses import dataclass, fields

from ..functions.vocabulary import SECOND
from .catalog import Refused

# The least and the most that each limit may be set to.
RANGES = {
    "links": (1, 2**20),
    "generations_per_link": (1, 64),
    "sources_per_link": (1, 4096),
    "streams_per_link": (1, 2**20),
    "declarations": (1, 2**20),
    "metrics_per_declaration": (1, 4096),
    "policy_rules": (1, 4096),
    "bands_per_rule": (2, 256),
    "policy_generations": (1, 4096),
    "stream_history": (1, 2**20),
    "global_history": (1, 2**24),
    "dedup_window": (1, 2**20),
    "batch": (1, 2**20),
    "evidence_per_metric": (1, 1024),
    "metrics_per_query": (1, 4096),
    "window_records": (1, 2**24),
    "inspection_entries": (1, 2**20),
    "string_bytes": (8, 4096),
}


@dataclass(frozen=True)
class Limits:
    """Defaults of all limits. ``sources_per_link`` is checked and has no effect, as nothing enforces it."""

    links: int = 4096
    generations_per_link: int = 4
    sources_per_link: int = 64
    streams_per_link: int = 1024
    declarations: int = 1024
    metrics_per_declaration: int = 128
    policy_rules: int = 128
    bands_per_rule: int = 16
    policy_generations: int = 8
    stream_history: int = 64
    global_history: int = 65_536
    dedup_window: int = 256
    batch: int = 1024
    evidence_per_metric: int = 8
    metrics_per_query: int = 64
    window_records: int = 4096
    inspection_entries: int = 256
    string_bytes: int = 128
    observation_age_ns: int = 300 * SECOND

    def check(self) -> Limits:
        """The limits themselves, or a refusal that names the first one out of its range."""
        for f in fields(self):
            low, high = RANGES.get(f.name, (0, 2**63 - 1))
            if not low <= getattr(self, f.name) <= high:
                raise Refused("invalid", f"{f.name} must lie between {low} and {high}")
        if self.dedup_window < self.stream_history:
            raise Refused("invalid", "dedup_window must cover stream_history, so that every kept record is known again")
        return self
