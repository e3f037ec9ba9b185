"""History queries: a half-open time range on either axis, in order of arrival up to a limit, then by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Refused

AXES = {"observation-time": "observed_ns", "receive-time": "received_wall_ns"}


@dataclass(frozen=True)
class WindowQuery:
    axis: str = "observation-time"
    from_ns: int | None = None
    to_ns: int | None = None
    link: tuple[str, int] | None = None
    metric: tuple[str, str] | None = None
    lane: int | None = None
    source_id: str | None = None
    limit: int = 1024
    as_of_ns: int = 0

    def check(self, now_ns: int | None = None, most: int = 4096) -> WindowQuery:
        if not 1 <= self.limit <= most:
            raise Refused("limit-exceeded", "limit")
        if self.axis not in AXES:
            raise Refused("invalid", "axis")
        if self.from_ns is not None and self.to_ns is not None and not self.from_ns < self.to_ns:
            raise Refused("invalid", "an empty range")
        if now_ns is not None and self.as_of_ns > now_ns:
            raise Refused("invalid", "as-of lies in the future")
        return self

    def matches(self) -> Column:
        """Plain comparisons, which reach the scan of a stored log."""
        time, out = F.col(AXES[self.axis]), F.lit(True)
        pairs = list(zip(("link_id", "link_generation"), self.link or (None, None), strict=True))
        pairs += list(zip(("family", "name"), self.metric or (None, None), strict=True))
        for c, v in [*pairs, ("lane", self.lane), ("source_id", self.source_id)]:
            out = out if v is None else out & (F.col(c) == v)
        out = out if self.from_ns is None else out & (time >= self.from_ns)
        return out if self.to_ns is None else out & (time < self.to_ns)


def window(evidence: DataFrame, query: WindowQuery) -> DataFrame:
    """The first ``limit`` matches by arrival, sorted by time and arrival."""
    query.check()
    found = evidence.where(query.matches()).orderBy("ordinal").limit(query.limit)
    return found.orderBy(AXES[query.axis], "ordinal")


def summary(evidence: DataFrame, query: WindowQuery) -> DataFrame:
    """One row: matched, returned, truncated, and the time span available, which no filter but the axis narrows."""
    time = AXES[query.axis]
    n = F.count_if(query.matches())
    out = evidence.agg(n.alias("matched"), F.min(time).alias("earliest_ns"), F.max(time).alias("latest_ns"))
    return out.select(
        "matched", F.least("matched", F.lit(query.limit).cast("long")).alias("returned"), (F.col("matched") > query.limit).alias("truncated"), "earliest_ns", "latest_ns"
    )
