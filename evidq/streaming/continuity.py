"""The replay fence and counter continuity over a stream of arrivals, with state per stream of readings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.vocabulary import EVENT_REASONS, STREAM
from ..operators import counters, fence

KEY = [c for c in STREAM if c != "lane"]
OUT = "ordinal long, link_id string, link_generation long, family string, name string, lane int, source_id string, source_incarnation long, sequence long, fence string, " + counters.STEP
#: What a step is made from; nothing else goes into the state's tasks.
USED = [*KEY, "lane", "ordinal", "sequence", "digest", "semantics", "counter_value", "counter_width", "observed_ns", "reset_declared"]
USED += ["gap_ns", "wrap", "ceiling_32", "floor_32", "ceiling_64", "floor_64"]
STATE = "mark long, seen string, based boolean, last string"


class StreamState:
    """What one stream of readings leaves behind: its watermark, the sequences in the window, and continuity."""

    def __init__(self, window: int, mark: int | None = None, seen: dict | None = None, machine: counters.Continuity | None = None):
        self.window, self.mark, self.seen, self.machine = window, mark, seen or {}, machine or counters.Continuity()

    def admit(self, sequence: int, digest: str) -> str:
        behind = 0 if self.mark is None else self.mark - sequence
        known = self.seen.get(sequence)
        if known is not None and behind < self.window:
            return "duplicate" if known == digest else "id-mismatch"
        if behind > self.window:
            return "fenced"
        if known is None:
            self.seen[sequence] = digest
        fresh = self.mark is None or sequence > self.mark
        if fresh:
            self.mark = sequence
            # what is as far behind as the window is wide is forgotten, which bounds the state
            self.seen = {s: d for s, d in self.seen.items() if self.mark - s < self.window}
        return "accepted" if fresh else "reordered"


def _updates(window: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            mark, seen, based, last = state.get
            last = tuple(json.loads(last)) if last else None
            own = StreamState(window, mark, {int(k): v for k, v in json.loads(seen).items()}, counters.Continuity((last, based)))
        else:
            own = StreamState(window)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ordinal", "sequence", "digest"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            status = own.admit(int(row.sequence), row.digest)
            step = {}
            if status == "accepted" and row.semantics == "counter":
                step = own.machine.step(counters.reading_of(row), *counters.settings_of(row))
                step["delta"] = None if step["delta"] is None else Decimal(step["delta"])
                step["reason"] = EVENT_REASONS[step["event"]]
            lane = None if pd.isna(row.lane) else int(row.lane)
            names = ("ordinal", "link_id", "link_generation", "family", "name", "source_id", "source_incarnation", "sequence")
            out.append({n: getattr(row, n) for n in names} | {"lane": lane, "fence": status} | step)
        last = json.dumps(own.machine.last) if own.machine.last else None
        state.update((own.mark, json.dumps(own.seen), own.machine.based, last))
        columns = [c.split()[0] for c in OUT.split(", ")]
        frame = pd.DataFrame(out).reindex(columns=columns)
        for c in ("lane", "elapsed_ns", "missing"):
            frame[c] = frame[c].astype("Int64")
        for c in ("spans_gap", "from_wrap", "rate_admissible"):
            frame[c] = frame[c].astype("boolean")
        yield frame.astype({"event": object, "reason": object})

    return update


def continuity(arrivals: DataFrame, policy, window: int = fence.WINDOW) -> DataFrame:
    """Status and counter step of every arrival; ``arrivals`` is a streaming frame of admitted observations.

    The same results as ``fence.fenced`` and ``counters.steps`` give for the whole of the arrivals at once, provided
    micro-batches come in order of ``ordinal``. State per stream is its last ``window`` sequences and one reading.
    """
    rows = counters.with_rules(arrivals.withColumn("digest", fence.digest()), policy)
    rows = rows.select(*USED, F.coalesce("lane", F.lit(-1)).alias("lane_key"))
    keyed = rows.groupBy(*KEY, "lane_key")
    return keyed.applyInPandasWithState(_updates(window), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
