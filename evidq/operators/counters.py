"""Counter continuity: what lies between two readings of a counter, and when a rate may be derived from it."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocabulary import EVENT_REASONS, SECOND, STREAM

_BIG = "decimal(38,0)"
LIMIT = 2**63 - 1


def with_rules(rows: DataFrame, policy) -> DataFrame:
    """Per row the continuity settings of its metric: gap_ns, wrap and the wrap boundaries of both widths."""
    rules = policy.rule_frame(rows.sparkSession).select(
        "family", "name", F.col("rule_gap_ns").alias("gap_ns"), "wrap", "ceiling_32", "floor_32", "ceiling_64", "floor_64"
    )
    joined = rows.join(F.broadcast(rules), ["family", "name"], "left")
    return joined.withColumns({"gap_ns": F.coalesce("gap_ns", F.lit(policy.gap_ns)), "wrap": F.coalesce("wrap", F.lit(False))})


def wrap_delta(previous: Column, value: Column, width: Column) -> Column:
    """The delta of a decrease that passes as a wrap, or null. Boundaries are exact integers, one pair per width."""
    a, b = previous.cast(_BIG), value.cast(_BIG)
    narrow, wide = width == "u32", width == "u64"
    inside = (narrow & (a >= F.col("ceiling_32")) & (b <= F.col("floor_32"))) | (wide & (a >= F.col("ceiling_64")) & (b <= F.col("floor_64")))
    span = F.when(narrow, F.lit(Decimal(2**32))).otherwise(F.lit(Decimal(2**64)))
    return F.when(F.col("wrap") & inside, (span.cast(_BIG) - a + b).cast("decimal(20,0)"))


def rate_per_second(min_interval_ns: int = 1_000_000) -> Column:
    """Delta over elapsed seconds; null if too little time passed."""
    fits = (F.col("elapsed_ns") > 0) & (F.col("elapsed_ns") >= min_interval_ns)
    return F.when(fits, F.col("delta").cast("double") / (F.col("elapsed_ns") / F.lit(float(SECOND))))


def steps(fed: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``fed`` with event, reason, delta, elapsed_ns, spans_gap, from_wrap, rate_admissible and missing.

    For readings that passed admission and the fence: in range, with rising sequences within a stream, whose key has the
    incarnation and generation. Every step then rebases, so the previous row is all that a step needs. Settings come
    from ``with_rules``.
    """
    key = key or STREAM
    arrival = Window.partitionBy(*key).orderBy("ordinal")
    rows = fed.withColumn("_width", F.coalesce("counter_width", F.lit("unspecified")))
    rows = rows.withColumns(
        {f"_p_{c}": F.lag(c).over(arrival) for c in ("counter_value", "_width", "observed_ns", "sequence")}
    )
    value, before = F.col("counter_value"), F.col("_p_counter_value")
    wrapped = wrap_delta(before, value, F.col("_width"))
    event = (
        F.when(F.col("_p__width") != F.col("_width"), "width-changed")
        .when(F.coalesce("reset_declared", F.lit(False)), "reset")
        .when(before.isNull(), "baseline")
        .when(value >= before, "advance")
        .when(wrapped.isNotNull(), "wrap")
        .otherwise("decrease-unproven")
    )
    rows = rows.withColumn("event", event)
    moved, met = F.col("event").isin("advance", "wrap"), F.col("event").isin("advance", "wrap", "decrease-unproven")
    elapsed = F.greatest(F.coalesce(F.try_subtract("observed_ns", "_p_observed_ns"), F.lit(LIMIT)), F.lit(0))
    rows = rows.withColumns(
        {
            "delta": F.when(F.col("event") == "advance", (value - before).cast("decimal(20,0)")).when(F.col("event") == "wrap", wrapped),
            "elapsed_ns": F.when(moved, elapsed),
            "missing": F.when(met, F.greatest(F.col("sequence") - F.col("_p_sequence") - 1, F.lit(0))).otherwise(F.lit(0)).cast("long"),
        }
    )
    gap = F.when(moved, (F.col("elapsed_ns") > F.col("gap_ns")) | (F.col("elapsed_ns") <= 0))
    reason = F.create_map(*(F.lit(x) for pair in EVENT_REASONS.items() for x in pair))
    rows = rows.withColumns({"spans_gap": gap, "from_wrap": F.when(moved, F.col("event") == "wrap"), "reason": F.try_element_at(reason, F.col("event"))})
    rows = rows.withColumn("rate_admissible", moved & ~F.coalesce("spans_gap", F.lit(True)))
    return rows.drop("_width", "_p_counter_value", "_p__width", "_p_observed_ns", "_p_sequence")


def statistics(stepped: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Per stream: samples, how often each event came, gaps and missing samples.

    The last four events come from ``machine_steps`` only, whose key leaves out incarnation and generation.
    """
    key = key or STREAM
    n = lambda e: F.count_if(F.col("event") == e)
    return stepped.groupBy(*key).agg(
        F.count("*").alias("samples"), n("advance").alias("advances"), n("wrap").alias("wraps"), n("reset").alias("resets"),
        n("decrease-unproven").alias("unproven"), n("width-changed").alias("width_changes"),
        n("source-reincarnated").alias("reincarnations"), n("link-generation-changed").alias("generation_changes"), n("out-of-range").alias("out_of_range"),
        n("sequence-regressed").alias("regressions"),
        F.count_if(F.coalesce("spans_gap", F.lit(False))).alias("gaps"), F.sum("missing").alias("missing"),
    )


class Continuity:
    """The whole machine, for readings in any order and range: one stream, one reading at a time."""

    FIELDS = ("value", "width", "observed_ns", "sequence", "incarnation", "generation")

    def __init__(self, state: tuple | None = None):
        #: The last reading taken over, by FIELDS, and whether its value still is a baseline.
        self.last, self.based = state or (None, False)

    def step(self, reading: dict, gap_ns: int, wrap: bool, edges: dict[str, tuple[int, int]]) -> dict:
        """event, delta, elapsed_ns, spans_gap, from_wrap, rate_admissible and missing for the next reading."""
        out = {"event": "", "delta": None, "elapsed_ns": None, "spans_gap": None, "from_wrap": None, "rate_admissible": False, "missing": 0}
        last = dict(zip(self.FIELDS, self.last, strict=True)) if self.last else None
        out["event"] = event = self._event(last, reading, wrap, edges)
        if event in ("advance", "wrap", "decrease-unproven"):
            out["missing"] = max(0, reading["sequence"] - last["sequence"] - 1)
        if event in ("advance", "wrap"):
            span = {"u32": 2**32}.get(reading["width"], 2**64) if event == "wrap" else 0
            elapsed = min(max(reading["observed_ns"] - last["observed_ns"], 0), LIMIT)
            gap = elapsed > gap_ns or elapsed <= 0
            out |= {"delta": span + reading["value"] - last["value"], "elapsed_ns": elapsed, "spans_gap": gap, "from_wrap": event == "wrap"}
            out["rate_admissible"] = not gap
        if event == "out-of-range":
            self.based = False
        elif event != "sequence-regressed":
            self.last, self.based = tuple(reading[f] for f in self.FIELDS), True
        return out

    def _event(self, last: dict | None, r: dict, wrap: bool, edges: dict) -> str:
        if last and r["incarnation"] != last["incarnation"]:
            return "source-reincarnated"
        if last and r["generation"] != last["generation"]:
            return "link-generation-changed"
        if r["width"] == "u32" and r["value"] >= 2**32:
            return "out-of-range"
        if self.based and r["width"] != last["width"]:
            return "width-changed"
        if self.based and r["sequence"] < last["sequence"]:
            return "sequence-regressed"
        if r["reset"]:
            return "reset"
        if not self.based:
            return "baseline"
        if r["value"] >= last["value"]:
            return "advance"
        high, low = edges.get(r["width"], (None, None))
        return "wrap" if wrap and high is not None and last["value"] >= high and r["value"] <= low else "decrease-unproven"


STEP = "event string, reason string, delta decimal(20,0), elapsed_ns long, spans_gap boolean, from_wrap boolean, rate_admissible boolean, missing long"


def reading_of(row) -> dict:
    """What ``Continuity.step`` takes, from a row of readings."""
    return {
        "value": int(row.counter_value), "width": row.counter_width or "unspecified", "observed_ns": int(row.observed_ns),
        "sequence": int(row.sequence), "incarnation": int(row.source_incarnation), "generation": int(row.link_generation),
        "reset": bool(row.reset_declared),
    }


def settings_of(row) -> tuple[int, bool, dict]:
    edge = lambda w: (int(getattr(row, f"ceiling_{w}")), int(getattr(row, f"floor_{w}")))
    return int(row.gap_ns), bool(row.wrap), {"u32": edge(32), "u64": edge(64)} if row.wrap else {}


def machine_steps(readings: DataFrame, key: list[str]) -> DataFrame:
    """``steps`` by the whole machine, for raw readings; ``key`` may leave out incarnation and generation.

    The streams are spread over the cluster, each is read in order of ``ordinal`` and only one state is held at a time.
    """
    kept = readings.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, machine = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = tuple(None if pd.isna(x) else x for x in (getattr(row, c) for c in key))
                if own != held:
                    held, machine = own, Continuity()
                out.append(machine.step(reading_of(row), *settings_of(row)))
            new = pd.DataFrame(out, columns=["event", "delta", "elapsed_ns", "spans_gap", "from_wrap", "rate_admissible", "missing"])
            new["delta"] = [None if x is None else Decimal(x) for x in new["delta"]]
            new["elapsed_ns"] = new["elapsed_ns"].astype("Int64")
            new["reason"] = new["event"].map(EVENT_REASONS)
            yield pd.concat([batch.reset_index(drop=True), new], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in readings.schema)
    ordered = readings.repartition(*key).sortWithinPartitions(*key, "ordinal")
    return ordered.mapInPandas(run, f"{fields}, {STEP}").select(*kept, *(c.split()[0] for c in STEP.split(", ")))
