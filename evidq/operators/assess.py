"""Assessment: from the newest readings of each stream to states of lanes, metrics and links, with reasons.

All links are assessed in one pass: streams shrink to one record each, records meet declarations and rules by joins with
small tables, and cells, metrics and links are grouped in turn, each group being bounded by what sources declare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.vocabulary import CONFIDENCES, FAMILIES, STREAM, name_of, rank
from . import counters
from .fence import latest
from .retention import RING, ring

LINK = ["link_id", "link_generation"]
METRIC = [*LINK, "family", "name"]
MAX_REFS = 8
_STEP = {"event": "string", "reason": "string", "delta": "decimal(20,0)", "elapsed_ns": "long", "spans_gap": "boolean", "rate_admissible": "boolean"}


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    met = F.lit(True)
    for k in keys:
        met = met & a[k].eqNullSafe(b[k])
    return met


def _no_step(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in _STEP.items()})


def current_records(evidence: DataFrame, policy) -> DataFrame:
    """The newest fed reading of each stream, with the counter step that led to it."""
    columns = [*evidence.columns, *_STEP]
    fed = evidence.where("fence = 'accepted'")
    stepped = counters.steps(counters.with_rules(fed.where("semantics = 'counter'"), policy)).select(columns)
    return latest(stepped).select(columns).unionByName(latest(_no_step(fed.where("semantics <> 'counter'"))).select(columns))


def received_after(as_of_ns: int, epoch: int) -> Column:
    """Live evidence of this epoch that came after the instant; recovered evidence is never after it."""
    return (F.col("origin") == "live") & (F.col("received_epoch") == epoch) & (F.col("received_steady_ns") > as_of_ns)


def records_as_of(evidence: DataFrame, policy, as_of_ns: int, epoch: int, size: int | None = RING) -> DataFrame:
    """Per stream what was known at an instant.

    The newest fed reading, if it had come by then; else the last arrival of the ring that had, with continuity replayed
    by the whole machine over the ring's readings up to then. A ``size`` of None is a ring without end.
    """
    newest = current_records(evidence, policy)
    after = received_after(as_of_ns, epoch)
    ahead = newest.where(after).select(*STREAM)
    kept = ring(evidence, size)
    rows = kept.join(ahead, _same(kept, ahead, STREAM), "left_semi").where(~after)
    columns = newest.columns
    replayed = counters.machine_steps(counters.with_rules(rows.where("semantics = 'counter'"), policy), STREAM).select(columns)
    back = latest(replayed, order="ordinal").select(columns).unionByName(latest(_no_step(rows.where("semantics <> 'counter'")), order="ordinal").select(columns))
    return newest.where(~after).unionByName(back)


def with_freshness(records: DataFrame, views: DataFrame, policy, as_of_ns: int, epoch: int, as_of_wall_ns: int | None = None) -> DataFrame:
    """Records of declared sources with validity_ns, age_ns, fresh and the candidate value, rate or reason."""
    spark = records.sparkSession
    # of two declarations of one source the one without scope comes first
    declared = views.where("measured").groupBy(*METRIC, "source_id", "source_incarnation")
    declared = declared.agg(F.min_by("validity_ns", "scoped").alias("declared_validity_ns"))
    rules = policy.rule_frame(spark).select("family", "name", "rule_validity_ns")
    rows = records.join(declared, [*METRIC, "source_id", "source_incarnation"])
    rows = rows.join(F.broadcast(rules), ["family", "name"], "left").join(F.broadcast(policy.freshness_frame(spark)), "family", "left")
    wall = as_of_ns if as_of_wall_ns is None else as_of_wall_ns
    live = (F.col("origin") == "live") & (F.col("received_epoch") == epoch)
    age = F.when(live, F.lit(as_of_ns) - F.col("received_steady_ns")).otherwise(F.lit(wall) - F.col("received_wall_ns"))
    rows = rows.withColumns({"validity_ns": effective_validity("declared_validity_ns"), "age_ns": F.greatest(age, F.lit(0))})
    rows = rows.withColumns({"fresh": live & (F.col("validity_ns") > 0) & (F.col("age_ns") <= F.col("validity_ns")), "rate": counters.rate_per_second(policy.min_rate_ns)})
    gauge = F.col("semantics") == "gauge"
    usable = F.col("rate").isNotNull() & F.col("rate_admissible") & F.col("fresh") & (F.col("elapsed_ns") <= F.col("validity_ns"))
    left = ~gauge & F.col("rate").isNotNull() & ~F.coalesce(usable, F.lit(False))
    return rows.withColumns(
        {
            "candidate": F.when(gauge, F.when(F.col("fresh"), F.col("gauge_value"))).when(usable, F.col("rate")),
            "interval_rate": F.when(left, F.col("rate")),
            "note": F.when(left, F.when(F.col("rate_admissible"), "partially-fresh-evidence").otherwise("continuity-gap-exceeded")).when(
                ~gauge & F.col("delta").isNull() & (F.col("reason") != "none"), F.col("reason")
            ),
        }
    )


def effective_validity(declared: str) -> Column:
    """The first positive of the rule's, the declaration's and the family's window."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(positive("rule_validity_ns"), positive(declared), F.col("family_validity_ns"))


def _cells(views: DataFrame, lane: int | None = None) -> DataFrame:
    """What is to be assessed: each declared metric of each link, on its lanes or, without any, as a whole."""
    measured = F.col("measured")
    order = F.struct("source_id", "source_incarnation", F.coalesce("scoped", F.lit(False)))
    out = views.groupBy(*METRIC).agg(
        F.coalesce(F.bool_or(~measured), F.lit(False)).alias("refused"),
        F.count_if(measured).cast("int").alias("sources_declared"),
        F.coalesce(F.max(F.when(measured & F.col("lanes_declared"), F.col("lane_count"))), F.lit(0)).alias("lanes"),
        F.min_by(F.when(measured, F.col("validity_ns")), F.when(measured, order)).alias("first_validity_ns"),
    )
    if lane is not None:
        return out.withColumn("lane", F.lit(lane).cast("int")).withColumn("lanes", F.lit(0))
    each = F.when(F.col("lanes") > 0, F.sequence(F.lit(0), F.col("lanes").cast("int") - 1)).otherwise(F.array(F.lit(None).cast("int")))
    return out.withColumn("lane", F.explode(each))


def _gathered(fresh: DataFrame) -> DataFrame:
    """Per cell: winners of the best authority, spread, counts, notes and evidence in the order of sources."""
    cell = [*METRIC, "lane"]
    best = F.max(F.when(F.col("candidate").isNotNull(), F.col("authority"))).over(Window.partitionBy(*cell))
    rows = fresh.withColumn("_best", best)
    has, win = F.col("candidate").isNotNull(), F.col("candidate").isNotNull() & (F.col("authority") == F.col("_best"))
    value, source = F.when(win, F.col("candidate")), F.struct("source_id", "source_incarnation")
    counter = F.col("semantics") == "counter"
    evidence = F.struct(
        "source_id", "source_incarnation", "sequence", "lane", F.coalesce("candidate", F.when(~counter, F.col("gauge_value"))).alias("value"),
        "authority", "origin", "fresh", "age_ns", F.coalesce(F.when(F.col("prov_origin") != "", F.col("prov_origin")), F.col("producer")).alias("provenance"),
        text.reading().alias("rendered"),
    )
    return rows.groupBy(*cell).agg(
        F.count("*").cast("int").alias("with_evidence"),
        F.count_if("fresh").cast("int").alias("sources_fresh"),
        F.min(F.when(F.col("fresh"), F.col("age_ns"))).alias("newest_age_ns"),
        F.count_if(F.col("origin") == "live").alias("live"),
        F.count_if(has).alias("candidates"),
        F.count_if(win).cast("int").alias("winners"),
        F.count_if(has & ~win).alias("outranked"),
        F.count_distinct(F.when(win, source)).alias("distinct_winners"),
        (F.max(value) - F.min(value)).alias("spread"),
        F.min_by(value, F.when(win, F.struct("source_id", "source_incarnation", "sequence"))).alias("value"),
        F.max_by("interval_rate", F.when(F.col("interval_rate").isNotNull(), source)).alias("interval_rate"),
        F.max_by("reason", F.when(counter, source)).alias("counter_reason"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("source_id", "source_incarnation", "note")))), lambda x: x["note"]).alias("notes"),
        F.slice(F.array_sort(F.collect_list(evidence)), 1, MAX_REFS).alias("evidence"),
    )


def assess_lanes(records: DataFrame, views: DataFrame, policy, as_of_ns: int, epoch: int, as_of_wall_ns: int | None = None, lane: int | None = None) -> DataFrame:
    """One assessment per link, metric and lane (null: the metric as a whole)."""
    spark = records.sparkSession
    gathered = _gathered(with_freshness(records, views, policy, as_of_ns, epoch, as_of_wall_ns))
    cells = _cells(views, lane)
    met = _same(cells, gathered, [*METRIC, "lane"])
    rows = cells.join(gathered.select(*gathered.columns), met, "left").select(*(cells[c] for c in cells.columns), *(gathered[c] for c in gathered.columns if c not in (*METRIC, "lane")))
    rules = policy.rule_frame(spark).select("family", "name", "basis", "tolerance", "rule_validity_ns", F.lit(True).alias("ruled"))
    rows = rows.join(F.broadcast(rules), ["family", "name"], "left").join(F.broadcast(policy.freshness_frame(spark)), "family", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    clash = (n("winners") >= 2) & ~(F.col("spread") <= F.coalesce("tolerance", F.lit(0.0)))
    ladder = [
        (F.col("sources_declared") == 0, "unsupported"),
        (n("with_evidence") == 0, "unknown"),
        ((n("candidates") == 0) & (n("sources_fresh") == 0), "stale"),
        (n("candidates") == 0, "incomplete"),
        (clash, "conflicting"),
        (F.col("ruled").isNull(), "unknown"),
    ]
    step = F.lit(len(ladder))
    for i, (met, _) in reversed(list(enumerate(ladder))):
        step = F.when(met, i).otherwise(step)
    rows = rows.withColumn("_step", step).withColumn("asserted", F.when(F.col("_step") == len(ladder), F.col("value")))
    bands = F.broadcast(policy.band_frame(spark).withColumnsRenamed({"family": "_bf", "name": "_bn"}))
    inside = (F.col("_bf") == F.col("family")) & (F.col("_bn") == F.col("name")) & (F.col("asserted") >= F.col("lower")) & ~F.isnan("asserted")
    rows = rows.join(bands, inside & (F.col("upper").isNull() | (F.col("asserted") < F.col("upper"))), "left")
    state = F.coalesce(F.get(F.array(*(F.lit(s) for _, s in ladder)), F.col("_step")), F.col("band_state"), F.lit("unknown"))
    of = lambda *r: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in r))
    lower = F.when(n("outranked") > 0, "lower-authority-ignored")
    ended = F.when(n("live") == 0, "recovered-evidence-only").otherwise("evidence-expired")
    broken = F.coalesce(F.when(F.col("counter_reason") != "none", F.col("counter_reason")), F.lit("counter-baseline-only"))
    last = [of(F.when(F.col("refused"), "declared-unsupported").otherwise("metric-not-declared")), of("no-evidence"), of(ended), of(broken), of(lower, "equal-authority-disagreement"), of(lower, "no-rule-for-metric")]
    why = F.get(F.array(*last, of(lower, F.when(F.col("band_id").isNotNull(), "band-matched"))), F.col("_step"))
    notes = F.coalesce("notes", F.array().cast("array<string>"))
    validity = effective_validity("first_validity_ns")
    age = F.col("newest_age_ns")
    confidence = (
        F.when(state.isin("unknown", "unsupported"), 0)
        .when(state.isin("stale", "incomplete", "conflicting"), 1)
        .when(n("distinct_winners") >= 2, 3)
        .when(age.isNull() | (validity <= 0) | (2 * age <= validity), 2)
        .otherwise(1)
    )
    reached = F.col("_step") >= 4
    is_rate = (F.col("family") == "error-counter") | (F.col("basis") != "gauge-value")
    return rows.select(
        *METRIC, "lane", "lanes", "sources_declared", n("with_evidence").alias("sources_with_evidence"), n("sources_fresh").alias("sources_fresh"),
        F.when(F.col("_step") == 4, F.col("winners")).otherwise(0).alias("sources_conflicting"),
        state.alias("state"), confidence.alias("confidence_rank"), F.array_distinct(F.array_compact(F.concat(notes, why))).alias("reasons"),
        F.array_compact(F.array("band_id")).alias("rules"), F.col("asserted").alias("value"), F.when(is_rate, F.col("asserted")).alias("rate_per_second"),
        F.col("interval_rate").alias("interval_rate_per_second"),
        F.when(reached, F.when(F.isnan("spread"), float("inf")).otherwise(F.col("spread"))).alias("disagreement"),
        F.coalesce("evidence", F.array().cast(rows.schema["evidence"].dataType)).alias("evidence"), "newest_age_ns",
    )


def one_lane(lanes: DataFrame) -> DataFrame:
    """Assessments of a single lane as they stand, with the columns of ``roll_up_lanes``."""
    return lanes.withColumns({"lanes": F.lit(0), "missing_lanes": F.array().cast("array<int>")}).select(*METRIC, *_ROLLED)


_ROLLED = (
    "lanes", "state", "confidence_rank", "reasons", "rules", "value", "rate_per_second", "interval_rate_per_second", "disagreement", "missing_lanes",
    "sources_declared", "sources_with_evidence", "sources_fresh", "sources_conflicting", "evidence", "newest_age_ns",
)


def roll_up_lanes(lanes: DataFrame, policy) -> DataFrame:
    """One assessment per link and metric: the worst lane speaks, unmeasured lanes make it incomplete at least."""
    severity = rank("state", policy.severity)
    rows = lanes.withColumn("_severity", severity)
    worst = F.max_by(
        F.struct("state", "value", "rate_per_second", "interval_rate_per_second", "rules", "disagreement"), F.struct("_severity", -F.coalesce("lane", F.lit(0)))
    )
    missing = F.col("lane").isNotNull() & F.col("state").isin("unknown", "unsupported")
    in_lanes = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("lane", F.lit(0)).alias("_l"), c))), lambda x: x[c])
    extra = F.array_compact(
        F.array(F.when(F.col("lane").isNotNull() & (F.col("state") == "conflicting"), "equal-authority-disagreement"), F.when(missing, "missing-lanes"))
    )
    rows = rows.withColumn("_reasons", F.concat("reasons", extra))
    out = rows.groupBy(*METRIC).agg(
        F.max("lanes").alias("lanes"), worst.alias("_w"), F.min("confidence_rank").alias("confidence_rank"),
        F.array_distinct(F.flatten(in_lanes("_reasons"))).alias("_all"),
        F.array_sort(F.collect_list(F.when(missing, F.col("lane")))).alias("missing_lanes"),
        F.max("sources_declared").alias("sources_declared"), F.sum("sources_with_evidence").alias("sources_with_evidence"),
        F.sum("sources_fresh").alias("sources_fresh"), F.sum("sources_conflicting").alias("sources_conflicting"),
        F.slice(F.flatten(in_lanes("evidence")), 1, MAX_REFS).alias("evidence"), F.min("newest_age_ns").alias("newest_age_ns"),
    )
    floor = policy.severity.index("incomplete")
    partial = (F.size("missing_lanes") > 0) & (rank(F.col("_w.state"), policy.severity) < floor)
    return out.select(
        *METRIC, "lanes", F.when(partial, "incomplete").otherwise(F.col("_w.state")).alias("state"), "confidence_rank",
        F.when(partial, F.array_union("_all", F.array(F.lit("lane-coverage-partial")))).otherwise(F.col("_all")).alias("reasons"),
        F.col("_w.rules").alias("rules"), F.col("_w.value").alias("value"), F.col("_w.rate_per_second").alias("rate_per_second"),
        F.col("_w.interval_rate_per_second").alias("interval_rate_per_second"),
        # a roll-up of lanes doesn't carry the spread of one of them
        F.when(F.col("lanes") == 0, F.col("_w.disagreement")).alias("disagreement"), "missing_lanes", "sources_declared",
        *(F.col(c).cast("int").alias(c) for c in ("sources_with_evidence", "sources_fresh", "sources_conflicting")), "evidence", "newest_age_ns",
    )


def roll_up_links(metrics: DataFrame, policy, registry: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One report per link: worst state, least confidence, all reasons in the order of metrics, evidence counts.

    With ``links``, each of them gets a report: one without any declared metric is unsupported.
    """
    severity = rank("state", policy.severity)
    ordered = F.array_sort(F.collect_list(F.struct(rank("family", FAMILIES).alias("f"), "name", "reasons")))
    count = lambda f: F.sum(F.size(F.filter("evidence", f)))
    out = metrics.groupBy(*LINK).agg(
        name_of(F.max(severity), policy.severity).alias("_worst"), F.min("confidence_rank").alias("_confidence"),
        F.max(F.col("state") == "conflicting").alias("_clash"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["reasons"]))).alias("_reasons"),
        F.sum(F.size("evidence")).alias("evidence_considered"), count(lambda e: e["fresh"]).alias("evidence_fresh"),
        count(lambda e: e["origin"] == "recovered").alias("evidence_recovered"), (count(lambda e: e["origin"] == "live") > 0).alias("evidence_present"),
    )
    if links is not None:
        empty = {"_worst": "unsupported", "_confidence": 0, "_clash": False, "evidence_considered": 0, "evidence_fresh": 0, "evidence_recovered": 0, "evidence_present": False}
        out = links.select(*LINK).distinct().join(out, LINK, "left").fillna(empty)
        out = out.withColumn("_reasons", F.coalesce("_reasons", F.array(F.lit("no-sources-for-link"))))
    registered, superseded = F.lit(True), F.lit(False)
    if registry is not None:
        known = registry.select(*LINK, "superseded", F.lit(True).alias("_known"))
        out = out.join(known, LINK, "left")
        registered, superseded = F.coalesce("_known", F.lit(False)), F.coalesce("superseded", F.lit(False))
    over = F.col("_clash") & F.lit(policy.conflicting_dominates)
    head = F.array_compact(F.array(F.when(~registered, "link-not-registered"), F.when(superseded, "fenced-generation")))
    tail = F.array_compact(F.array(F.when(over, "equal-authority-disagreement")))
    return out.select(
        *LINK, F.when(over, "conflicting").otherwise(F.col("_worst")).alias("overall"),
        name_of(F.when(over, 1).otherwise(F.col("_confidence")), CONFIDENCES).alias("confidence"),
        F.array_distinct(F.concat(head, "_reasons", tail)).alias("reasons"), registered.alias("link_registered"),
        "evidence_present", "evidence_considered", "evidence_fresh", "evidence_recovered",
    )


def assess(records: DataFrame, views: DataFrame, policy, as_of_ns: int, epoch: int, as_of_wall_ns: int | None = None, lane: int | None = None) -> DataFrame:
    """Assessments per link and metric, or of one lane, of records that ``current_records`` or ``records_as_of`` gave."""
    lanes = assess_lanes(records, views, policy, as_of_ns, epoch, as_of_wall_ns, lane)
    return roll_up_lanes(lanes, policy) if lane is None else one_lane(lanes)


def report(records: DataFrame, views: DataFrame, policy, as_of_ns: int, epoch: int, registry: DataFrame | None = None) -> DataFrame:
    return roll_up_links(assess(records, views, policy, as_of_ns, epoch), policy, registry)
