"""More registered queries with their SQL: admission of counters, requests, views, texts, counters in assessments, streams."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text
from ..functions.frames import local_frame
from ..functions.vocabulary import FAMILIES, STREAM, TRANSPORTS, UNIT_CLASSES, unit_class, units_compatible
from ..operators import admission, assess, counters, inspection, links
from ..sources import adapters
from ..sources.log import shared_folder
from ..streaming import continuity
from . import capability
from .catalog import Catalog
from .suite import (
    QUERIES,  # noqa: F401
    _COUNTERS, _GAUGES, _OBS, _PAST, _STEPS_DIRTY, AS_OF, GAUGES, HOUR, POLICY, WIDE, WRAPS, _assessed, _declared, _events, _fed, _plain, _report_sql, _shown, _views,
    query,
)

_COUNTER_METRIC = """CASE event_type WHEN 'click' THEN 'error-counter:errors.symbol' WHEN 'view' THEN 'error-counter:errors.frame'
 WHEN 'signup' THEN 'error-counter:errors.corrected' WHEN 'purchase' THEN 'error-counter:errors.uncorrectable' ELSE 'throughput:octets' END"""
_COUNTER_NAMES = (*(("error-counter", f"errors.{n}", "count") for n in ("symbol", "frame", "corrected", "uncorrectable")), ("throughput", "octets", "bytes"))


@query(
    """SELECT event_id AS ordinal, CASE WHEN event_id % 12 IN (1, 2, 3, 4, 5, 6, 7, 8, 9) THEN 'invalid' ELSE 'ok' END AS status_code,
  CASE event_id % 12 WHEN 1 THEN 'counter unit' WHEN 2 THEN 'counter range' WHEN 3 THEN 'counter range' WHEN 4 THEN 'counter range' WHEN 5 THEN 'no reading'
    WHEN 6 THEN 'provenance' WHEN 7 THEN 'semantics differ' WHEN 8 THEN 'units differ' WHEN 9 THEN 'lane range' END AS fault FROM events"""
)
def counter_faults(spark, sf_dir):
    """Counter readings with one fault every few rows: unit, range, semantics, provenance and lane."""
    rows, k = adapters.counter_readings(_events(spark, sf_dir)), F.col("ordinal") % 12
    other = F.when(F.col("unit") == "count", "bytes").otherwise("count")
    rows = rows.withColumns(
        {
            "unit": F.when(k.isin(1, 7), "dBm").when(k == 8, other).otherwise(F.col("unit")),
            "counter_value": F.when(k == 2, F.lit(2**32)).when(k == 3, F.lit(-1)).when(k == 4, F.lit(None)).otherwise(F.col("counter_value")).cast("decimal(20,0)"),
            "semantics": F.when(k == 5, F.lit(None)).when(k == 7, "gauge").otherwise(F.col("semantics")),
            "gauge_value": F.when(k == 7, 1.0),
            "prov_origin": F.when(k == 6, "two words").otherwise(F.col("prov_origin")),
            "lane": F.when(k == 9, -1).cast("int"),
        }
    )
    return admission.validate(rows, Catalog().frame(spark)).select("ordinal", "status_code", "fault")


@query(
    """SELECT event_id AS ordinal, CASE WHEN user_id % 3 = 1 AND event_id % 2 = 0 OR user_id % 3 = 2 AND event_id % 2 = 1 THEN 'invalid' ELSE 'ok' END AS status_code,
  CASE WHEN user_id % 3 = 1 AND event_id % 2 = 0 THEN 'width differs from the declared' WHEN user_id % 3 = 2 AND event_id % 2 = 1 THEN 'no width' END AS fault FROM events"""
)
def width_gate(spark, sf_dir):
    """src-0 declares 32 bits, src-1 64 bits, src-2 no width; every other reading says 32 bits, the rest nothing."""
    rows = adapters.counter_readings(_events(spark, sf_dir))
    rows = rows.withColumn("counter_width", F.when(F.col("ordinal") % 2 == 0, "u32").otherwise("unspecified"))
    each = [
        capability.Declaration(f"src-{i}", tuple(capability.Measures(f, n, u, "counter", w) for f, n, u in _COUNTER_NAMES))
        for i, w in enumerate(("u32", "u64", "unspecified"))
    ]
    checked = admission.validate(rows, Catalog().frame(spark))
    return admission.capability_gate(checked, capability.gate(capability.declarations(spark, each), links.registry(rows))).select("ordinal", "status_code", "fault")


@query(
    f"""WITH {_OBS}, {_GAUGES}, firsts AS (SELECT link_id, min(event_id) AS first FROM g GROUP BY 1), ranked AS (SELECT link_id, row_number() OVER (ORDER BY first) AS n FROM firsts)
SELECT event_id AS ordinal, CASE WHEN n > 5 THEN 'limit-exceeded' ELSE 'ok' END AS status_code FROM g JOIN ranked USING (link_id)"""
)
def link_limit(spark, sf_dir):
    rows = adapters.gauges(_events(spark, sf_dir)).withColumn("status_code", F.lit("ok"))
    return admission.limit_firsts(rows, ["link_id"], [], 5).select("ordinal", "status_code")


_METRIC_ROWS = ", ".join(f"({i}, '{m.family}', '{m.name}', '{m.unit}', '{m.semantics}', {str(m.lanes).lower()})" for i, m in enumerate(sorted(Catalog().metrics.values(), key=lambda m: (FAMILIES.index(m.family), m.name))))


@query(f"SELECT * FROM (VALUES {_METRIC_ROWS}) t(position, family, name, unit, semantics, lanes)")
def catalog_scan(spark, sf_dir):
    rows = Catalog().scan(spark).select("family", "name", "unit", "semantics", "lanes")
    return rows.select((F.monotonically_increasing_id()).cast("int").alias("position"), "*")


_UNITS = ", ".join(f"('{u}', '{c}')" for u, c in UNIT_CLASSES.items())


@query(f"WITH u AS (SELECT * FROM (VALUES {_UNITS}) t(unit, class)) SELECT a.unit AS a, b.unit AS b, a.class AS class_a, a.class = b.class AND a.unit <> 'none' AND b.unit <> 'none' AS compatible FROM u a, u b")
def unit_pairs(spark, sf_dir):
    """All pairs of the seventeen units: which may be compared."""
    rows = local_frame(spark, [(a, b) for a in UNIT_CLASSES for b in UNIT_CLASSES], "a string, b string")
    return rows.select("a", "b", unit_class("a").alias("class_a"), units_compatible("a", "b").alias("compatible"))


@query(
    f"""WITH {_OBS}, {_GAUGES}, l AS (SELECT DISTINCT link_id, source_id, metric FROM g)
SELECT *, CASE WHEN metric = 'signal-power:rx.level' THEN {3 * HOUR} WHEN metric = 'signal-ratio:snr' AND source_id = 'src-0' THEN {9 * HOUR}
  WHEN metric = 'loss-ratio:loss.ratio' THEN {HOUR} ELSE {6 * HOUR} END AS validity_ns FROM l"""
)
def effective_validity(spark, sf_dir):
    """The rule's window, else the declaration's, else the family's, else the policy's."""
    rules = tuple(replace(r, validity_ns=3 * HOUR) if r.name == "rx.level" else r for r in POLICY.rules)
    policy = replace(POLICY, rules=rules, family_validity_ns=(("loss-ratio", HOUR),))
    rows = _fed(adapters.gauges(_events(spark, sf_dir)))
    window = {("signal-power", "rx.level"): 9 * HOUR, ("signal-ratio", "snr"): 9 * HOUR}
    each = [
        capability.Declaration(f"src-{i}", tuple(capability.Measures(f, n, u, validity_ns=window.get((f, n), 0) if i == 0 else 0) for f, n, u in GAUGES)) for i in range(3)
    ]
    views = capability.views(capability.declarations(spark, each), links.registry(rows))
    out = assess.with_freshness(assess.current_records(rows, policy), views, policy, AS_OF, adapters.EPOCH)
    return out.select("link_id", "source_id", text.metric_id().alias("metric"), "validity_ns")


@query(
    f"""WITH {_OBS}, {_GAUGES}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link_id, source_id, metric ORDER BY event_id DESC) AS n FROM g) WHERE n = 1)
SELECT link_id, metric, CAST(row_number() OVER (PARTITION BY link_id, metric ORDER BY source_id) - 1 AS INTEGER) AS position, source_id, event_id AS sequence, v AS value,
  greatest({AS_OF} - ns, 0) AS age_ns, ns >= {AS_OF} - {6 * HOUR} AS fresh, 'events' AS provenance FROM latest"""
)
def evidence_refs(spark, sf_dir):
    """What an assessment cites, in the order of sources."""
    out = _assessed(spark, sf_dir, POLICY).select("link_id", text.metric_id().alias("metric"), F.posexplode("evidence").alias("position", "e"))
    return out.select("link_id", "metric", "position", "e.source_id", "e.sequence", "e.value", "e.age_ns", "e.fresh", "e.provenance")


# Counters in assessments: the newest step of each stream gives its rate.
_CLEAN_STEPS = f"""{_COUNTERS}, k AS (SELECT *, {_COUNTER_METRIC} AS metric, 'link-' || link_no AS link_id, 'src-' || src_no AS source_id FROM counts), lagged AS (
  SELECT *, lag(cv) OVER w AS pv, lag(ns) OVER w AS pns, row_number() OVER (PARTITION BY link_id, source_id, metric ORDER BY event_id DESC) AS nth FROM k
  WINDOW w AS (PARTITION BY link_id, source_id, metric ORDER BY event_id)
), last AS (
  SELECT *, CASE WHEN rst THEN 'reset' WHEN pv IS NULL THEN 'baseline' WHEN cv >= pv THEN 'advance'
      WHEN pv >= 3221225472 AND cv <= 1073741824 AND metric <> 'throughput:octets' THEN 'wrap' ELSE 'decrease-unproven' END AS event FROM lagged WHERE nth = 1
), rated AS (
  SELECT *, CASE event WHEN 'advance' THEN cv - pv WHEN 'wrap' THEN 4294967296 - pv + cv END AS delta,
    CASE WHEN event IN ('advance', 'wrap') THEN greatest(ns - pns, 0) END AS elapsed FROM last
), judged AS (
  SELECT *, CASE WHEN elapsed >= 1000000 THEN CAST(delta AS DOUBLE) / (elapsed / 1e9) END AS rate, elapsed > 0 AND elapsed <= {12 * HOUR} AS admissible FROM rated
)"""
_RATE_BANDS = """rb AS (
  SELECT * FROM (VALUES ('error-counter:errors.uncorrectable', 0.001, 0.1, 10.0), ('error-counter:errors.corrected', 1.0, 100.0, 10000.0),
    ('error-counter:errors.frame', 0.1, 10.0, 1000.0), ('error-counter:errors.symbol', 1.0, 100.0, 100000.0)) t(metric, a, b, c)
)"""


@query(
    f"""WITH {_CLEAN_STEPS}, {_RATE_BANDS}, cells AS (
  SELECT link_id, metric, count(*) AS with_evidence, count(*) FILTER (rate IS NOT NULL AND admissible) AS candidates,
    arg_min(rate, source_id) FILTER (rate IS NOT NULL AND admissible) AS value,
    max(rate) FILTER (rate IS NOT NULL AND admissible) - min(rate) FILTER (rate IS NOT NULL AND admissible) AS spread, min(greatest({AS_OF} - ns, 0)) AS age FROM judged GROUP BY 1, 2
), banded AS (
  SELECT cells.*, CASE WHEN candidates = 0 THEN 'incomplete' WHEN a IS NULL AND candidates >= 2 AND spread > 0 THEN 'conflicting' WHEN a IS NULL THEN 'unknown' WHEN value < a THEN 'healthy' WHEN value < b THEN 'marginal'
    WHEN value < c THEN 'degraded' ELSE 'severe' END AS state FROM cells LEFT JOIN rb USING (metric)
)
SELECT link_id, metric, state, CASE WHEN state = 'unknown' THEN 'none' WHEN state IN ('incomplete', 'conflicting') THEN 'low' WHEN candidates >= 2 THEN 'high'
    WHEN 2 * age <= {2000 * HOUR} THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN state NOT IN ('incomplete', 'unknown', 'conflicting') THEN value END AS rate_per_second,
  CAST(with_evidence AS INTEGER) AS sources_with_evidence, CAST(with_evidence AS INTEGER) AS sources_fresh FROM banded"""
)
def assess_counters(spark, sf_dir):
    """Counters of all links: rates of the newest steps, banded; octets have no rule, and so no tolerance either."""
    policy = replace(WRAPS, validity_ns=2000 * HOUR).with_rules(tolerance=1e30)
    rows = _fed(adapters.counter_readings(_events(spark, sf_dir)))
    each = [capability.Declaration(f"src-{i}", tuple(capability.Measures(f, n, u, "counter", "u32") for f, n, u in _COUNTER_NAMES)) for i in range(3)]
    views = capability.views(capability.declarations(spark, each), links.registry(rows))
    out = _shown(assess.assess(assess.current_records(rows, policy), views, policy, AS_OF, adapters.EPOCH).withColumn("value", F.col("rate_per_second")))
    return out.select("link_id", "metric", "state", "confidence", F.col("value").alias("rate_per_second"), "sources_with_evidence", "sources_fresh")


@query(
    f"""WITH {_COUNTERS}, k AS (SELECT *, {_COUNTER_METRIC} AS metric, row_number() OVER (PARTITION BY link_no, src_no, event_type ORDER BY event_id DESC) AS nth FROM counts
), newest AS (SELECT *, ns > {_PAST} AS ahead FROM k WHERE nth = 1), rows_ AS (
  SELECT k.* FROM k JOIN newest USING (link_no, src_no, event_type) WHERE NOT newest.ahead OR k.nth <= 64 AND k.ns <= {_PAST}
), lagged AS (
  SELECT *, lag(cv) OVER w AS pv, row_number() OVER (PARTITION BY link_no, src_no, event_type ORDER BY event_id DESC) AS back FROM rows_
  WINDOW w AS (PARTITION BY link_no, src_no, event_type ORDER BY event_id)
), last AS (
  SELECT *, CASE WHEN rst THEN 'reset' WHEN pv IS NULL THEN 'baseline' WHEN cv >= pv THEN 'advance'
      WHEN pv >= 3221225472 AND cv <= 1073741824 AND event_type <> 'error' THEN 'wrap' ELSE 'decrease-unproven' END AS event FROM lagged WHERE back = 1
)
SELECT 'link-' || link_no AS link_id, 'src-' || src_no AS source_id, split_part(metric, ':', 2) AS name, CAST(seq AS BIGINT) AS sequence, event,
  CAST(CASE event WHEN 'advance' THEN cv - pv WHEN 'wrap' THEN 4294967296 - pv + cv END AS BIGINT) AS delta FROM last"""
)
def as_of_counter(spark, sf_dir):
    """Continuity replayed over the ring, as things stood at an instant."""
    rows = _fed(adapters.counter_readings(_events(spark, sf_dir)))
    out = assess.records_as_of(rows, WRAPS, _PAST, adapters.EPOCH)
    return out.select("link_id", "source_id", "name", "sequence", "event", F.col("delta").cast("long").alias("delta"))


@query(
    f"""WITH {_COUNTERS}, r AS (SELECT *, 1 + seq // 40 AS inc, seq % 37 = 0 AND seq % 40 <> 0 AS oor FROM counts), before AS (
  SELECT *, last_value(CASE WHEN NOT oor THEN inc END IGNORE NULLS) OVER p AS pinc, last_value(CASE WHEN NOT oor THEN cv END IGNORE NULLS) OVER p AS pv, lag(oor) OVER w AS poor FROM r
  WINDOW w AS (PARTITION BY link_no, src_no, event_type ORDER BY event_id), p AS (PARTITION BY link_no, src_no, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT *, CASE WHEN pinc IS NOT NULL AND pinc <> inc THEN 'source-reincarnated' WHEN oor THEN 'out-of-range' WHEN rst THEN 'reset' WHEN pv IS NULL OR poor THEN 'baseline'
    WHEN cv >= pv THEN 'advance' WHEN pv >= 3221225472 AND cv <= 1073741824 AND event_type <> 'error' THEN 'wrap' ELSE 'decrease-unproven' END AS event FROM before
)
SELECT 'link-' || link_no AS link_id, 'src-' || src_no AS source_id, split_part({_COUNTER_METRIC}, ':', 2) AS name, count(*) AS samples, count(*) FILTER (event = 'source-reincarnated') AS reincarnations,
  count(*) FILTER (event = 'out-of-range') AS out_of_range, count(*) FILTER (event = 'advance') AS advances, count(*) FILTER (event = 'wrap') AS wraps, count(*) FILTER (event = 'reset') AS resets,
  count(*) FILTER (event = 'decrease-unproven') AS unproven FROM e GROUP BY 1, 2, 3"""
)
def machine_statistics(spark, sf_dir):
    """The whole machine over raw readings: sources that start anew, and values over 32 bits."""
    rows = adapters.counter_readings(_events(spark, sf_dir))
    over = (F.col("sequence") % 37 == 0) & (F.col("sequence") % 40 != 0)
    rows = rows.withColumns(
        {"source_incarnation": 1 + F.floor(F.col("sequence") / 40), "counter_value": F.when(over, F.lit(2**32)).otherwise(F.col("counter_value")).cast("decimal(20,0)")}
    )
    key = [c for c in STREAM if c not in ("source_incarnation", "link_generation")]
    out = counters.statistics(counters.machine_steps(counters.with_rules(rows, WRAPS), key), key)
    return out.select("link_id", "source_id", "name", "samples", "reincarnations", "out_of_range", "advances", "wraps", "resets", "unproven")


# Requests and views.
_ASKED = (("signal-power", "rx.level"), ("signal-power", "tx.level"), ("timing", "eye.width"), ("timing", "latency.roundtrip"), ("environmental", "temperature"))


@query(
    _plain(20.0, 6) + """, asked AS (SELECT * FROM (VALUES ('signal-power:rx.level'), ('signal-power:tx.level'), ('timing:eye.width')) t(metric))
SELECT link_id, metric, state, reasons FROM assessed JOIN asked USING (metric)
UNION ALL SELECT link_id, 'timing:latency.roundtrip', 'unsupported', 'declared-unsupported' FROM link_ids
UNION ALL SELECT link_id, 'environmental:temperature', 'unsupported', 'metric-not-declared' FROM link_ids"""
)
def requested_metrics(spark, sf_dir):
    """A list of metrics, asked for twice and out of order: some declared, some by nobody, one unsupported by the policy."""
    policy = replace(POLICY, unsupported=(("timing", "latency.roundtrip"),))
    rows = _fed(adapters.gauges(_events(spark, sf_dir)))
    seen = links.registry(rows)
    views = capability.requested(capability.views(_declared(spark), seen), seen, [*_ASKED[::-1], *_ASKED], policy.unsupported)
    out = assess.assess(assess.current_records(rows, policy), views, policy, AS_OF, adapters.EPOCH)
    return out.select("link_id", text.metric_id().alias("metric"), "state", F.array_join("reasons", ",").alias("reasons"))


@query(
    _plain(1e9, 2000) + _report_sql(True).replace(") SELECT link_id, CASE", "), seen AS (SELECT link_id, CASE").replace("r.sev = links.sev", "r.sev = links.sev)")
    + """ SELECT link_id, overall, confidence, evidence_considered, true AS link_registered FROM seen UNION ALL SELECT 'link-x', 'unsupported', 'none', 0, false"""
)
def unseen_link_report(spark, sf_dir):
    """Reports of all links seen, and of one that never was and for which nothing is declared."""
    rows = _fed(adapters.gauges(_events(spark, sf_dir)))
    seen = links.registry(rows)
    on = seen.select("link_id", "link_generation").union(local_frame(spark, [("link-x", 1)], "link_id string, link_generation long"))
    metrics = assess.assess(assess.current_records(rows, WIDE), _views(spark, rows), WIDE, AS_OF, adapters.EPOCH)
    out = assess.roll_up_links(metrics, WIDE, seen, on)
    return out.select("link_id", "overall", "confidence", "evidence_considered", "link_registered")


@query((_plain(1e9, 2000) + _report_sql(True)).replace("'link-' || (user_id % 8)", "'link-' || user_id"))
def link_report_users(spark, sf_dir):
    """Reports with a link for every user, as many as the table has."""
    rows = _fed(adapters.gauges(_events(spark, sf_dir), links=None))
    out = assess.roll_up_links(assess.assess(assess.current_records(rows, WIDE), _views(spark, rows), WIDE, AS_OF, adapters.EPOCH), WIDE)
    return out.select("link_id", "overall", "confidence", "evidence_considered", "evidence_fresh", "evidence_present")


@query(
    f"""WITH {_OBS}, {_GAUGES}, l AS (SELECT DISTINCT link_id FROM g)
SELECT link_id, 'src-0' AS source_id, false AS scoped, 5 AS validity_ns, CAST(CASE WHEN link_id = 'link-1' THEN 2 ELSE 1 END AS BIGINT) AS declarations FROM l
UNION ALL SELECT 'link-1', 'src-0', true, 9, 2 FROM l WHERE link_id = 'link-1'"""
)
def scoped_views(spark, sf_dir):
    """A source that declares a metric for all links, and for one of them once more: that link has both."""
    rx = lambda ns: (capability.Measures("signal-power", "rx.level", "dBm", validity_ns=ns),)
    declared = capability.declarations(spark, [capability.Declaration("src-0", rx(9), scope=("link-1", 1)), capability.Declaration("src-0", rx(5))])
    views = capability.views(declared, links.registry(adapters.gauges(_events(spark, sf_dir))))
    n = views.groupBy("link_id").agg(F.count("*").alias("declarations"))
    return views.join(n, "link_id").select("link_id", "source_id", "scoped", "validity_ns", "declarations")


@query(
    _plain(20.0, 6) + """, m AS (SELECT link_id, metric, CAST(coalesce(n_fresh, 0) AS INTEGER) AS fresh_sources, row_number() OVER (ORDER BY link_id,
    CASE split_part(metric, ':', 1) WHEN 'signal-power' THEN 1 WHEN 'signal-ratio' THEN 2 WHEN 'loss-ratio' THEN 4 WHEN 'timing' THEN 5 END, split_part(metric, ':', 2)) AS n,
  count(*) OVER () AS total FROM assessed) SELECT link_id, metric, fresh_sources, total - 10 AS dropped FROM m WHERE n <= 10"""
)
def inspection_cap(spark, sf_dir):
    """The first entries of an inspection in the order of links and metrics, and how many were left out."""
    rows, left = inspection.capped(inspection.freshness(_assessed(spark, sf_dir, POLICY)), 10)
    return rows.join(F.broadcast(left)).select("link_id", text.metric_id().alias("metric"), "fresh_sources", "dropped")


@query(
    _plain(1e9, 2000) + _report_sql(True).replace("considered AS evidence_considered", "CAST(considered AS VARCHAR) AS evidence_considered").replace("fresh AS evidence_fresh", "CAST(fresh AS VARCHAR) AS evidence_fresh").replace("considered > 0 AS", "CAST(considered > 0 AS VARCHAR) AS")
)
def report_json(spark, sf_dir):
    """Reports as JSON, and what stands in it."""
    out = assess.roll_up_links(_assessed(spark, sf_dir, WIDE), WIDE)
    out = out.select("link_id", F.to_json(F.struct(*out.columns)).alias("report"))
    names = ("overall", "confidence", "evidence_considered", "evidence_fresh", "evidence_present")
    return out.select("link_id", *(F.get_json_object("report", f"$.{n}").alias(n) for n in names))


# Texts.
@query(
    """WITH n AS (SELECT event_id, event_id % 1000 AS m, CAST(event_id % 23 AS INTEGER) - 11 AS k FROM events), d AS (
  SELECT *, rtrim(CAST(m AS VARCHAR), '0') AS digits, k + length(CAST(m AS VARCHAR)) - 1 AS e FROM n
), t AS (
  SELECT *, CASE WHEN e >= length(digits) - 1 THEN digits || repeat('0', e - length(digits) + 1) WHEN e >= 0 THEN substr(digits, 1, e + 1) || '.' || substr(digits, e + 2)
      ELSE '0.' || repeat('0', -e - 1) || digits END AS fixed,
    substr(digits, 1, 1) || CASE WHEN length(digits) > 1 THEN '.' || substr(digits, 2) ELSE '' END || CASE WHEN e < 0 THEN 'e-' ELSE 'e+' END || lpad(CAST(abs(e) AS VARCHAR), 2, '0') AS science
  FROM d
), s AS (SELECT *, CASE WHEN length(fixed) <= length(science) THEN fixed ELSE science END AS short FROM t)
SELECT event_id AS ordinal, CASE WHEN event_id % 2 = 1 AND m > 0 THEN '-' ELSE '' END || CASE WHEN m = 0 THEN '0.0' WHEN contains(short, '.') OR contains(short, 'e') THEN short ELSE short || '.0' END || ' dBm' AS reading FROM s"""
)
def double_text(spark, sf_dir):
    """Gauge readings between 1e-11 and 1e14 as text."""
    m, k = F.col("event_id") % 1000, (F.col("event_id") % 23).cast("int") - 11
    value = F.concat(m.cast("string"), F.lit("e"), k.cast("string")).cast("double")
    value = F.when((F.col("event_id") % 2 == 1) & (m > 0), -value).otherwise(value)
    rows = _events(spark, sf_dir).withColumns({"gauge_value": value, "unit": F.lit("dBm"), "semantics": F.lit("gauge")})
    rows = rows.withColumns({"counter_value": F.lit(None).cast("decimal(20,0)"), "counter_width": F.lit(None).cast("string"), "reset_declared": F.lit(False)})
    return rows.select(F.col("event_id").alias("ordinal"), text.reading().alias("reading"))


@query(
    """SELECT event_id AS ordinal, 'link-' || (user_id % 8) AS link_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 5 END AS link_generation, 'src-' || (user_id % 3) AS source_id,
  CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 7 END AS source_incarnation, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'timing' END AS family,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'm' || (event_id % 10) || '.x' END AS name, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'optical' END AS transport,
  CASE WHEN event_id % 2 = 0 THEN true WHEN event_id % 3 = 0 THEN false END AS flag, CASE WHEN event_id % 9 <> 0 THEN event_id END AS number FROM events"""
)
def parsed_identities(spark, sf_dir):
    """Identities, metrics, names of enumerations, flags and numbers read from text."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = _events(spark, sf_dir).select(
        e.alias("ordinal"),
        F.concat(F.lit("link-"), u % 8, F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("/gen"), e % 5))).alias("link"),
        F.concat(F.lit("src-"), u % 3, F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("@"), e % 7))).alias("source"),
        F.concat(F.when(e % 6 == 0, "timing").otherwise("timing:"), F.lit("m"), e % 10, F.lit(".x")).alias("metric"),
        F.when(e % 5 == 0, "fibre").otherwise(" Optical\t").alias("medium"),
        F.when(e % 2 == 0, "YES").when(e % 3 == 0, " off ").otherwise("maybe").alias("flag"),
        F.concat(F.lit(" "), e, F.when(e % 9 == 0, "x").otherwise("\n")).alias("number"),
    )
    link, source, metric = text.split_link("link"), text.split_source("source"), text.split_metric("metric")
    return rows.select(
        "ordinal", link[0].alias("link_id"), link[1].alias("link_generation"), source[0].alias("source_id"), source[1].alias("source_incarnation"), metric[0].alias("family"),
        metric[1].alias("name"), text.known("medium", TRANSPORTS).alias("transport"), text.parsed_bool("flag").alias("flag"), text.parsed_long("number").alias("number"),
    )


@query(
    """WITH l AS (SELECT DISTINCT 'link-' || user_id AS link FROM events), b AS (SELECT link, list_transform(range(length(link)), lambda i: unicode(substr(link, CAST(i AS INTEGER) + 1, 1))) AS bytes FROM l),
h AS (
  SELECT link, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(bytes, lambda x: CAST(x AS HUGEINT))),
      lambda a, x: (a - a % 256 + xor(a % 256, x)) * 1099511628211 % 18446744073709551616) AS fnv,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda x: CAST(x AS BIGINT))),
      lambda a, x: list_reduce(list_prepend(xor(a, x), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(2197175160 AS BIGINT)) ELSE c // 2 END)) AS crc FROM b
)
SELECT link, lower(lpad(to_hex(CAST(fnv AS UBIGINT)), 16, '0')) AS fnv1a64, lower(lpad(to_hex(xor(crc, CAST(4294967295 AS BIGINT))), 8, '0')) AS crc32c FROM h"""
)
def link_hashes(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.concat(F.lit("link-"), "user_id").alias("link")).distinct()
    return rows.select("link", text.fnv1a64("link").alias("fnv1a64"), text.crc32c("link").alias("crc32c"))


@query(
    f"""WITH {_COUNTERS} SELECT event_id AS ordinal, 'evidence link-' || link_no || '/gen1 src-' || src_no || '@1 seq=' || seq || ' ' || {_COUNTER_METRIC} || ' lane=aggregate value=' || cv ||
  CASE WHEN event_type = 'error' THEN ' bytes' ELSE ' count' END || ' (u32)' || CASE WHEN rst THEN ' reset-declared' ELSE '' END || ' observed=' || ns || 's received=' || ns ||
  ' origin=live class=real authority=1' AS line FROM counts"""
)
def evidence_lines(spark, sf_dir):
    """Stored readings as lines."""
    return adapters.counter_readings(_events(spark, sf_dir)).select("ordinal", text.record_line().alias("line"))


#: Events in a micro-batch: what a task of the stream holds of one stream of readings doesn't grow with the table.
_EVENTS_A_BATCH = 1_500_000


def _slices(spark, events, at: str) -> list[str]:
    """Write all arrivals under ``at``, one folder per span of ordinals, at least three; the folders in order."""
    n = max(3, -(-events.count() // _EVENTS_A_BATCH))
    cuts = [int(x) * 10 for x in events.approxQuantile("event_id", [i / n for i in range(1, n)], 0.1 / n)]
    span = sum((F.when(F.col("ordinal") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    # dealt out before they are sorted by span; up to 200 parts are written without holding rows in memory
    dealt = adapters.dirty_arrivals(events).withColumn("span", span).repartition(min(200, 8 * n), "span", F.pmod(F.xxhash64("ordinal"), F.lit(8)))
    dealt.write.partitionBy("span").parquet(at)
    return [f"{at}/span={i}" for i in range(n)]


# The stream of arrivals, in micro-batches.
@query(
    _STEPS_DIRTY + f""" SELECT CAST(ord AS BIGINT) AS ordinal, event, CAST(delta AS BIGINT) AS delta, CAST(elapsed AS BIGINT) AS elapsed_ns,
  CASE WHEN elapsed IS NOT NULL THEN elapsed > {12 * HOUR} OR elapsed <= 0 END AS spans_gap, CAST(missing AS BIGINT) AS missing FROM steps"""
)
def streaming_counter_steps(spark, sf_dir):
    """Fence and continuity over a stream of all arrivals, with its state and checkpoint in the shared folder."""
    at = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    schema = adapters.dirty_arrivals(_events(spark, sf_dir)).schema
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{at}/in"))
    # later arrivals come later: each span is a micro-batch of a stream that goes on from its checkpoint
    for i, folder in enumerate(_slices(spark, _events(spark, sf_dir), f"{at}/spans")):
        if files.exists(path(folder)):
            files.rename(path(folder), path(f"{at}/in/batch-{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        out = continuity.continuity(stream, WRAPS, 8).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out")
        out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{at}/out").where("fence = 'accepted'")
    return got.select("ordinal", "event", F.col("delta").cast("long").alias("delta"), "elapsed_ns", "spans_gap", "missing")

