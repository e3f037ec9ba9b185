"""The registered queries over the driver tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocabulary import SECOND, STREAM
from ..operators import admission, assess, counters, fence, history, inspection, links, retention
from ..sources import adapters
from . import capability
from .catalog import Catalog
from .policy import DEFAULT, Policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3600 * SECOND
#: 2024-01-29 12:00:00, and the wide windows that monthly events need.
AS_OF = 1_706_529_600 * SECOND
POLICY = replace(DEFAULT.with_rules(tolerance=20.0), id="events", validity_ns=6 * HOUR, family_validity_ns=(), gap_ns=12 * HOUR)
STRICT = replace(POLICY.with_rules(tolerance=0.5), id="strict")
WIDE = replace(POLICY.with_rules(tolerance=1e9), id="wide", validity_ns=2000 * HOUR)
WRAPS = replace(POLICY.with_rules(wrap=True, ceiling=0.75, floor=0.25), id="wraps")
GAUGES = (("signal-power", "rx.level", "dBm"), ("signal-ratio", "snr", "dB"), ("signal-ratio", "margin", "dB"), ("loss-ratio", "loss.ratio", "ppm"))


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _declared(spark: SparkSession, lanes: int = 0) -> DataFrame:
    each = tuple(capability.Measures(f, n, u, lanes_declared=lanes > 0, lane_count=lanes) for f, n, u in GAUGES)
    more = (*each, capability.Measures("signal-power", "tx.level", "dBm"))
    rows = [capability.Declaration(f"src-{i}", more if i == 0 else each, unsupported=(("timing", "eye.width"),) if i == 2 else ()) for i in range(3)]
    return capability.declarations(spark, rows)


def _fed(rows: DataFrame) -> DataFrame:
    """Clean arrivals: event ids rise within every stream, so nothing is behind its watermark."""
    return rows.withColumn("fence", F.lit("accepted"))


def _views(spark: SparkSession, rows: DataFrame, lanes: int = 0) -> DataFrame:
    return capability.views(_declared(spark, lanes), links.registry(rows))


def _assessed(spark: SparkSession, sf_dir: str, policy: Policy, lanes: int = 0, authorities: int = 1) -> DataFrame:
    rows = _fed(adapters.gauges(_events(spark, sf_dir), lanes, authorities))
    return assess.assess(assess.current_records(rows, policy), _views(spark, rows, lanes), policy, AS_OF, adapters.EPOCH)


# SQL: events as observations, and the tables of declarations and rules.
_METRIC = """CASE event_type WHEN 'click' THEN 'signal-power:rx.level' WHEN 'view' THEN 'signal-ratio:snr'
 WHEN 'signup' THEN 'signal-ratio:margin' WHEN 'purchase' THEN 'loss-ratio:loss.ratio' ELSE 'error-counter:errors.corrected' END"""
_OBS = f"""obs AS (
  SELECT event_id, 'link-' || (user_id % 8) AS link_id, 'src-' || (user_id % 3) AS source_id, user_id, event_type, ts,
    {_METRIC} AS metric, CASE WHEN event_type = 'click' THEN -value / 10 ELSE value END AS v, epoch_us(ts) * 1000 AS ns
  FROM events
)"""
_GAUGES = "g AS (SELECT * FROM obs WHERE event_type <> 'error')"
_LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link_id, source_id, metric ORDER BY event_id DESC) AS n FROM g) WHERE n = 1
)"""
_DECLARED = """declared AS (
  SELECT * FROM (VALUES ('signal-power:rx.level', 3), ('signal-ratio:snr', 3), ('signal-ratio:margin', 3), ('loss-ratio:loss.ratio', 3),
    ('signal-power:tx.level', 1), ('timing:eye.width', 0)) t(metric, declared)
), link_ids AS (SELECT DISTINCT link_id FROM g), cells AS (SELECT link_id, metric, declared FROM link_ids, declared)"""
_BANDS = """bands AS (
  SELECT * FROM (VALUES
    ('signal-power:rx.level', NULL, -14.0, 'rx-level-severe', 'severe'), ('signal-power:rx.level', -14.0, -11.0, 'rx-level-degraded', 'degraded'),
    ('signal-power:rx.level', -11.0, -7.0, 'rx-level-marginal', 'marginal'), ('signal-power:rx.level', -7.0, NULL, 'rx-level-healthy', 'healthy'),
    ('signal-ratio:snr', NULL, 12.0, 'snr-severe', 'severe'), ('signal-ratio:snr', 12.0, 16.0, 'snr-degraded', 'degraded'),
    ('signal-ratio:snr', 16.0, 22.0, 'snr-marginal', 'marginal'), ('signal-ratio:snr', 22.0, NULL, 'snr-healthy', 'healthy'),
    ('signal-ratio:margin', NULL, 0.0, 'margin-severe', 'severe'), ('signal-ratio:margin', 0.0, 2.0, 'margin-degraded', 'degraded'),
    ('signal-ratio:margin', 2.0, 4.0, 'margin-marginal', 'marginal'), ('signal-ratio:margin', 4.0, NULL, 'margin-healthy', 'healthy'),
    ('loss-ratio:loss.ratio', NULL, 1.0, 'loss-healthy', 'healthy'), ('loss-ratio:loss.ratio', 1.0, 100.0, 'loss-marginal', 'marginal'),
    ('loss-ratio:loss.ratio', 100.0, 1000.0, 'loss-degraded', 'degraded'), ('loss-ratio:loss.ratio', 1000.0, NULL, 'loss-severe', 'severe')
  ) t(metric, lo, hi, band_id, band_state)
)"""
_RANKS = """ranks AS (
  SELECT * FROM (VALUES ('unknown', 0), ('unsupported', 1), ('healthy', 2), ('incomplete', 3), ('stale', 4), ('marginal', 5), ('degraded', 6),
    ('severe', 7), ('conflicting', 8)) t(state, sev)
)"""
_CONFIDENCE = "CASE {} WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END"


def _cells_sql(tolerance: float, hours: int, cell: str = "link_id, metric", latest: str = _LATEST, cells: str = "cells") -> str:
    """CTEs down to ``assessed``: one row per cell with state, confidence and what led to them."""
    on = " AND ".join(f"a.{c.strip()} IS NOT DISTINCT FROM c.{c.strip()}" for c in cell.split(","))
    return f"""{latest}, fresh AS (
  SELECT *, {AS_OF} - ns AS age, ns >= {AS_OF} - {hours * HOUR} AS is_fresh FROM latest
), best AS (
  SELECT *, max(CASE WHEN is_fresh THEN authority END) OVER (PARTITION BY {cell}) AS top FROM (SELECT *, {{authority}} AS authority FROM fresh)
), agg AS (
  SELECT {cell}, count(*) AS with_evidence, count(*) FILTER (is_fresh) AS n_fresh, min(greatest(age, 0)) FILTER (is_fresh) AS min_age,
    count(*) FILTER (is_fresh AND authority = top) AS winners, count(*) FILTER (is_fresh AND authority < top) AS lower_n,
    max(v) FILTER (is_fresh AND authority = top) - min(v) FILTER (is_fresh AND authority = top) AS spread,
    arg_min(v, source_id) FILTER (is_fresh AND authority = top) AS rep
  FROM best GROUP BY {cell}
), stepped AS (
  SELECT c.*, a.with_evidence, a.n_fresh, a.min_age, a.winners, a.lower_n, a.spread, a.rep,
    CASE WHEN declared = 0 THEN 0 WHEN a.with_evidence IS NULL THEN 1 WHEN n_fresh = 0 THEN 2
      WHEN winners >= 2 AND NOT spread <= {tolerance} THEN 4 ELSE 6 END AS step
  FROM {cells} c LEFT JOIN agg a ON {on}
), banded AS (
  SELECT s.*, b.band_id, CASE step WHEN 0 THEN 'unsupported' WHEN 1 THEN 'unknown' WHEN 2 THEN 'stale' WHEN 4 THEN 'conflicting'
    ELSE coalesce(b.band_state, 'unknown') END AS state
  FROM stepped s LEFT JOIN bands b ON step = 6 AND b.metric = s.metric AND (lo IS NULL OR rep >= lo) AND (hi IS NULL OR rep < hi)
), assessed AS (
  SELECT *, CASE WHEN state IN ('unknown', 'unsupported') THEN 0 WHEN state IN ('stale', 'conflicting') THEN 1 WHEN winners >= 2 THEN 3
      WHEN 2 * min_age <= {hours * HOUR} THEN 2 ELSE 1 END AS conf,
    CASE step WHEN 0 THEN 'declared-unsupported' WHEN 1 THEN 'no-evidence' WHEN 2 THEN 'evidence-expired'
      WHEN 4 THEN CASE WHEN lower_n > 0 THEN 'lower-authority-ignored,' ELSE '' END || 'equal-authority-disagreement'
      ELSE CASE WHEN lower_n > 0 THEN 'lower-authority-ignored,' ELSE '' END || 'band-matched' END AS reasons
  FROM banded
)"""


def _plain(tolerance: float, hours: int, authority: str = "1") -> str:
    return f"WITH {_OBS}, {_GAUGES}, {_DECLARED}, {_BANDS}, {_RANKS}, " + _cells_sql(tolerance, hours).replace("{authority}", authority)


# Admission and the fence.
_COUNTERS = """seqs AS (
  SELECT *, row_number() OVER w AS seq, (4294000000 + 1000 * CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT)) % 4294967296 AS raw
  FROM (SELECT *, user_id % 8 AS link_no, user_id % 3 AS src_no FROM events)
  WINDOW w AS (PARTITION BY user_id % 8, user_id % 3, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)
), counts AS (
  SELECT *, CASE WHEN seq % 19 = 0 THEN raw // 2 ELSE raw END AS cv, seq % 29 = 0 AS rst, epoch_us(ts) * 1000 AS ns FROM seqs
)"""
_DIRTY = """dated AS (
  SELECT *, event_id * 10 + CASE WHEN seq % 17 = 0 THEN 30001 WHEN seq % 7 = 0 THEN 6003 ELSE 0 END AS ord, cv AS again FROM counts
), arrivals AS (
  SELECT * FROM dated UNION ALL SELECT * REPLACE (ord + 35 AS ord) FROM dated WHERE seq % 11 = 0
  UNION ALL SELECT * REPLACE (ord + 47 AS ord, cv + 1 AS again) FROM dated WHERE seq % 13 = 0
), seen AS (
  SELECT *, max(seq) OVER (PARTITION BY link_no, src_no, event_type ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark,
    row_number() OVER s AS nth, first_value(again) OVER s AS first_again
  FROM arrivals WINDOW s AS (PARTITION BY link_no, src_no, event_type, seq ORDER BY ord)
), fenced AS (
  SELECT *, CASE WHEN nth > 1 AND mark - seq < 8 THEN CASE WHEN again = first_again THEN 'duplicate' ELSE 'id-mismatch' END
    WHEN mark - seq > 8 THEN 'fenced' WHEN mark > seq THEN 'reordered' ELSE 'accepted' END AS fence
  FROM seen
)"""


def _steps_sql(source: str, wrap: bool) -> str:
    rule = "pv >= 3221225472 AND value <= 1073741824" + ("" if wrap else " AND false")
    return f"""lagged AS (
  SELECT *, lag(value) OVER w AS pv, lag(ns) OVER w AS pns, lag(seq) OVER w AS pseq FROM ({source})
  WINDOW w AS (PARTITION BY link_no, src_no, event_type ORDER BY ord)
), events_ AS (
  SELECT *, CASE WHEN rst THEN 'reset' WHEN pv IS NULL THEN 'baseline' WHEN value >= pv THEN 'advance'
    WHEN {rule} AND event_type <> 'error' THEN 'wrap' ELSE 'decrease-unproven' END AS event
  FROM lagged
), steps AS (
  SELECT *, CASE event WHEN 'advance' THEN value - pv WHEN 'wrap' THEN 4294967296 - pv + value END AS delta,
    CASE WHEN event IN ('advance', 'wrap') THEN greatest(ns - pns, 0) END AS elapsed,
    CASE WHEN event IN ('advance', 'wrap', 'decrease-unproven') THEN greatest(seq - pseq - 1, 0) ELSE 0 END AS missing
  FROM events_
)"""


_STEPS_DIRTY = f"WITH {_COUNTERS}, {_DIRTY}, " + _steps_sql("SELECT * REPLACE (again AS value) FROM fenced WHERE fence = 'accepted'", True)
_STEPS_CLEAN = f"WITH {_COUNTERS}, " + _steps_sql("SELECT * REPLACE (cv AS value), event_id AS ord FROM counts", True)


def _stepped(spark: SparkSession, sf_dir: str, dirty: bool = True, policy: Policy = WRAPS) -> DataFrame:
    events = _events(spark, sf_dir)
    rows = fence.fenced(adapters.dirty_arrivals(events), 8).where("fence = 'accepted'") if dirty else adapters.counter_readings(events)
    return counters.steps(counters.with_rules(rows, policy))


def _broken(events: DataFrame) -> DataFrame:
    """Gauge readings with one fault every few rows."""
    rows = adapters.gauges(events)
    k = F.col("sequence") % 20
    return rows.withColumns(
        {
            "gauge_value": F.when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(F.col("gauge_value")),
            "unit": F.when(k == 3, "count").when(k == 4, "mV").when(k == 5, "none").otherwise(F.col("unit")),
            "link_id": F.when(k == 6, "not a link").otherwise(F.col("link_id")),
            "link_generation": F.when(k == 7, 0).otherwise(F.col("link_generation")).cast("long"),
            "name": F.when(k == 8, "no.such").otherwise(F.col("name")),
            "lane": F.when(k == 9, 4096).when(k == 10, 4095).cast("int"),
            "interval_ns": F.when(k == 11, 0).when(k == 12, 5).cast("long"),
            "gauge_validity_ns": F.when(k == 13, -1).otherwise(0).cast("long"),
            "source_incarnation": F.when(k == 14, 0).otherwise(1).cast("long"),
        }
    )


@query(
    f"""WITH {_OBS}, {_GAUGES} SELECT event_id AS ordinal,
  CASE WHEN event_id % 20 = 8 THEN 'unsupported' WHEN event_id % 20 IN (1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 14) THEN 'invalid' ELSE 'ok' END AS status_code,
  CASE event_id % 20 WHEN 8 THEN 'unknown metric' WHEN 1 THEN 'gauge not finite' WHEN 2 THEN 'gauge not finite' WHEN 3 THEN 'gauge unit'
    WHEN 4 THEN 'units differ' WHEN 5 THEN 'no unit' WHEN 6 THEN 'link identity' WHEN 7 THEN 'link identity' WHEN 9 THEN 'lane range'
    WHEN 11 THEN 'interval' WHEN 13 THEN 'gauge validity' WHEN 14 THEN 'source identity' END AS fault
FROM g"""
)
def validate_status(spark, sf_dir):
    out = admission.validate(_broken(_events(spark, sf_dir)), Catalog().frame(spark))
    return out.select("ordinal", "status_code", "fault")


@query(
    f"""WITH {_OBS}, {_GAUGES} SELECT event_id AS ordinal,
  CASE WHEN user_id % 3 = 1 AND metric = 'loss-ratio:loss.ratio' THEN 'rejected' WHEN user_id % 3 = 2 THEN 'rejected'
    WHEN user_id % 4 >= 2 THEN 'invalid' ELSE 'ok' END AS status_code
FROM g"""
)
def capability_gate(spark, sf_dir):
    """src-0 declares all on 2 lanes, src-1 all but losses, src-2 nothing."""
    rows = adapters.gauges(_events(spark, sf_dir), lanes=4)
    two = [capability.Measures(f, n, u, lanes_declared=True, lane_count=2) for f, n, u in GAUGES]
    declared = capability.declarations(spark, [capability.Declaration("src-0", tuple(two)), capability.Declaration("src-1", tuple(two[:3]))])
    checked = admission.validate(rows, Catalog().frame(spark))
    return admission.capability_gate(checked, capability.gate(declared, links.registry(rows))).select("ordinal", "status_code")


@query(f"WITH {_OBS}, {_GAUGES} SELECT event_id AS ordinal, CASE WHEN {AS_OF} - ns > {24 * HOUR} THEN 'stale' ELSE 'ok' END AS status_code FROM g")
def age_gate(spark, sf_dir):
    rows = adapters.gauges(_events(spark, sf_dir)).withColumns({"status_code": F.lit("ok"), "fault": F.lit(None).cast("string")})
    return admission.age_gate(rows, AS_OF, 24 * HOUR).select("ordinal", "status_code")


@query(
    f"""WITH {_OBS}, {_GAUGES}, firsts AS (
  SELECT link_id, source_id, metric, min(event_id) AS first FROM g GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY first) AS n FROM firsts)
SELECT event_id AS ordinal, CASE WHEN n > 5 THEN 'limit-exceeded' ELSE 'ok' END AS status_code FROM g JOIN ranked USING (link_id, source_id, metric)"""
)
def stream_limit(spark, sf_dir):
    rows = adapters.gauges(_events(spark, sf_dir)).withColumn("status_code", F.lit("ok"))
    key = [c for c in STREAM if c not in ("link_id", "link_generation")]
    return admission.limit_firsts(rows, key, ["link_id", "link_generation"], 5).select("ordinal", "status_code")


@query(
    f"""WITH {_OBS}, {_GAUGES}, s AS (
  SELECT event_id, CASE WHEN event_id % 20 = 8 THEN 'unsupported' WHEN event_id % 20 IN (1, 2, 3, 4, 5, 6, 7, 9, 11, 13, 14) THEN 'invalid' ELSE 'ok' END AS c FROM g
) SELECT count(*) AS total, count(*) FILTER (c = 'ok') AS accepted, count(*) FILTER (c <> 'ok') AS refused,
  arg_min(c, event_id) FILTER (c <> 'ok') AS first_code FROM s"""
)
def batch_outcome(spark, sf_dir):
    return admission.outcome(admission.validate(_broken(_events(spark, sf_dir)), Catalog().frame(spark)))


@query(f"WITH {_COUNTERS}, {_DIRTY} SELECT CAST(ord AS BIGINT) AS ordinal, CAST(seq AS BIGINT) AS sequence, fence FROM fenced")
def replay_fence(spark, sf_dir):
    return fence.fenced(adapters.dirty_arrivals(_events(spark, sf_dir)), 8).select("ordinal", "sequence", "fence")


@query(f"WITH {_COUNTERS}, {_DIRTY} SELECT fence, count(*) AS n FROM fenced GROUP BY fence")
def fence_statistics(spark, sf_dir):
    return fence.fenced(adapters.dirty_arrivals(_events(spark, sf_dir)), 8).groupBy("fence").agg(F.count("*").alias("n"))


@query(f"WITH {_OBS}, {_GAUGES}, {_LATEST} SELECT link_id, source_id, metric, event_id AS sequence, v AS value FROM latest")
def stream_latest(spark, sf_dir):
    rows = fence.latest(adapters.gauges(_events(spark, sf_dir)))
    return rows.select("link_id", "source_id", text.metric_id().alias("metric"), "sequence", F.col("gauge_value").alias("value"))


@query(
    _STEPS_DIRTY + f""" SELECT CAST(ord AS BIGINT) AS ordinal, event, CAST(delta AS BIGINT) AS delta, CAST(elapsed AS BIGINT) AS elapsed_ns,
  CASE WHEN elapsed IS NOT NULL THEN elapsed > {12 * HOUR} OR elapsed <= 0 END AS spans_gap, CAST(missing AS BIGINT) AS missing FROM steps"""
)
def counter_steps(spark, sf_dir):
    return _stepped(spark, sf_dir).select("ordinal", "event", F.col("delta").cast("long").alias("delta"), "elapsed_ns", "spans_gap", "missing")


@query(
    _STEPS_CLEAN + f""" SELECT CAST(ord AS BIGINT) AS ordinal, CASE WHEN elapsed >= 1000000 THEN CAST(delta AS DOUBLE) / (elapsed / 1e9) END AS rate,
  elapsed IS NOT NULL AND NOT (elapsed > {12 * HOUR} OR elapsed <= 0) AS rate_admissible FROM steps"""
)
def counter_rates(spark, sf_dir):
    return _stepped(spark, sf_dir, dirty=False).select("ordinal", counters.rate_per_second().alias("rate"), "rate_admissible")


@query(
    _STEPS_DIRTY + f""" SELECT 'link-' || link_no AS link_id, 'src-' || src_no AS source_id, event_type AS kind, count(*) AS samples,
  count(*) FILTER (event = 'advance') AS advances, count(*) FILTER (event = 'wrap') AS wraps, count(*) FILTER (event = 'reset') AS resets,
  count(*) FILTER (event = 'decrease-unproven') AS unproven, count(*) FILTER (elapsed > {12 * HOUR} OR elapsed <= 0) AS gaps,
  CAST(sum(missing) AS BIGINT) AS missing FROM steps GROUP BY 1, 2, 3"""
)
def counter_stats(spark, sf_dir):
    out = counters.statistics(_stepped(spark, sf_dir))
    kind = F.element_at(F.create_map(*(F.lit(x) for k, v in adapters._COUNTER_METRICS.items() for x in (v, k))), F.col("name"))
    return out.select("link_id", "source_id", kind.alias("kind"), "samples", "advances", "wraps", "resets", "unproven", "gaps", "missing")


@query(_STEPS_DIRTY + " SELECT CAST(ord AS BIGINT) AS ordinal, CAST(missing AS BIGINT) AS missing FROM steps WHERE missing > 0")
def missing_samples(spark, sf_dir):
    return _stepped(spark, sf_dir).where("missing > 0").select("ordinal", "missing")


@query(_STEPS_CLEAN + " SELECT CAST(ord AS BIGINT) AS ordinal, CAST(delta AS BIGINT) AS delta FROM steps WHERE event = 'wrap'")
def wrap_u32(spark, sf_dir):
    return _stepped(spark, sf_dir, dirty=False).where("event = 'wrap'").select("ordinal", F.col("delta").cast("long").alias("delta"))


@query(
    """WITH v AS (
  SELECT event_id, user_id % 8 AS k, (CAST(18446744073000000000 AS HUGEINT) + CAST(event_id AS HUGEINT) * 9000000) % CAST(18446744073709551616 AS HUGEINT) AS cv FROM events
), l AS (SELECT *, lag(cv) OVER (PARTITION BY k ORDER BY event_id) AS p FROM v)
SELECT event_id AS ordinal, CASE WHEN p IS NULL THEN 'baseline' WHEN cv >= p THEN 'advance' WHEN p >= CAST(13835058055282163711 AS HUGEINT) AND cv <= CAST(4611686018427387903 AS HUGEINT) THEN 'wrap'
  ELSE 'decrease-unproven' END AS event, CAST(CASE WHEN p IS NULL THEN NULL WHEN cv >= p THEN cv - p ELSE CAST(18446744073709551616 AS HUGEINT) - p + cv END AS BIGINT) AS delta FROM l"""
)
def wrap_u64(spark, sf_dir):
    """A 64-bit counter near its end."""
    rows = adapters.counter_readings(_events(spark, sf_dir))
    big = F.pmod(F.lit("18446744073000000000").cast("decimal(38,0)") + F.col("ordinal").cast("decimal(38,0)") * 9000000, F.lit("18446744073709551616").cast("decimal(38,0)"))
    rows = rows.withColumns(
        {"counter_value": big.cast("decimal(20,0)"), "counter_width": F.lit("u64"), "reset_declared": F.lit(False), "source_id": F.lit("src-0"),
         "family": F.lit("error-counter"), "name": F.lit("errors.symbol"), "sequence": F.col("ordinal")}
    )
    return counters.steps(counters.with_rules(rows, WRAPS)).select("ordinal", "event", F.col("delta").cast("long").alias("delta"))


@query(
    f"""WITH {_OBS}, {_GAUGES}, {_LATEST} SELECT link_id, source_id, metric, greatest({AS_OF} - ns, 0) AS age_ns, {6 * HOUR} AS validity_ns,
  greatest({AS_OF} - ns, 0) <= {6 * HOUR} AS fresh FROM latest"""
)
def freshness(spark, sf_dir):
    rows = _fed(adapters.gauges(_events(spark, sf_dir)))
    out = assess.with_freshness(assess.current_records(rows, POLICY), _views(spark, rows), POLICY, AS_OF, adapters.EPOCH)
    return out.select("link_id", "source_id", text.metric_id().alias("metric"), "age_ns", "validity_ns", "fresh")


_ASSESS = f""" SELECT link_id, metric, state, {_CONFIDENCE.format("conf")} AS confidence, reasons, coalesce(band_id, '') AS rules,
  CASE WHEN step = 6 THEN rep END AS value, CASE WHEN step >= 4 THEN spread END AS disagreement, CAST(declared AS INTEGER) AS sources_declared,
  CAST(coalesce(with_evidence, 0) AS INTEGER) AS sources_with_evidence, CAST(coalesce(n_fresh, 0) AS INTEGER) AS sources_fresh,
  CAST(CASE WHEN step = 4 THEN winners ELSE 0 END AS INTEGER) AS sources_conflicting FROM assessed"""


def _shown(metrics: DataFrame) -> DataFrame:
    confidence = assess.name_of(F.col("confidence_rank"), assess.CONFIDENCES)
    return metrics.select(
        "link_id", text.metric_id().alias("metric"), "state", confidence.alias("confidence"), F.array_join("reasons", ",").alias("reasons"),
        F.array_join("rules", ",").alias("rules"), "value", "disagreement", "sources_declared", "sources_with_evidence", "sources_fresh", "sources_conflicting",
    )


@query(_plain(20.0, 6) + _ASSESS)
def assess_metric(spark, sf_dir):
    return _shown(_assessed(spark, sf_dir, POLICY))


@query(_plain(1e9, 2000) + _ASSESS)
def assess_metric_wide(spark, sf_dir):
    return _shown(_assessed(spark, sf_dir, WIDE))


@query(_plain(0.5, 2000, "1 + user_id % 2") + _ASSESS)
def authority_winners(spark, sf_dir):
    return _shown(_assessed(spark, sf_dir, replace(STRICT, validity_ns=2000 * HOUR), authorities=2))


@query(_plain(0.5, 2000) + " SELECT link_id, metric, spread, CAST(winners AS INTEGER) AS claimants FROM assessed WHERE state = 'conflicting'")
def conflicts(spark, sf_dir):
    out = _assessed(spark, sf_dir, replace(STRICT, validity_ns=2000 * HOUR)).where("state = 'conflicting'")
    return out.select("link_id", text.metric_id().alias("metric"), F.col("disagreement").alias("spread"), F.col("sources_conflicting").alias("claimants"))


@query(_plain(1e9, 2000) + " SELECT link_id, metric, rep AS value FROM assessed WHERE step = 6")
def representative_value(spark, sf_dir):
    return _assessed(spark, sf_dir, WIDE).where("value IS NOT NULL").select("link_id", text.metric_id().alias("metric"), "value")


def _banded(spark: SparkSession, rows: DataFrame) -> DataFrame:
    bands = F.broadcast(POLICY.band_frame(spark))
    met = (rows.family == bands.family) & (rows.name == bands.name) & (F.col("gauge_value") >= F.col("lower"))
    return rows.join(bands, met & (F.col("upper").isNull() | (F.col("gauge_value") < F.col("upper"))))


_BAND_JOIN = "FROM g JOIN bands b ON b.metric = g.metric AND (lo IS NULL OR v >= lo) AND (hi IS NULL OR v < hi)"


@query(f"WITH {_OBS}, {_GAUGES}, {_BANDS} SELECT event_id AS ordinal, band_id, band_state {_BAND_JOIN}")
def band_classify(spark, sf_dir):
    return _banded(spark, adapters.gauges(_events(spark, sf_dir))).select("ordinal", "band_id", "band_state")


@query(f"WITH {_OBS}, {_GAUGES}, {_BANDS} SELECT band_id, band_state, count(*) AS n {_BAND_JOIN} GROUP BY ALL")
def band_histogram(spark, sf_dir):
    return _banded(spark, adapters.gauges(_events(spark, sf_dir))).groupBy("band_id", "band_state").agg(F.count("*").alias("n"))


# Lanes: every gauge on four lanes; tx.level stays without.
_LANED = _LATEST.replace("link_id, source_id, metric", "link_id, source_id, metric, lane")
_LANE_CELLS = """lane_cells AS (
  SELECT c.*, l.lane FROM cells c JOIN (VALUES (0), (1), (2), (3), (NULL)) l(lane)
    ON (l.lane IS NOT NULL) = (c.metric NOT IN ('signal-power:tx.level', 'timing:eye.width'))
)"""


def _lanes_sql(tolerance: float, hours: int) -> str:
    obs = _OBS.replace("user_id, event_type", "user_id, user_id % 4 AS lane, event_type")
    body = _cells_sql(tolerance, hours, "link_id, metric, lane", _LANED, "lane_cells").replace("{authority}", "1")
    return f"WITH {obs}, {_GAUGES}, {_DECLARED}, {_LANE_CELLS}, {_BANDS}, {_RANKS}, {body}"


_LANE_METRICS = """, sev AS (SELECT * FROM assessed JOIN ranks USING (state)), rolled AS (
  SELECT link_id, metric, arg_max(state, sev * 100 - coalesce(lane, 0)) AS worst, max(sev) AS sev, min(conf) AS conf,
    arg_max(rep, sev * 100 - coalesce(lane, 0)) FILTER (step = 6 AND sev = top_sev) AS value,
    coalesce(string_agg(CAST(lane AS VARCHAR), ',' ORDER BY lane) FILTER (state IN ('unknown', 'unsupported')), '') AS missing_lanes,
    CAST(sum(coalesce(with_evidence, 0)) AS INTEGER) AS sources_with_evidence, CAST(sum(coalesce(n_fresh, 0)) AS INTEGER) AS sources_fresh
  FROM (SELECT *, max(sev) OVER (PARTITION BY link_id, metric) AS top_sev FROM sev) GROUP BY link_id, metric
)"""


@query(
    _lanes_sql(1e9, 2000) + _LANE_METRICS + f""" SELECT link_id, metric, CASE WHEN missing_lanes <> '' AND sev < 3 THEN 'incomplete' ELSE worst END AS state,
  {_CONFIDENCE.format("conf")} AS confidence, value, sources_with_evidence, sources_fresh FROM rolled"""
)
def lane_rollup(spark, sf_dir):
    out = _assessed(spark, sf_dir, WIDE, lanes=4)
    confidence = assess.name_of(F.col("confidence_rank"), assess.CONFIDENCES)
    return out.select("link_id", text.metric_id().alias("metric"), "state", confidence.alias("confidence"), "value", "sources_with_evidence", "sources_fresh")


@query(_lanes_sql(20.0, 6) + _LANE_METRICS + " SELECT link_id, metric, missing_lanes FROM rolled")
def missing_lanes(spark, sf_dir):
    out = _assessed(spark, sf_dir, POLICY, lanes=4)
    return out.select("link_id", text.metric_id().alias("metric"), F.array_join("missing_lanes", ",").alias("missing_lanes"))


def _report_sql(dominates: bool) -> str:
    over = "clash" if dominates else "false"
    return f""", links AS (
  SELECT link_id, max(sev) AS sev, min(conf) AS conf, bool_or(state = 'conflicting') AS clash,
    CAST(sum(coalesce(with_evidence, 0)) AS BIGINT) AS considered, CAST(sum(coalesce(n_fresh, 0)) AS BIGINT) AS fresh
  FROM assessed JOIN ranks USING (state) GROUP BY link_id
) SELECT link_id, CASE WHEN {over} THEN 'conflicting' ELSE r.state END AS overall,
  {_CONFIDENCE.format(f"CASE WHEN {over} THEN 1 ELSE conf END")} AS confidence, considered AS evidence_considered, fresh AS evidence_fresh,
  considered > 0 AS evidence_present FROM links JOIN ranks r ON r.sev = links.sev"""


def _reported(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    out = assess.roll_up_links(_assessed(spark, sf_dir, policy), policy)
    return out.select("link_id", "overall", "confidence", "evidence_considered", "evidence_fresh", "evidence_present")


@query(_plain(1e9, 2000) + _report_sql(True))
def link_report(spark, sf_dir):
    return _reported(spark, sf_dir, WIDE)


@query(_plain(0.5, 2000) + _report_sql(True))
def link_report_conflict_dominates(spark, sf_dir):
    return _reported(spark, sf_dir, replace(STRICT, validity_ns=2000 * HOUR))


@query(_plain(20.0, 6) + f", old AS (SELECT * FROM assessed), {_cells_sql(1e9, 2000).replace('latest AS', 'latest2 AS').replace('FROM latest', 'FROM latest2').replace('latest2 AS (', 'latest2 AS (', 1).replace('fresh AS (', 'fresh2 AS (').replace('FROM fresh)', 'FROM fresh2)').replace('best AS (', 'best2 AS (').replace('FROM best ', 'FROM best2 ').replace('agg AS (', 'agg2 AS (').replace('JOIN agg a', 'JOIN agg2 a').replace('stepped AS (', 'stepped2 AS (').replace('FROM stepped s', 'FROM stepped2 s').replace('banded AS (', 'banded2 AS (').replace('FROM banded', 'FROM banded2').replace('assessed AS (', 'assessed2 AS (').replace('{authority}', '1')} SELECT o.link_id, o.metric, o.state AS before, n.state AS after FROM old o JOIN assessed2 n USING (link_id, metric) WHERE o.state <> n.state")
def policy_reclassify(spark, sf_dir):
    """The same evidence under two policies: what changes its state."""
    old, new = (_assessed(spark, sf_dir, p).select("link_id", text.metric_id().alias("metric"), "state") for p in (POLICY, WIDE))
    both = old.withColumnRenamed("state", "before").join(new.withColumnRenamed("state", "after"), ["link_id", "metric"])
    return both.where("before <> after").select("link_id", "metric", "before", "after")


# History.
def _window_sql(where: str, limit: int) -> str:
    return f"""WITH {_OBS}, {_GAUGES} SELECT event_id AS ordinal, link_id, source_id, metric, ns AS observed_ns
FROM g WHERE {where} ORDER BY event_id LIMIT {limit}"""


def _window(spark: SparkSession, sf_dir: str, q: history.WindowQuery) -> DataFrame:
    out = history.window(adapters.gauges(_events(spark, sf_dir)), q)
    return out.select("ordinal", "link_id", "source_id", text.metric_id().alias("metric"), "observed_ns")


_FROM, _TO = AS_OF - 480 * HOUR, AS_OF - 240 * HOUR
_SPAN = f"ns >= {_FROM} AND ns < {_TO}"


@query(_window_sql(f"{_SPAN} AND link_id = 'link-3'", 4096))
def window_observation_time(spark, sf_dir):
    return _window(spark, sf_dir, history.WindowQuery(from_ns=_FROM, to_ns=_TO, link=("link-3", 1), limit=4096))


@query(_window_sql(f"{_SPAN} AND metric = 'signal-ratio:snr'", 4096))
def window_receive_time(spark, sf_dir):
    return _window(spark, sf_dir, history.WindowQuery("receive-time", _FROM, _TO, metric=("signal-ratio", "snr"), limit=4096))


@query(_window_sql("source_id = 'src-1'", 500))
def window_source_filter(spark, sf_dir):
    return _window(spark, sf_dir, history.WindowQuery(source_id="src-1", limit=500))


@query(_window_sql("link_id = 'link-5'", 3))
def window_limit(spark, sf_dir):
    return _window(spark, sf_dir, history.WindowQuery(link=("link-5", 1), limit=3))


@query(
    f"""WITH {_OBS}, {_GAUGES} SELECT count(*) FILTER ({_SPAN}) AS matched, least(count(*) FILTER ({_SPAN}), 100) AS returned,
  count(*) FILTER ({_SPAN}) > 100 AS truncated, min(ns) AS earliest_ns, max(ns) AS latest_ns FROM g"""
)
def window_range(spark, sf_dir):
    return history.summary(adapters.gauges(_events(spark, sf_dir)), history.WindowQuery(from_ns=_FROM, to_ns=_TO, limit=100))


# The SQL knows no ring, so these have none and reach back to the instant in every stream, however long it is.
_PAST = AS_OF - 120 * HOUR


@query(
    f"""WITH {_OBS}, g AS (SELECT * FROM obs WHERE event_type <> 'error' AND ns <= {_PAST}), {_LATEST}
SELECT link_id, source_id, metric, event_id AS sequence FROM latest"""
)
def as_of_records(spark, sf_dir):
    rows = _fed(adapters.gauges(_events(spark, sf_dir)))
    out = assess.records_as_of(rows, POLICY, _PAST, adapters.EPOCH, size=None)
    return out.select("link_id", "source_id", text.metric_id().alias("metric"), "sequence")


@query(
    (_plain(20.0, 6) + _report_sql(True)).replace("g AS (SELECT * FROM obs WHERE event_type <> 'error')", f"g AS (SELECT * FROM obs WHERE event_type <> 'error' AND ns <= {_PAST})").replace(str(AS_OF), str(_PAST)).replace("link_ids AS (SELECT DISTINCT link_id FROM g)", "link_ids AS (SELECT DISTINCT link_id FROM obs WHERE event_type <> 'error')")
)
def as_of_report(spark, sf_dir):
    rows = _fed(adapters.gauges(_events(spark, sf_dir)))
    records = assess.records_as_of(rows, POLICY, _PAST, adapters.EPOCH, size=None)
    out = assess.roll_up_links(assess.assess(records, _views(spark, rows), POLICY, _PAST, adapters.EPOCH), POLICY)
    return out.select("link_id", "overall", "confidence", "evidence_considered", "evidence_fresh", "evidence_present")


# Inspection.
@query(
    _plain(20.0, 6) + """ SELECT link_id, metric, CAST(declared AS INTEGER) AS declared_sources, CAST(coalesce(n_fresh, 0) AS INTEGER) AS fresh_sources,
  coalesce(n_fresh, 0) > 0 AS has_fresh_evidence, CAST(coalesce(with_evidence - n_fresh, 0) AS INTEGER) AS stale_sources, coalesce(min_age, 0) AS newest_age_ns FROM assessed"""
)
def inspect_freshness(spark, sf_dir):
    out = inspection.freshness(_assessed(spark, sf_dir, POLICY))
    return out.select("link_id", text.metric_id().alias("metric"), "declared_sources", "fresh_sources", "has_fresh_evidence", "stale_sources", "newest_age_ns")


@query(f"WITH {_OBS}, {_GAUGES}, {_LATEST} SELECT link_id, metric, source_id, {AS_OF} - ns AS age_ns FROM latest WHERE {AS_OF} - ns > {6 * HOUR}")
def inspect_stale(spark, sf_dir):
    return inspection.stale(_assessed(spark, sf_dir, POLICY)).select("link_id", text.metric_id().alias("metric"), "source_id", "age_ns")


@query(_plain(0.5, 2000) + " SELECT link_id, metric, spread, 0.5::DOUBLE AS tolerance FROM assessed WHERE state = 'conflicting'")
def inspect_conflicts(spark, sf_dir):
    policy = replace(STRICT, validity_ns=2000 * HOUR)
    return inspection.conflicts(_assessed(spark, sf_dir, policy), policy).select("link_id", text.metric_id().alias("metric"), "spread", "tolerance")


# Generations: about five days each.
_GEN_NS = 5 * 24 * HOUR
_START = 1_704_067_200 * SECOND
_GENS = f"o AS (SELECT *, 1 + (ns - {_START}) // {_GEN_NS} AS gen FROM obs)"


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.gauges(_events(spark, sf_dir))
    return rows.withColumn("link_generation", F.expr(f"1 + (observed_ns - {_START}) DIV {_GEN_NS}"))


_REGISTRY = f"""WITH {_OBS.replace('FROM events', "FROM events WHERE event_type <> 'error'")}, {_GENS}, r AS (
  SELECT link_id, gen AS link_generation, min(event_id) AS first_ordinal, count(*) AS evidence_count FROM o GROUP BY 1, 2
)"""


@query(
    _REGISTRY + """ SELECT link_id, link_generation, first_ordinal, evidence_count, link_generation < max(link_generation) OVER (PARTITION BY link_id) AS superseded,
  CASE WHEN link_generation < max(link_generation) OVER (PARTITION BY link_id) THEN max(link_generation) OVER (PARTITION BY link_id) END AS superseded_by FROM r"""
)
def link_generations(spark, sf_dir):
    return links.registry(_generations(spark, sf_dir)).drop("current_generation")


@query(
    _REGISTRY + """, k AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY first_ordinal DESC) AS n FROM r)
SELECT o.link_id, o.gen AS link_generation, count(*) AS n FROM o JOIN k ON k.link_id = o.link_id AND k.link_generation = o.gen WHERE k.n <= 4 GROUP BY 1, 2"""
)
def generation_eviction(spark, sf_dir):
    return links.evict(_generations(spark, sf_dir), 4).groupBy("link_id", "link_generation").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_OBS.replace('FROM events', "FROM events WHERE event_type <> 'error'")}, o AS (
  SELECT *, 1 + (ns - {_START}) // {_GEN_NS} - CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS gen FROM obs
) SELECT event_id AS ordinal, coalesce(max(gen) OVER (PARTITION BY link_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > gen, false) AS fenced_generation FROM o"""
)
def fenced_generation(spark, sf_dir):
    rows = _generations(spark, sf_dir)
    late = F.when(F.col("ordinal") % 10 == 3, F.col("link_generation") - 1).otherwise(F.col("link_generation"))
    return links.fencing(rows.withColumn("link_generation", late)).select("ordinal", "fenced_generation")


# Capabilities.
@query(
    """SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'ok'), (1, 'duplicate'), (2, 'id-mismatch'), (3, 'fenced'), (4, 'ok'), (5, 'ok')) t(ordinal, status)"""
)
def capability_revisions(spark, sf_dir):
    a = (capability.Measures("signal-power", "rx.level", "dBm"),)
    b = (capability.Measures("signal-ratio", "snr", "dB"),)
    rows = [capability.Declaration("src-a", m, revision=r) for r, m in ((2, a), (2, a), (2, b), (1, a), (3, b))]
    rows.append(capability.Declaration("src-a", a, scope=("link-0", 1)))
    return capability.revisions(capability.declarations(spark, rows)).select("ordinal", "status")


@query(
    f"""WITH {_OBS}, {_GAUGES}, {_DECLARED} SELECT link_id, metric, CASE declared WHEN 3 THEN 'src-0@1,src-1@1,src-2@1' WHEN 1 THEN 'src-0@1' ELSE '' END AS declared_by,
  CASE declared WHEN 0 THEN 'src-2@1' ELSE '' END AS unsupported_by, CAST(CASE declared WHEN 3 THEN 4 ELSE 0 END AS INTEGER) AS lanes FROM cells"""
)
def capability_views(spark, sf_dir):
    rows = adapters.gauges(_events(spark, sf_dir))
    out = capability.view_summary(_declared(spark, 4), links.registry(rows))
    names = (F.array_join(c, ",").alias(c) for c in ("declared_by", "unsupported_by"))
    return out.select("link_id", text.metric_id().alias("metric"), *names, "lanes")


# Retention.
_NTH = "SELECT *, row_number() OVER (PARTITION BY link_id, source_id, metric ORDER BY event_id DESC) AS n FROM g"


@query(f"WITH {_OBS}, {_GAUGES}, k AS ({_NTH}) SELECT event_id AS ordinal FROM k WHERE n <= 64")
def stream_retention(spark, sf_dir):
    return retention.ring(adapters.gauges(_events(spark, sf_dir))).select("ordinal")


@query(f"WITH {_OBS}, {_GAUGES} SELECT event_id AS ordinal FROM g ORDER BY event_id DESC LIMIT 65536")
def global_retention(spark, sf_dir):
    return retention.history(adapters.gauges(_events(spark, sf_dir))).select("ordinal")


@query(
    f"""WITH {_COUNTERS}, {_DIRTY}, kept AS (SELECT * FROM fenced WHERE fence IN ('accepted', 'reordered')),
n AS (SELECT *, row_number() OVER (PARTITION BY link_no, src_no, event_type ORDER BY ord DESC) AS n,
  row_number() OVER (PARTITION BY link_no, src_no, event_type, fence ORDER BY seq DESC) AS f FROM kept),
u AS (SELECT *, row_number() OVER (PARTITION BY link_no, src_no, event_type, seq ORDER BY ord) AS d FROM n WHERE n <= 4 OR (fence = 'accepted' AND f = 1))
SELECT CAST(ord AS BIGINT) AS ordinal, CAST(seq AS BIGINT) AS sequence FROM u WHERE d = 1"""
)
def retained_records(spark, sf_dir):
    rows = fence.fenced(adapters.dirty_arrivals(_events(spark, sf_dir)), 8).where("fence IN ('accepted', 'reordered')")
    return retention.in_order(retention.retained(rows, 4)).select("ordinal", "sequence")


@query(
    f"""WITH {_OBS}, {_GAUGES}, {_LATEST} SELECT link_id, metric, CAST(0 AS INTEGER) AS sources_fresh, 'stale' AS state, 'recovered-evidence-only' AS reasons
FROM latest GROUP BY link_id, metric"""
)
def recovered_is_stale(spark, sf_dir):
    """Evidence of another epoch is never fresh, however young."""
    rows = _fed(adapters.gauges(_events(spark, sf_dir))).withColumn("origin", F.lit("recovered"))
    out = assess.assess(assess.current_records(rows, WIDE), _views(spark, rows), WIDE, AS_OF, adapters.EPOCH + 1)
    return out.where("sources_with_evidence > 0").select("link_id", text.metric_id().alias("metric"), "sources_fresh", "state", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {_COUNTERS} SELECT event_id AS ordinal, 'link-' || link_no || '/gen1' AS link, 'src-' || src_no || '@1' AS source, 'aggregate' AS lane,
  cv || CASE WHEN event_type = 'error' THEN ' bytes' ELSE ' count' END || ' (u32)' || CASE WHEN rst THEN ' reset-declared' ELSE '' END AS reading FROM counts"""
)
def evidence_rendering(spark, sf_dir):
    rows = adapters.counter_readings(_events(spark, sf_dir))
    return rows.select("ordinal", text.link().alias("link"), text.source().alias("source"), text.lane().alias("lane"), text.reading().alias("reading"))
