"""Assessment of small fixtures: freshness, conflicts, authority, lanes, recovery, as-of and extremes."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evidq.engine import Engine
from evidq.operators import assess, retention
from evidq.operators.history import WindowQuery
from evidq.plans import suite
from evidq.plans.capability import Declaration, Measures
from evidq.plans.catalog import Refused
from evidq.plans.policy import DEFAULT, Policy, Rule, bands
from evidq.sources import adapters

S = 1_000_000_000
T0 = 1_700_000_000 * S
RX = Measures("signal-power", "rx.level", "dBm")
UNC = Measures("error-counter", "errors.uncorrectable", "count", "counter", "u64")


def gauges(spark, rows):
    """rows: (source, seconds, value[, authority])"""
    out = []
    for i, r in enumerate(rows):
        source, at, value, authority = (*r, 1)[:4]
        out.append((i, source, T0 + int(at * S), float(value), authority))
    base = adapters.generated(spark, 1).drop("ordinal", "source_id", "observed_ns", "received_wall_ns", "received_steady_ns", "gauge_value", "authority", "sequence")
    data = spark.createDataFrame(out, "ordinal long, source_id string, observed_ns long, gauge_value double, authority long")
    data = data.withColumns({"sequence": F.col("ordinal") + 1, "received_wall_ns": F.col("observed_ns"), "received_steady_ns": F.col("observed_ns")})
    return data.join(F.broadcast(base)).select(adapters.COLUMNS)


def engine(spark, tmp_path, rows, *, sources=("src-a", "src-b"), policy=DEFAULT, epoch=adapters.EPOCH, metrics=(RX,)):
    e = Engine.open(spark, str(tmp_path / "log"), epoch, policy)
    for s in sources:
        e = e.declare(Declaration(s, metrics))
    e.ingest(rows).collect()
    return e


def rx(e, seconds, past=False):
    return e.metrics(T0 + int(seconds * S), past=past).where("name = 'rx.level'").first()


def test_healthy_then_stale(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", 0, -3.0)]))
    fresh, old = rx(e, 5), rx(e, 16)
    assert (fresh.state, fresh.value, fresh.rules) == ("healthy", -3.0, ["rx-level-healthy"])
    assert (old.state, old.value, old.reasons) == ("stale", None, ["evidence-expired"])


def test_conflict_and_authority(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", 0, -3.0), ("src-b", 0, -13.0)]))
    row = rx(e, 1)
    assert (row.state, row.disagreement, row.value, row.sources_conflicting) == ("conflicting", 10.0, None, 2)
    assert e.query(T0 + S).first().overall == "conflicting"
    e = engine(spark, tmp_path / "b", gauges(spark, [("src-a", 0, -3.0, 1), ("src-b", 0, -13.0, 5)]))
    row = rx(e, 1)
    assert (row.state, row.value, row.reasons) == ("degraded", -13.0, ["lower-authority-ignored", "band-matched"])


def test_tolerance_gives_high_confidence(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", 0, -3.0), ("src-b", 0, -4.5)]), policy=DEFAULT.with_rules(tolerance=2.0))
    row = rx(e, 1)
    assert (row.state, row.confidence_rank, row.value) == ("healthy", 3, -3.0)


def test_stale_peer_is_ignored(spark, tmp_path):
    row = rx(engine(spark, tmp_path, gauges(spark, [("src-a", 0, -13.0), ("src-b", 30, -3.0)])), 31)
    assert (row.state, row.sources_fresh, row.sources_with_evidence) == ("healthy", 1, 2)


def test_as_of(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", 0, -3.0), ("src-a", 20, -13.0)]))
    assert rx(e, 10, past=True).state == "healthy"
    assert rx(e, 21, past=True).state == "degraded"


def test_as_of_queries_have_no_ring(spark, sf_dir, monkeypatch):
    """However many arrivals follow the instant, none of those before it is cut off."""
    rows = spark.createDataFrame([(i, 0) for i in range(9)], "ordinal long, k int")
    assert retention.ring(rows, None, ["k"]).count() == 9 and retention.ring(rows, 4, ["k"]).count() == 4
    sizes = []
    monkeypatch.setattr(assess, "ring", lambda evidence, size: sizes.append(size) or retention.ring(evidence, size))
    suite.QUERIES["as_of_records"](spark, sf_dir)
    suite.QUERIES["as_of_report"](spark, sf_dir)
    assert sizes == [None, None]


def test_recovered_is_never_fresh(spark, tmp_path):
    engine(spark, tmp_path, gauges(spark, [("src-a", 0, -3.0)]))
    later = Engine.open(spark, str(tmp_path / "log"), 99).declare(Declaration("src-a", (RX,)))
    row = rx(later, 1)
    assert (row.state, row.reasons, row.sources_fresh) == ("stale", ["recovered-evidence-only"], 0)
    assert later.query(T0).first().evidence_recovered == 1


def test_rate_needs_two_readings(spark, tmp_path):
    rows = gauges(spark, [("src-a", 0, 0), ("src-a", 1, 0), ("src-a", 40, 0)])
    rows = rows.withColumns(
        {"family": F.lit("error-counter"), "name": F.lit("errors.uncorrectable"), "unit": F.lit("count"), "semantics": F.lit("counter"), "gauge_value": F.lit(None).cast("double"),
         "counter_value": F.when(F.col("ordinal") == 2, 5).otherwise(0).cast("decimal(20,0)"), "counter_width": F.lit("u64")}
    )
    states = []
    for n, at in ((1, 0), (2, 1), (3, 40)):
        e = engine(spark, tmp_path / str(n), rows.where(f"ordinal < {n}"), metrics=(UNC,), sources=("src-a",))
        states.append(e.metrics(T0 + at * S).first())
    assert [r.state for r in states] == ["incomplete", "healthy", "incomplete"]
    assert states[0].reasons == ["counter-baseline-only"] and states[1].rate_per_second == 0.0
    assert states[2].interval_rate_per_second == pytest.approx(5 / 39)


def test_missing_lanes(spark, tmp_path):
    laned = Measures("signal-power", "rx.level", "dBm", lanes_declared=True, lane_count=3)
    rows = gauges(spark, [("src-a", 0, -3.0), ("src-a", 0, -9.0)]).withColumn("lane", F.col("ordinal").cast("int"))
    row = rx(engine(spark, tmp_path, rows, metrics=(laned,), sources=("src-a",)), 1)
    assert (row.state, row.missing_lanes, row.value) == ("marginal", [2], -9.0)
    assert {"missing-lanes", "no-evidence"} <= set(row.reasons)
    rows = rows.withColumn("gauge_value", F.lit(-3.0))
    row = rx(engine(spark, tmp_path / "b", rows, metrics=(laned,), sources=("src-a",)), 1)
    assert row.state == "incomplete" and "lane-coverage-partial" in row.reasons


@pytest.mark.parametrize("value,state", [(0.0, "marginal"), (9.999999, "marginal"), (10.0, "healthy"), (-1e-6, "severe"), (5e-324, "marginal")])
def test_band_edges(spark, tmp_path, value, state):
    rule = Rule("signal-power", "rx.level", bands("m", (0.0, 10.0), ("severe", "marginal", "healthy")))
    assert rx(engine(spark, tmp_path, gauges(spark, [("src-a", 0, value)]), policy=Policy(rules=(rule,))), 1).state == state


def test_no_rule_and_not_finite(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", 0, -3.0)]), policy=Policy(rules=()))
    assert (rx(e, 1).state, rx(e, 1).reasons) == ("unknown", ["no-rule-for-metric"])
    bad = gauges(spark, [("src-a", 0, "nan"), ("src-a", 1, "inf"), ("src-a", 2, "-inf")])
    out = e.admit(bad).select("status_code").distinct().collect()
    assert [r[0] for r in out] == ["invalid"]


def test_republishing_reassesses_the_same_evidence(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", 0, -20.0)]))
    assert rx(e, 1).state == "severe"
    e = e.publish(replace(DEFAULT, rules=(Rule("signal-power", "rx.level", bands("x", (-30.0,), ("severe", "healthy"))),)))
    assert (rx(e, 1).state, e.policy.generation) == ("healthy", 2)


def test_window(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", i, -3.0) for i in range(10)]))
    rows, _ = e.history(WindowQuery(from_ns=T0 + S, to_ns=T0 + 5 * S))
    assert rows.count() == 4
    rows, about = e.history(WindowQuery(limit=3))
    assert [r.ordinal for r in rows.collect()] == [0, 1, 2]
    assert about.first()[:3] == (10, 3, True)
    with pytest.raises(Refused):
        e.history(WindowQuery(limit=0))
    with pytest.raises(Refused):
        e.history(WindowQuery(from_ns=2, to_ns=2))


def test_explain_compact_verify(spark, tmp_path):
    e = engine(spark, tmp_path, gauges(spark, [("src-a", i, -3.0) for i in range(100)]))
    assert "rx.level healthy" in e.explain("link-a", T0 + 100 * S)
    assert e.log.verify().first().unique
    e.compact()
    assert e.log.read().count() == 64 and rx(e, 100).state == "healthy"
