"""The engine over a stored log: what survives a restart and compaction, requests, limits, inspection and the command line."""

from dataclasses import fields, replace

import pytest
from pyspark.sql import functions as F
from test_assessment import RX, S, T0, gauges

from evidq import cli
from evidq.engine import Engine
from evidq.functions import rendering
from evidq.operators.history import WindowQuery
from evidq.plans.capability import Declaration, Measures
from evidq.plans.catalog import Refused
from evidq.plans.limits import RANGES, Limits
from evidq.plans.policy import DEFAULT, Rule, bands
from evidq.sources import adapters

SNR = Measures("signal-ratio", "snr", "dB")


def opened(spark, tmp_path, epoch=adapters.EPOCH, **more):
    return Engine.open(spark, str(tmp_path / "log"), epoch, **more)


def test_declarations_and_policies_survive(spark, tmp_path):
    low = replace(DEFAULT, id="low", rules=(Rule("signal-power", "rx.level", bands("x", (-30.0,), ("severe", "healthy"))),), unsupported=(("timing", "eye.width"),))
    e = opened(spark, tmp_path).declare(Declaration("src-a", (RX,), scope=("link-a", 1))).declare(Declaration("src-b", (RX, SNR), unsupported=(("timing", "eye.width"),))).publish(low)
    e.ingest(gauges(spark, [("src-a", 0, -20.0), ("src-b", 0, -20.25)])).collect()
    again = opened(spark, tmp_path)
    assert again.declared == e.declared and again.policies.kept == e.policies.kept and again.policy.generation == 2
    assert again.query(T0 + S).collect() == e.query(T0 + S).collect()
    e.compact()
    assert opened(spark, tmp_path).declared == e.declared
    assert opened(spark, tmp_path).query(T0 + S).collect() == e.query(T0 + S).collect()


def test_replay_after_compaction_is_known(spark, tmp_path):
    rows = gauges(spark, [("src-a", i, -3.0) for i in range(200)])
    e = opened(spark, tmp_path).declare(Declaration("src-a", (RX,)))
    e.ingest(rows).collect()
    e.compact()
    assert e.log.read().count() == 64 and e.log.read("dedup-window").count() == 136
    assert e.registry().first().evidence_count == 200
    e.ingest(rows.withColumn("ordinal", F.col("ordinal") + 1000)).collect()
    fates = {r.name: r.n for r in e.statistics().collect()}
    assert fates["fence-duplicate"] == 200 and fates["fence-accepted"] == 64 and "fence-reordered" not in fates
    assert (fates["links"], fates["streams"], fates["records"], fates["declarations"]) == (1, 1, 64, 1)
    e.compact()
    e.ingest(rows.withColumn("ordinal", F.col("ordinal") + 2000)).collect()
    assert {r.name: r.n for r in e.statistics().collect()}["fence-duplicate"] == 200
    assert e.log.verify().first().kinds_known and e.log.unknown_kinds() == []


def test_requests(spark, tmp_path):
    laned = Measures("signal-power", "tx.level", "dBm", lanes_declared=True, lane_count=2)
    policy = replace(DEFAULT, unsupported=(("timing", "latency.roundtrip"),))
    e = opened(spark, tmp_path, policy=policy).declare(Declaration("src-a", (RX, laned)))
    rows = gauges(spark, [("src-a", 0, -3.0), ("src-a", 0, -3.0)])
    rows = rows.withColumns({"name": F.when(F.col("ordinal") == 1, "tx.level").otherwise(F.col("name")), "lane": F.when(F.col("ordinal") == 1, 1).cast("int")})
    e.ingest(rows).collect()
    asked = [("timing", "latency.roundtrip"), ("signal-power", "rx.level"), ("timing", "jitter.packet-delay"), ("signal-power", "rx.level")]
    got = {r.name: (r.state, r.reasons) for r in e.metrics(T0 + S, [("link-a", 1)], asked).collect()}
    assert got == {
        "rx.level": ("healthy", ["band-matched"]), "latency.roundtrip": ("unsupported", ["declared-unsupported"]),
        "jitter.packet-delay": ("unsupported", ["metric-not-declared"]),
    }
    lane = e.metrics(T0 + S, [("link-a", 1)], [("signal-power", "tx.level")], lane=0).first()
    assert (lane.state, lane.reasons, lane.lanes) == ("unknown", ["no-evidence"], 0)
    scoped = opened(spark, tmp_path / "b").declare(Declaration("src-a", (RX,), scope=("link-a", 1)))
    row = scoped.query(T0, [("link-x", 1)]).first()
    assert (row.overall, row.confidence, row.reasons, row.link_registered) == ("unsupported", "none", ["link-not-registered", "no-sources-for-link"], False)
    assert "no-sources-for-link" in scoped.explain("link-x", T0)
    two = e.declare(Declaration("src-a", (replace(RX, validity_ns=9),), scope=("link-a", 1)))
    row = two.metrics(T0 + S, metrics=[("signal-power", "rx.level")]).first()
    assert (row.sources_declared, row.sources_with_evidence, row.sources_fresh) == (2, 1, 1)


def test_history_report_is_of_its_instant(spark, tmp_path):
    e = opened(spark, tmp_path).declare(Declaration("src-a", (RX,)))
    e.ingest(gauges(spark, [("src-a", 0, -3.0), ("src-a", 20, -13.0)])).collect()
    then, now = (WindowQuery(link=("link-a", 1), metric=("signal-power", "rx.level"), as_of_ns=t) for t in (T0 + 10 * S, 0))
    assert e.history_report(then, T0 + 21 * S).first().overall == "healthy"
    assert e.history_report(now, T0 + 21 * S).first().overall == "degraded"
    with pytest.raises(Refused):
        e.history_report(WindowQuery(link=("link-a", 1), as_of_ns=T0 + 99 * S), T0 + 21 * S)


def test_limits(spark, tmp_path):
    assert {f.name for f in fields(Limits)} == {*RANGES, "observation_age_ns"} and Limits().check() == Limits()
    for bad in [{n: low - 1} for n, (low, _) in RANGES.items()] + [{n: high + 1} for n, (_, high) in RANGES.items()] + [{"observation_age_ns": -1}, {"dedup_window": 63}]:
        with pytest.raises(Refused):
            Limits(**bad).check()
    e = opened(spark, tmp_path, limits=Limits(links=2, streams_per_link=1, declarations=2, generations_per_link=1)).declare(Declaration("src-a", (RX,))).declare(Declaration("src-b", (RX,)))
    with pytest.raises(Refused):
        e.declare(Declaration("src-c", (RX,)))
    rows = gauges(spark, [("src-a", i, -3.0) for i in range(3)]).withColumn("link_id", F.concat(F.lit("link-"), F.col("ordinal")))
    assert e.ingest(rows).first()[:] == (3, 2, 1, "limit-exceeded")
    later = rows.withColumns({"ordinal": F.col("ordinal") + 10, "sequence": F.col("sequence") + 10})
    assert e.ingest(later).first()[:] == (3, 2, 1, "limit-exceeded")
    other = later.withColumns({"source_id": F.lit("src-b"), "ordinal": F.col("ordinal") + 10})
    assert e.ingest(other).first().accepted == 0
    newer = later.where("link_id = 'link-0'").withColumns({"link_generation": F.lit(2).cast("long"), "ordinal": F.col("ordinal") + 30})
    assert e.ingest(newer).first().accepted == 1
    assert [r.link_generation for r in e.evidence([("link-0", 2)]).collect()] == [2]


def test_inspection_says_what_it_left_out(spark, tmp_path):
    e = opened(spark, tmp_path, limits=Limits(inspection_entries=2)).declare(Declaration("src-a", (RX, SNR)))
    e.ingest(gauges(spark, [("src-a", i, -3.0) for i in range(3)]).withColumn("link_id", F.concat(F.lit("link-"), F.col("ordinal")))).collect()
    parts = {k: v.collect() for k, v in e.inspect(T0 + 30 * S).items()}
    assert [(r.link_id, r.name) for r in parts["freshness"]] == [("link-0", "rx.level"), ("link-0", "snr")] and len(parts["stale"]) == 2
    assert parts["left_out"][0][:] == (3, 3, True)
    assert "links 3, entries dropped 3, truncated" in rendering.inspection(parts) and "evidence-expired" in rendering.inspection(parts)


def test_command_line(spark, tmp_path, capsys):
    log = ["--log", str(tmp_path / "cli"), "--now", str(T0 + 9 * S)]
    for args in (["emit", "--count", "10"], ["query", "--json", "--link", "link-a", "--metric", "signal-power:rx.level"], ["explain", "link-a"], ["inspect"], ["metrics"], ["policy"], ["log-verify"], ["log-dump"]):
        assert cli.main([*log, *args]) == 0
    out = capsys.readouterr().out
    assert '"overall":"degraded"' in out or '"overall":"marginal"' in out
    assert "rx.level" in out and "policy default generation 1" in out
