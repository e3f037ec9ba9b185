"""Policies, catalogs and declarations as documents; text of numbers."""

import math
from dataclasses import replace

import pytest

from evidq.functions.text import number
from evidq.operators import links
from evidq.plans import capability
from evidq.plans.capability import Declaration, Measures
from evidq.plans.catalog import Catalog, Metric, Refused
from evidq.plans.policy import DEFAULT, Band, History, Policy, Rule, bands, check_policy

GOOD = bands("b", (0.0,), ("severe", "healthy"))
INF = math.inf


def rx(*b, **more):
    return Policy(rules=(Rule("signal-power", "rx.level", tuple(b), **more),))


BAD = [
    (rx(Band("a", -INF, 0, "severe"), Band("b", 1, None, "healthy")), "invalid"),
    (rx(Band("a", -INF, 2, "severe"), Band("b", 1, None, "healthy")), "invalid"),
    (rx(Band("a", -INF, 2, "severe")), "invalid"),
    (rx(Band("a", 0, None, "severe")), "invalid"),
    (rx(Band("a", math.nan, None, "severe")), "invalid"),
    (rx(*GOOD, tolerance=-1.0), "invalid"),
    (rx(*GOOD, tolerance=math.nan), "invalid"),
    (rx(*GOOD, floor=0.8), "invalid"),
    (rx(*GOOD, basis="counter-delta"), "invalid"),
    (rx(), "invalid"),
    (Policy(rules=(Rule("signal-power", "no.such", GOOD),)), "unsupported"),
    (Policy(rules=(Rule("signal-power", "rx.level", GOOD),) * 2), "invalid"),
    (replace(rx(*GOOD), unsupported=(("signal-power", "rx.level"),)), "conflict"),
    (replace(DEFAULT, severity=DEFAULT.severity[:-1]), "invalid"),
    (replace(DEFAULT, validity_ns=0), "invalid"),
]


@pytest.mark.parametrize("policy,code", BAD)
def test_refused_policies(policy, code):
    with pytest.raises(Refused) as e:
        check_policy(policy, Catalog())
    assert e.value.code == code


def test_hash_follows_content_not_order():
    turned = replace(DEFAULT, rules=DEFAULT.rules[::-1])
    assert check_policy(DEFAULT, Catalog()).content_hash == turned.content_hash != replace(DEFAULT, gap_ns=1).content_hash
    h = History()
    for _ in range(10):
        h = h.publish(DEFAULT)
    assert [p.generation for p in h.kept] == list(range(3, 11))


def test_catalog():
    more = Catalog().with_metric(Metric("timing", "skew", "ps"))
    assert len(more.metrics) == 18
    for metric, code in ((Metric("timing", "skew", "ps"), "duplicate"), (Metric("timing", "skew", "ns"), "conflict"), (Metric("timing", "Skew", "ns"), "invalid")):
        with pytest.raises(Refused) as e:
            more.with_metric(metric)
        assert e.value.code == code


def test_declarations(spark):
    rx_, snr = (Measures("signal-power", "rx.level", "dBm"),), (Measures("signal-ratio", "snr", "dB"),)
    rows = [Declaration("a", rx_, revision=2), Declaration("a", rx_, revision=2), Declaration("a", snr, revision=2), Declaration("a", rx_), Declaration("a", snr, revision=3)]
    out = capability.revisions(capability.declarations(spark, rows)).orderBy("ordinal").collect()
    assert [r.status for r in out] == ["ok", "duplicate", "id-mismatch", "fenced", "ok"]
    with pytest.raises(Refused):
        capability.declarations(spark, [Declaration("a", rx_, unsupported=(("signal-power", "rx.level"),))])


def test_gate_looks_at_the_first_declaration_only(spark):
    rx_, snr = (Measures("signal-power", "rx.level", "dBm"),), (Measures("signal-ratio", "snr", "dB"),)
    declared = capability.declarations(spark, [Declaration("a", snr, scope=("l", 1)), Declaration("a", rx_)])
    on = spark.createDataFrame([("l", 1)], "link_id string, link_generation long")
    assert [r.name for r in capability.gate(declared, on).collect()] == ["rx.level"]
    assert capability.view_summary(declared, on).count() == 2


def test_generations(spark):
    rows = spark.createDataFrame([(i, "l", g) for i, g in enumerate((1, 2, 3, 4, 5))], "ordinal long, link_id string, link_generation long")
    assert sorted(r.link_generation for r in links.kept_generations(rows, 2).where("evicted").collect()) == [1, 2, 3]
    assert links.registry(rows).where("superseded").count() == 4


@pytest.mark.parametrize("value,text", [(-3.0, "-3.0"), (1e21, "1e+21"), (100000.0, "1e+05"), (0.0, "0.0"), (0.001, "0.001"), (1234.5, "1234.5"), (1e-7, "1e-07"), (-INF, "-inf")])
def test_number(value, text):
    assert number(value) == text
