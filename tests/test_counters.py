"""Counter continuity: expected steps, and the lag form against the whole machine."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidq.operators import counters
from evidq.plans.policy import DEFAULT

SECOND = 1_000_000_000
CONFIG = (SECOND, True, {"u32": (3221225472, 1073741824), "u64": (13835058055282163711, 4611686018427387903)})


def reading(value, at=0, seq=1, width="u64", reset=False, incarnation=1, generation=1):
    return {"value": value, "width": width, "observed_ns": at, "sequence": seq, "incarnation": incarnation, "generation": generation, "reset": reset}


def run(*readings, config=CONFIG):
    m = counters.Continuity()
    return [m.step(r, *config) for r in readings]


CASES = [
    ("advance", [reading(100, 0, 1), reading(175, SECOND, 2)], "advance", 75),
    ("equal", [reading(500, 0, 1), reading(500, 1, 2)], "advance", 0),
    ("decrease", [reading(10**6, 0, 1), reading(5, 1, 2)], "decrease-unproven", None),
    ("after a decrease", [reading(10**6, 0, 1), reading(5, 1, 2), reading(9, 2, 3)], "advance", 4),
    ("wrap u32", [reading(2**32 - 10, 0, 1, "u32"), reading(5, 1, 2, "u32")], "wrap", 15),
    ("no wrap from below the ceiling", [reading(10_000, 0, 1, "u32"), reading(4, 1, 2, "u32")], "decrease-unproven", None),
    ("no wrap to above the floor", [reading(2**32 - 10, 0, 1, "u32"), reading(2**31, 1, 2, "u32")], "decrease-unproven", None),
    ("no wrap without width", [reading(2**32 - 10, 0, 1, "unspecified"), reading(5, 1, 2, "unspecified")], "decrease-unproven", None),
    ("wrap u64", [reading(2**64 - 4, 0, 1), reading(5, 1, 2)], "wrap", 9),
    ("reset", [reading(900_000, 0, 1), reading(0, 1, 2, reset=True)], "reset", None),
    ("after a reset", [reading(900_000, 0, 1), reading(0, 1, 2, reset=True), reading(12, 2, 3)], "advance", 12),
    ("width change", [reading(1, 0, 1, "u32"), reading(2, 1, 2, "u64")], "width-changed", None),
    ("out of range", [reading(0x1FFFFFFFF, 0, 1, "u32")], "out-of-range", None),
    ("baseline lost", [reading(1, 0, 1, "u32"), reading(2**33, 1, 2, "u32"), reading(7, 2, 3, "u32")], "baseline", None),
    ("regression keeps the baseline", [reading(10, 0, 10), reading(90, 1, 9), reading(50, 2, 11)], "advance", 40),
    ("regression", [reading(10, 0, 10), reading(90, 1, 9)], "sequence-regressed", None),
    ("incarnation", [reading(10, 0, 1), reading(20, 1, 2, incarnation=2)], "source-reincarnated", None),
    ("generation", [reading(10, 0, 1), reading(20, 1, 2, generation=2)], "link-generation-changed", None),
]


@pytest.mark.parametrize("readings,event,delta", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_machine(readings, event, delta):
    last = run(*readings)[-1]
    assert (last["event"], last["delta"]) == (event, delta)


def test_gap_and_missing():
    last = run(reading(0, 0, 10), reading(300, 60 * SECOND, 15))[-1]
    assert last["spans_gap"] and not last["rate_admissible"] and last["missing"] == 4
    back = run(reading(0, 10 * SECOND, 1), reading(3, SECOND, 2))[-1]
    assert back["delta"] == 3 and back["elapsed_ns"] == 0 and back["spans_gap"]


def test_a_delta_comes_with_advance_or_wrap_only():
    rng = random.Random(5)
    for _ in range(60):
        m, seq, at, value = counters.Continuity(), 0, 0, 0
        for _ in range(60):
            seq += rng.randint(-1, 3)
            at += rng.randint(0, 3) * SECOND
            value = rng.randrange(2**32) if rng.random() < 0.2 else (value + rng.randrange(1000)) % 2**32
            step = m.step(reading(value, at, seq, "u32", rng.random() < 0.05, 1 + (rng.random() < 0.08)), *CONFIG)
            assert (step["delta"] is not None) == (step["event"] in ("advance", "wrap"))


def rows(spark, n=400, seed=1):
    rng, out, values = random.Random(seed), [], {}
    for i in range(n):
        s = f"src-{rng.randrange(3)}"
        seq, at, v = values.get(s, (0, 0, 2**32 - 5000))
        seq, at = seq + rng.randint(1, 3), at + rng.randint(-1, 4) * SECOND
        v = rng.randrange(2**32) if rng.random() < 0.15 else (v + rng.randrange(3000)) % 2**32
        values[s] = (seq, at, v)
        out.append((i, "link-a", 1, s, 1, seq, "error-counter", "errors.symbol", None, Decimal(v), "u32", rng.random() < 0.05, at))
    schema = (
        "ordinal long, link_id string, link_generation long, source_id string, source_incarnation long, sequence long, family string, name string, "
        "lane int, counter_value decimal(20,0), counter_width string, reset_declared boolean, observed_ns long"
    )
    return spark.createDataFrame(out, schema)


def test_lag_form_is_the_machine(spark):
    policy = DEFAULT.with_rules(wrap=True, gap_ns=2 * SECOND)
    data = counters.with_rules(rows(spark), policy)
    names = ["ordinal", "event", "reason", "delta", "elapsed_ns", "spans_gap", "from_wrap", "rate_admissible", "missing"]
    a = {r.ordinal: r for r in counters.steps(data).select(names).collect()}
    b = {r.ordinal: r for r in counters.machine_steps(data, counters.STREAM).select(names).collect()}
    assert len(a) == 400 and {r.event for r in a.values()} >= {"advance", "wrap", "reset", "decrease-unproven", "baseline"}
    assert a == b


def test_rate(spark):
    out = spark.createDataFrame([(Decimal(10), 2_000_000), (Decimal(10), 500), (Decimal(1), None)], "delta decimal(20,0), elapsed_ns long")
    assert [r[0] for r in out.select(counters.rate_per_second()).collect()] == [5000.0, None, None]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    data = counters.with_rules(rows(spark, 100), DEFAULT)
    want = counters.steps(data).agg(F.sum(F.xxhash64("ordinal", "event", "delta").cast("decimal(38,0)"))).first()[0]
    assert counters.steps(data.repartition(parts)).agg(F.sum(F.xxhash64("ordinal", "event", "delta").cast("decimal(38,0)"))).first()[0] == want
