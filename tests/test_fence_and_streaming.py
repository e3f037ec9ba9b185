"""The replay fence against a row-at-a-time model, and the streaming processor against batch."""

import random

from pyspark.sql import functions as F

from evidq.operators import admission, counters, fence
from evidq.plans.policy import DEFAULT
from evidq.sources import adapters
from evidq.streaming import continuity


def test_fence_is_the_model(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), max(1, i // 3 + rng.randint(-14, 3)), rng.choice("ab") if rng.random() < 0.3 else "a") for i in range(900)]
    data = spark.createDataFrame(rows, "ordinal long, k int, sequence long, d string")
    got = {r.ordinal: r.fence for r in fence.fenced(data, 8, ["k"], "d").collect()}
    models = {k: continuity.StreamState(8) for k in (0, 1)}
    want = {i: models[k].admit(s, d) for i, k, s, d in rows}
    assert got == want and set(want.values()) == {"accepted", "reordered", "duplicate", "id-mismatch", "fenced"}


def test_distance_of_exactly_the_window(spark):
    """A repeat just as far behind as the window is wide is forgotten, but not fenced: it comes in again as reordered."""
    rows = [(0, 1, "a"), (1, 9, "b"), (2, 1, "a"), (3, 10, "c"), (4, 1, "a")]
    out = fence.fenced(spark.createDataFrame([(i, 0, s, d) for i, s, d in rows], "ordinal long, k int, sequence long, d string"), 8, ["k"], "d")
    assert [r.fence for r in out.orderBy("ordinal").collect()] == ["accepted", "accepted", "reordered", "accepted", "fenced"]


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    policy = DEFAULT.with_rules(wrap=True)
    arrivals = adapters.dirty_arrivals(spark.read.parquet(f"{sf_dir}/events.parquet"))
    cuts = arrivals.approxQuantile("ordinal", [0.33, 0.66], 0)
    edges = [float("-inf"), *cuts, float("inf")]
    for i in range(3):  # one file a micro-batch, in order
        part = arrivals.where((F.col("ordinal") > edges[i]) & (F.col("ordinal") <= edges[i + 1]))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = continuity.continuity(stream, policy, 8).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    out.option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = fence.fenced(arrivals, 8)
    assert {r.ordinal: r.fence for r in got.collect()} == {r.ordinal: r.fence for r in batch.collect()}
    names = ["ordinal", "event", "delta", "elapsed_ns", "spans_gap", "rate_admissible", "missing"]
    steps = counters.steps(counters.with_rules(batch.where("fence = 'accepted'"), policy)).select(names)
    assert sorted(map(tuple, got.where("event IS NOT NULL").select(names).collect())) == sorted(map(tuple, steps.collect()))


def test_limit_on_links_ranks_no_key_in_one_task(spark):
    keys = ["a", None, "b", "a", "c", "d", None, "d", "b"]
    rows = [(i, k, "invalid" if i == 4 else "ok") for i, k in enumerate(keys)]
    data = spark.createDataFrame(rows, "ordinal long, link_id string, status_code string").repartition(3)
    out = admission.limit_firsts(data, ["link_id"], [], 2)
    want = ["ok", "ok", "limit-exceeded", "ok", "invalid", "limit-exceeded", "ok", "limit-exceeded", "limit-exceeded"]
    assert [r.status_code for r in out.orderBy("ordinal").collect()] == want
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_arrivals_with_one_ordinal_come_in_a_fixed_order(spark):
    """Of two arrivals at once the smaller sequence is first, in whatever order they are read; streaming says the same."""
    rows = [(0, 1, "a"), (1, 2, "a"), (2, 8, "a"), (3, 10, "a"), (3, 2, "b"), (4, 3, "b"), (4, 3, "a")]
    want = {(3, 2, "b"): "id-mismatch", (3, 10, "a"): "accepted", (4, 3, "a"): "reordered", (4, 3, "b"): "id-mismatch"}
    for shown in (rows, rows[::-1]):
        data = spark.createDataFrame([(o, 0, s, d) for o, s, d in shown], "ordinal long, k int, sequence long, d string").coalesce(1)
        got = {(r.ordinal, r.sequence, r.d): r.fence for r in fence.fenced(data, 8, ["k"], "d").collect()}
        assert {x: got[x] for x in want} == want
    model = continuity.StreamState(8)
    assert {x: model.admit(*x[1:]) for x in sorted(rows)} == got
