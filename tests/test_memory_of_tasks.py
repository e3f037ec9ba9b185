"""What tasks hold of long streams: only columns that are asked for, and one bounded micro-batch."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidq.functions.vocabulary import STREAM
from evidq.operators import retention
from evidq.plans import checks
from evidq.sources import adapters


def test_retained_carries_no_column_that_is_not_asked_for(spark, sf_dir, tmp_path):
    rows = adapters.gauges(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("fence", F.when(F.col("ordinal") % 50 < 45, "accepted").otherwise("reordered"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    kept = retention.retained(rows, 2)
    assert kept.columns == rows.columns
    thin = kept.select("ordinal")
    assert "producer" not in thin._jdf.queryExecution().executedPlan().toString()
    streams: dict[tuple, list] = {}
    for r in rows.orderBy("ordinal").collect():
        streams.setdefault(tuple(r[c] for c in STREAM), []).append(r)
    want = set()
    for each in streams.values():
        want |= {r.ordinal for r in each[-2:]} | {max((r for r in each if r.fence == "accepted"), key=lambda r: r.sequence).ordinal}
    assert {r.ordinal for r in thin.collect()} == want and len(want) > 2 * len(streams)


def test_stream_in_many_bounded_batches(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "_EVENTS_A_BATCH", 200)
    folders = checks._slices(spark, spark.read.parquet(f"{sf_dir}/events.parquet"), str(tmp_path / "spans"))
    spans = [spark.read.parquet(f).agg(F.min("ordinal"), F.max("ordinal"), F.count("*")).first() for f in folders]
    assert len(spans) == 5 and max(s[2] for s in spans) < 400
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    got = entry.queries()["streaming_counter_steps"](spark, sf_dir)
    want = con.execute(entry.oracle_sql()["streaming_counter_steps"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
