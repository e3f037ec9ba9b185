"""Command line: emit, query, explain, inspect, metrics, policy, log-verify and log-dump on a stored log."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine
from .functions import rendering
from .functions.vocabulary import SECOND
from .plans.capability import Declaration, Measures
from .plans.catalog import Catalog
from .sources import adapters


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidq", description=__doc__)
    p.add_argument("--log", default="evidq-log", help="folder of the event log")
    p.add_argument("--epoch", type=int, default=adapters.EPOCH)
    p.add_argument("--now", type=int, default=1_700_000_000 * SECOND, help="the instant to assess, in nanoseconds")
    sub = p.add_subparsers(dest="command", required=True)
    emit = sub.add_parser("emit")
    emit.add_argument("--count", type=int, default=10)
    emit.add_argument("--link", default="link-a")
    for name in ("query", "explain", "inspect", "metrics", "policy", "log-verify", "log-dump"):
        one = sub.add_parser(name)
        if name == "explain":
            one.add_argument("link")
        if name == "query":
            one.add_argument("--json", action="store_true")
            one.add_argument("--link", help="only this link, seen or not")
            one.add_argument("--generation", type=int, default=1)
            one.add_argument("--metric", action="append", help="family:name; may be given again")
            one.add_argument("--lane", type=int)
        if name == "log-dump":
            one.add_argument("--limit", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("evidq").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rx = Measures("signal-power", "rx.level", "dBm")
    engine = Engine.open(spark, a.log, a.epoch).declare(Declaration("src-a", (rx,)))
    if a.command == "emit":
        engine.ingest(adapters.generated(spark, a.count, a.link)).show()
    elif a.command == "query":
        out = engine.query(a.now, a.link and [(a.link, a.generation)], a.metric and [tuple(m.split(":", 1)) for m in a.metric], a.lane)
        print("\n".join(out.toJSON().collect())) if a.json else out.show(truncate=False)
    elif a.command == "explain":
        print(engine.explain(a.link, a.now))
    elif a.command == "inspect":
        print(rendering.inspection({k: v.collect() for k, v in engine.inspect(a.now).items()}))
    elif a.command == "metrics":
        Catalog().scan(spark).show(100, truncate=False)
    elif a.command == "policy":
        print(rendering.policy(engine.policy))
    elif a.command == "log-verify":
        engine.log.verify().show()
    else:
        engine.log.dump(a.limit).show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
