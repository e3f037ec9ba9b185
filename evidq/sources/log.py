"""The event log: append-only Parquet tables of typed records, with recovery, snapshots and checks.

Each kind of record has its own folder. Writes commit as Spark's file output does, so a torn tail can't be read. A
compacted log is written beside the old one as the next version, and counts once its last file, the mark, stands.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import local_frame
from ..functions.vocabulary import STREAM
from ..operators import fence, links, retention
from ..plans.catalog import Refused

# Kinds of records.
KINDS = {"capability": 1, "policy": 2, "link-observed": 3, "link-generation-advanced": 4, "evidence": 5, "snapshot": 6, "dedup-window": 7}
BUCKETS = 64
SCHEMAS = {
    "evidence": (
        "ordinal long, link_id string, link_generation long, source_id string, source_incarnation long, sequence long, family string, name string, "
        "lane int, unit string, semantics string, gauge_value double, gauge_validity_ns long, counter_value decimal(20,0), counter_width string, "
        "reset_declared boolean, observed_ns long, observed_synchronized boolean, interval_ns long, authority long, transport string, "
        "evidence_class string, prov_origin string, producer string, received_wall_ns long, received_steady_ns long, received_epoch long, "
        "origin string, link_bucket int"
    ),
    "link-observed": "link_id string, link_generation long, first_ordinal long, evidence_count long, through long",
    "dedup-window": (
        "link_id string, link_generation long, family string, name string, lane int, source_id string, source_incarnation long, "
        "sequence long, ordinal long, digest string"
    ),
    "policy": "position long, body string",
    "capability": "position long, body string",
}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a session in one process (tests) may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise Refused("unavailable", "spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evidq-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _bucket(link):
    return F.pmod(F.xxhash64(link), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Log:
    spark: SparkSession
    path: str

    def _at(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._at(path)
        return fs.exists(hadoop)

    def _version(self) -> int:
        fs, hadoop = self._at(self.path)
        if not fs.exists(hadoop):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
        return max((int(n[1:]) for n in names if n.startswith("v") and self._exists(f"{self.path}/{n}/_COMPLETE")), default=0)

    def _folder(self, kind: str, version: int | None = None) -> str:
        if kind not in KINDS:
            raise Refused("invalid", f"no such kind: {kind}")
        return f"{self.path}/v{self._version() if version is None else version}/kind={kind}"

    def append(self, rows: DataFrame, kind: str = "evidence", version: int | None = None) -> None:
        """Add records of one kind; evidence is spread by link, so that a link's history is read from few files."""
        folder = self._folder(kind, version)
        if kind == "evidence":
            rows.withColumn("link_bucket", _bucket("link_id")).write.mode("append").partitionBy("link_bucket").parquet(folder)
        else:
            rows.write.mode("append").parquet(folder)

    def read(self, kind: str = "evidence", epoch: int | None = None, links: Iterable[str] | None = None) -> DataFrame:
        """Records of a kind, none if there are none yet. With the epoch of this run, evidence of any other is recovered.

        With ``links``, only these links' evidence, from their own buckets.
        """
        folder, schema = self._folder(kind), SCHEMAS.get(kind)
        if not self._exists(folder):
            return local_frame(self.spark, [], schema).drop("link_bucket")
        rows = self.spark.read.schema(schema).parquet(folder)
        if links is not None:
            names = sorted(set(links))
            rows = rows.where(F.col("link_id").isin(names) & F.col("link_bucket").isin([_bucket(F.lit(x)) for x in names]))
        rows = rows.drop("link_bucket")
        if epoch is None or kind != "evidence":
            return rows
        return rows.withColumn("origin", F.when(F.col("received_epoch") == epoch, F.col("origin")).otherwise("recovered"))

    def append_document(self, kind: str, position: int, body: dict) -> None:
        """Add a policy or a declaration, which stand as JSON in the order of their positions."""
        self.append(local_frame(self.spark, [(position, json.dumps(body))], SCHEMAS[kind]).coalesce(1), kind)

    def documents(self, kind: str) -> list[dict]:
        """The policies or declarations in order; the limits document bounds how many there are."""
        return [json.loads(r.body) for r in self.read(kind).orderBy("position").collect()]

    def registry(self) -> DataFrame:
        """Links and generations seen, with what a compacted log remembers of the rows that it no longer holds."""
        old = self.read("link-observed")
        through = old.agg(F.coalesce(F.max("through"), F.lit(-1)).alias("through"))
        rows = self.read().select("link_id", "link_generation", "ordinal").join(F.broadcast(through)).where("ordinal > through")
        return links.registry(rows, old)

    def fenced(self, epoch: int | None = None, window: int = fence.WINDOW, links: Iterable[str] | None = None) -> DataFrame:
        """Evidence with its fate at the fence, which also knows the sequences that a compacted log remembers."""
        seeds = self.read("dedup-window")
        if links is not None:
            seeds = seeds.where(F.col("link_id").isin(sorted(set(links))))
        return fence.fenced(self.read(epoch=epoch, links=links), window, seeds=seeds)

    def dedup_window(self, window: int = fence.WINDOW) -> DataFrame:
        """Per stream the sequences that a restart must still recognise, with when they came and what they said."""
        columns = [*STREAM, "sequence", "ordinal", "digest"]
        rows = self.read().withColumn("digest", fence.digest()).select(columns).unionByName(self.read("dedup-window").select(columns))
        rows = rows.withColumn("_mark", F.max("sequence").over(Window.partitionBy(*STREAM))).where(F.col("_mark") - F.col("sequence") < window)
        # of equal sequences the first arrival counts
        return rows.groupBy(*STREAM, "sequence").agg(F.min_by(F.struct("ordinal", "digest"), "ordinal").alias("r")).select(*STREAM, "sequence", "r.*")

    def compact(self, rows: DataFrame, ring: int = retention.RING, window: int = fence.WINDOW) -> None:
        """Write the next version: documents, links, what retention keeps of fenced ``rows``, and the dedup windows.

        The old version stays until it is deleted.
        """
        version = self._version() + 1
        for kind in ("policy", "capability"):
            self.append(self.read(kind), kind, version)
        through = self.read().agg(F.max("ordinal").alias("through"))
        observed = self.registry().select("link_id", "link_generation", "first_ordinal", "evidence_count")
        self.append(observed.join(F.broadcast(through)), "link-observed", version)
        kept = retention.retained(rows, ring).drop("fence")
        self.append(kept, "evidence", version)
        again = kept.select(*(F.col(c).alias(f"_{c}") for c in [*STREAM, "ordinal"]))
        met = F.col("ordinal") == F.col("_ordinal")
        for c in STREAM:
            met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
        self.append(self.dedup_window(window).join(again, met, "left_anti"), "dedup-window", version)
        fs, mark = self._at(f"{self.path}/v{version}/_COMPLETE")
        fs.create(mark).close()

    def verify(self) -> DataFrame:
        """One row: records, distinct ordinals, gaps between them, whether each stands once, and whether all kinds are known."""
        rows = self.read().select("ordinal", "link_id")
        # gaps are found per range of ordinals, so that no task sees them all
        span = rows.groupBy(F.floor(F.col("ordinal") / 100_000).alias("range")).agg(
            F.count("*").alias("n"), F.count_distinct("ordinal").alias("distinct"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")
        )
        total = span.agg(F.sum("n").alias("records"), F.sum("distinct").alias("distinct"), F.min("low").alias("first"), F.max("high").alias("last"))
        total = total.withColumns({"gaps": F.col("last") - F.col("first") + 1 - F.col("distinct"), "unique": F.col("records") == F.col("distinct")})
        return total.withColumn("kinds_known", F.lit(not self.unknown_kinds()))

    def unknown_kinds(self) -> list[str]:
        """Folders of the current version whose kind isn't one of this log's."""
        fs, folder = self._at(f"{self.path}/v{self._version()}")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n.removeprefix("kind=") for n in names if n.startswith("kind=") and n.removeprefix("kind=") not in KINDS)

    def dump(self, limit: int = 100) -> DataFrame:
        """The first records by ordinal."""
        return self.read().orderBy("ordinal").limit(limit)
