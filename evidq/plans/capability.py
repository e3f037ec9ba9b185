"""Capability declarations: what each source says it measures, by revision, and the views that follow from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import local_frame
from ..functions.vocabulary import FAMILIES, rank
from .catalog import Catalog, Refused, check_metric_id

_METRIC = "struct<family:string,name:string,unit:string,semantics:string,width:string,lanes_declared:boolean,lane_count:int,validity_ns:long>"
SCHEMA = (
    "source_id string, source_incarnation long, scope_id string, scope_generation long, revision long, "
    f"metrics array<{_METRIC}>, unsupported array<struct<family:string,name:string>>"
)
KEY = ["source_id", "source_incarnation", "scope_id", "scope_generation"]


@dataclass(frozen=True)
class Measures:
    """One declared metric of a source."""

    family: str
    name: str
    unit: str
    semantics: str = "gauge"
    width: str = "unspecified"
    lanes_declared: bool = False
    lane_count: int = 0
    validity_ns: int = 0


@dataclass(frozen=True)
class Declaration:
    source_id: str
    metrics: tuple[Measures, ...]
    source_incarnation: int = 1
    scope: tuple[str, int] | None = None
    revision: int = 1
    unsupported: tuple[tuple[str, str], ...] = ()

    def row(self) -> tuple:
        scope = self.scope or (None, None)
        measured = [(m.family, m.name, m.unit, m.semantics, m.width, m.lanes_declared, m.lane_count, m.validity_ns) for m in self.metrics]
        return (self.source_id, self.source_incarnation, *scope, self.revision, measured, list(self.unsupported))


def check_declaration(d: Declaration, catalog: Catalog, most: int = 128, max_lanes: int = 4096) -> Declaration:
    """``d``, or a typed refusal."""

    def refuse(when: bool, code: str = "invalid") -> None:
        if when:
            raise Refused(code, f"declaration of {d.source_id}")

    refuse(not (0 < len(d.source_id) <= 128 and all("!" <= c <= "~" for c in d.source_id)) or d.source_incarnation < 1 or d.revision < 1)
    refuse(len(d.metrics) + len(d.unsupported) > most, "limit-exceeded")
    refuse(not d.metrics and not d.unsupported)
    seen = set()
    for m in d.metrics:
        check_metric_id(m.family, m.name)
        known = catalog.metrics.get((m.family, m.name))
        refuse(known is None, "unsupported")
        refuse((m.family, m.name) in seen)
        seen.add((m.family, m.name))
        refuse((known.unit, known.semantics) != (m.unit, m.semantics) or m.validity_ns < 0)
        refuse(m.lanes_declared and (not known.lanes or not 0 < m.lane_count <= max_lanes))
        refuse(not m.lanes_declared and m.lane_count != 0)
    for u in d.unsupported:
        check_metric_id(*u)
        refuse(u in seen, "conflict")
    refuse(len(set(d.unsupported)) < len(d.unsupported))
    return d


def declarations(spark: SparkSession, rows: Iterable[Declaration], catalog: Catalog | None = None) -> DataFrame:
    """Checked declarations in the order given, which is their arrival."""
    catalog = catalog or Catalog()
    rows = [check_declaration(d, catalog).row() + (i,) for i, d in enumerate(rows)]
    return local_frame(spark, rows, f"{SCHEMA}, ordinal long")


def revisions(declared: DataFrame) -> DataFrame:
    """``declared`` with status: newer revisions are ok; the newest again is duplicate or id-mismatch; older are fenced."""
    before = Window.partitionBy(*KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    content = F.sha2(F.to_json(F.struct("metrics", "unsupported")), 256)
    own = Window.partitionBy(*KEY, "revision").orderBy("ordinal")
    rows = declared.withColumns({"_newest": F.max("revision").over(before), "_hash": content})
    same = F.col("_hash") == F.first("_hash").over(own)
    status = (
        F.when(F.col("_newest").isNull() | (F.col("revision") > F.col("_newest")), "ok")
        .when(F.col("revision") < F.col("_newest"), "fenced")
        .when(same, "duplicate")
        .otherwise("id-mismatch")
    )
    return rows.withColumn("status", status).drop("_newest", "_hash")


def effective(declared: DataFrame) -> DataFrame:
    """The newest accepted revision per source and scope."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("revision"))
    return revisions(declared).where("status = 'ok'").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "status")


def _scoped(current: DataFrame, links: DataFrame) -> DataFrame:
    """Declarations on the links they hold for: those of a scope by it, the others on every link."""
    own = links.select("link_id", "link_generation")
    on = (F.col("scope_id") == F.col("link_id")) & (F.col("scope_generation") == F.col("link_generation"))
    scoped = current.where("scope_id IS NOT NULL").join(own, on)
    # the limits document bounds the declarations, so that this side stays small
    everywhere = own.join(F.broadcast(current.where("scope_id IS NULL")))
    columns = ["link_id", "link_generation", *current.columns]
    return scoped.select(columns).unionByName(everywhere.select(columns))


def views(declared: DataFrame, links: DataFrame) -> DataFrame:
    """One row per link, metric and declaration that lists it, measured or not.

    Columns: link, family, name, source, scoped, and measured, lanes_declared, lane_count, validity_ns (null if
    unsupported). A source that declares a metric with and without scope has two rows.
    """
    on = _scoped(effective(declared), links).withColumn("scoped", F.col("scope_id").isNotNull())
    key = ["link_id", "link_generation", "source_id", "source_incarnation", "scoped"]
    measured = on.select(*key, F.explode("metrics").alias("m"))
    measured = measured.select(*key, "m.family", "m.name", F.lit(True).alias("measured"), "m.lanes_declared", "m.lane_count", "m.validity_ns")
    missing = on.select(*key, F.explode("unsupported").alias("m")).select(*key, "m.family", "m.name", F.lit(False).alias("measured"))
    return measured.unionByName(missing, allowMissingColumns=True)


def requested(views: DataFrame, links: DataFrame, metrics: Iterable[tuple[str, str]], unsupported: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``views`` narrowed to the metrics asked for; one that nobody declares on a link that has views stands alone.

    A metric that stands alone has no source. It is declared unsupported if it is in ``unsupported``, the policy's list.
    """
    asked = sorted(set(metrics), key=lambda m: (FAMILIES.index(m[0]), m[1]))
    listed = set(unsupported)
    spark = views.sparkSession
    rows = [(f, n, (f, n) in listed) for f, n in asked]
    wanted = F.broadcast(local_frame(spark, rows, "family string, name string, listed boolean"))
    held = views.join(wanted.select("family", "name"), ["family", "name"], "left_semi").select(views.columns)
    on = links.select("link_id", "link_generation").join(views.select("link_id", "link_generation").distinct(), ["link_id", "link_generation"], "left_semi")
    # the metrics of one query are few
    alone = on.join(wanted).join(held.select("link_id", "link_generation", "family", "name").distinct(), ["link_id", "link_generation", "family", "name"], "left_anti")
    alone = alone.select("link_id", "link_generation", "family", "name", F.when(F.col("listed"), F.lit(False)).alias("measured"))
    return held.unionByName(alone, allowMissingColumns=True)


def view_summary(declared: DataFrame, links: DataFrame) -> DataFrame:
    """One row per link and metric: who declares it, who says it isn't measured, how many lanes; sources in order.

    ``ordered`` gives the rows in the order of metrics.
    """
    names = lambda f: F.array_sort(F.collect_list(F.when(f, F.concat_ws("@", "source_id", "source_incarnation"))))
    out = views(declared, links).groupBy("link_id", "link_generation", "family", "name")
    out = out.agg(
        names(F.col("measured")).alias("declared_by"),
        names(~F.col("measured")).alias("unsupported_by"),
        F.coalesce(F.max(F.when(F.col("lanes_declared"), F.col("lane_count"))), F.lit(0)).alias("lanes"),
    )
    return out.withColumn("family_rank", rank("family", FAMILIES))


def ordered(summary: DataFrame) -> DataFrame:
    """Rows of ``view_summary`` by link, family as the data model ranks it, and name."""
    return summary.orderBy("link_id", "link_generation", "family_rank", "name")


def gate(declared: DataFrame, links: DataFrame) -> DataFrame:
    """What decides whether a source's reading is let in: per link and source, its first declaration in key order.

    A declaration without scope comes before one with; what the first doesn't list is not looked up in another.
    """
    on = _scoped(effective(declared), links)
    key = ["link_id", "link_generation", "source_id", "source_incarnation"]
    first = Window.partitionBy(*key).orderBy(F.col("scope_id").isNotNull(), "scope_id")
    one = on.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*key, F.explode("metrics").alias("m"))
    cap = ("unit", "semantics", "width", "lanes_declared", "lane_count")
    return one.select(*key, "m.family", "m.name", *(F.col(f"m.{c}").alias(f"cap_{c}") for c in cap))
