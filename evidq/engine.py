"""The facade: one object over a stored log that declares, publishes, ingests, and answers every query as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.frames import local_frame
from .functions import rendering
from .functions.vocabulary import FAMILIES, STREAM, rank
from .operators import admission, assess, counters, history, inspection, links
from .plans import capability
from .plans.catalog import Catalog, Refused
from .plans.limits import Limits
from .plans.policy import DEFAULT, Band, History, Policy, Rule
from .sources.log import Log

Link = tuple[str, int]
Metric = tuple[str, str]


def _policy(body: dict) -> Policy:
    rules = tuple(Rule(**{**r, "bands": tuple(Band(**b) for b in r["bands"])}) for r in body["rules"])
    pairs = {k: tuple(map(tuple, body[k])) for k in ("family_validity_ns", "unsupported")}
    return Policy(**{**body, **pairs, "rules": rules, "severity": tuple(body["severity"])})


def _declaration(body: dict) -> capability.Declaration:
    scope = None if body["scope"] is None else tuple(body["scope"])
    metrics = tuple(capability.Measures(**m) for m in body["metrics"])
    return capability.Declaration(**{**body, "metrics": metrics, "scope": scope, "unsupported": tuple(map(tuple, body["unsupported"]))})


@dataclass(frozen=True)
class Engine:
    """Immutable: ``declare`` and ``publish`` write to the log and give a new engine. Time is always an argument."""

    spark: SparkSession
    log: Log
    epoch: int
    declared: tuple[capability.Declaration, ...] = ()
    policies: History = field(default_factory=lambda: History().publish(DEFAULT))
    limits: Limits = field(default_factory=Limits)

    @classmethod
    def open(cls, spark: SparkSession, path: str, epoch: int, policy: Policy = DEFAULT, limits: Limits | None = None) -> Engine:
        """What the log at ``path`` says was declared and published; ``policy`` is published first if none was."""
        limits, log = (limits or Limits()).check(), Log(spark, path)
        declared = tuple(map(_declaration, log.documents("capability")))
        policies = History(keep=limits.policy_generations)
        stored = [_policy(b) for b in log.documents("policy")]
        # what was forgotten leaves a gap in the generations, which is no fault
        policies = replace(policies, kept=tuple(stored[-policies.keep :])) if stored else policies
        engine = cls(spark, log, epoch, declared, policies, limits)
        return engine if stored else engine.publish(policy)

    @property
    def policy(self) -> Policy:
        return self.policies.current

    def declare(self, declaration: capability.Declaration) -> Engine:
        """Take in a declaration; one that is there already as it stands changes nothing."""
        capability.check_declaration(declaration, Catalog(), self.limits.metrics_per_declaration)
        if declaration in self.declared:
            return self
        if len(self.declared) >= self.limits.declarations:
            raise Refused("limit-exceeded", "declarations")
        self.log.append_document("capability", len(self.declared), asdict(declaration))
        return replace(self, declared=(*self.declared, declaration))

    def publish(self, policy: Policy) -> Engine:
        policies = self.policies.publish(policy)
        self.log.append_document("policy", policies.current.generation, asdict(policies.current))
        return replace(self, policies=policies)

    def declarations(self) -> DataFrame:
        return capability.declarations(self.spark, self.declared)

    def admit(self, observations: DataFrame, now_wall_ns: int | None = None) -> DataFrame:
        """``observations`` with status_code and fault; nothing is stored."""
        rows = admission.validate(observations, Catalog().frame(self.spark))
        if self.policy.require_capability:
            on = observations.select("link_id", "link_generation").distinct()
            rows = admission.capability_gate(rows, capability.gate(self.declarations(), on))
        return rows if now_wall_ns is None else admission.age_gate(rows, now_wall_ns, self.limits.observation_age_ns)

    def bounded(self, rows: DataFrame) -> DataFrame:
        """Admitted ``rows`` with those over the limits on links and on streams of a link refused, the stored ones counted."""
        known, generation = self.log.read(), ["link_id", "link_generation"]
        rows = admission.limit_firsts(rows, ["link_id"], [], self.limits.links, known)
        return admission.limit_firsts(rows, [c for c in STREAM if c not in generation], generation, self.limits.streams_per_link, known)

    def ingest(self, observations: DataFrame, now_wall_ns: int | None = None, bounded: bool = False) -> DataFrame:
        """Admit and append in one pass; one row with the outcome. ``bounded`` refuses batches over the limit whole."""
        if bounded and observations.limit(self.limits.batch + 1).count() > self.limits.batch:
            raise Refused("limit-exceeded", "batch")
        rows, seen = self.bounded(self.admit(observations, now_wall_ns)), Observation()
        rows = rows.observe(seen, *admission.outcome_columns())
        self.log.append(rows.where("status_code = 'ok'").drop("status_code", "fault"))
        found = seen.get
        kinds = "total long, accepted long, refused long, first_code string"
        return local_frame(self.spark, [tuple(found[c.split()[0]] for c in kinds.split(", "))], kinds)

    def evidence(self, on: Iterable[Link] | None = None) -> DataFrame:
        """Stored readings that pass the fence, with their status; those of other runs are recovered.

        Generations of a link beyond the last few are evicted.
        """
        names = None if on is None else [x[0] for x in on]
        rows = self.log.fenced(self.epoch, self.limits.dedup_window, names).where("fence IN ('accepted', 'reordered')")
        return links.evict(rows, self.limits.generations_per_link, self.registry())

    def registry(self) -> DataFrame:
        return self.log.registry()

    def _links(self, on: Iterable[Link] | None) -> DataFrame:
        """The links asked for, seen or not; else all that were seen."""
        if on is None:
            return self.registry().select("link_id", "link_generation")
        return local_frame(self.spark, sorted(set(on)), "link_id string, link_generation long")

    def views(self, on: Iterable[Link] | None = None, metrics: Iterable[Metric] | None = None) -> DataFrame:
        """Who measures what on the links: of the metrics asked for, else of all declared, up to the limit on either."""
        most, found = self.limits.metrics_per_query, self._links(on)
        views = capability.views(self.declarations(), found)
        if metrics is not None:
            return capability.requested(views, found, list(metrics)[:most], self.policy.unsupported)
        order = Window.partitionBy("link_id", "link_generation").orderBy(rank("family", FAMILIES), "name")
        return views.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= most).drop("_n")

    def metrics(
        self, now_ns: int, on: Iterable[Link] | None = None, metrics: Iterable[Metric] | None = None, lane: int | None = None, past: bool = False
    ) -> DataFrame:
        """Assessments per link and metric, or of one lane: as things stand, or as they stood at an instant that is past."""
        rows = self.evidence(on)
        records = assess.records_as_of(rows, self.policy, now_ns, self.epoch, self.limits.stream_history) if past else assess.current_records(rows, self.policy)
        return assess.assess(records, self.views(on, metrics), self.policy, now_ns, self.epoch, lane=lane)

    def query(self, now_ns: int, on: Iterable[Link] | None = None, metrics: Iterable[Metric] | None = None, lane: int | None = None, past: bool = False) -> DataFrame:
        """One report per link, with the policy it was made by; of links never seen too, if they are asked for."""
        out = assess.roll_up_links(self.metrics(now_ns, on, metrics, lane, past), self.policy, self.registry(), self._links(on))
        stamp = {"policy_id": self.policy.id, "policy_generation": self.policy.generation, "policy_hash": self.policy.content_hash, "epoch": self.epoch}
        return out.withColumns({k: F.lit(v) for k, v in stamp.items()})

    def as_of(self, as_of_ns: int, on: Iterable[Link] | None = None) -> DataFrame:
        return self.query(as_of_ns, on, past=True)

    def history(self, query: history.WindowQuery, now_ns: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Matching readings, and one row about the range."""
        query.check(now_ns, self.limits.window_records)
        rows = self.log.read(epoch=self.epoch, links=None if query.link is None else [query.link[0]])
        # the span available is that of all readings
        return history.window(rows, query), history.summary(self.log.read(epoch=self.epoch), query)

    def history_report(self, query: history.WindowQuery, now_ns: int) -> DataFrame:
        """The report of the query's link and metric as they stood at its instant; an instant of 0 or less is now."""
        query.check(now_ns, self.limits.window_records)
        if query.link is None:
            raise Refused("invalid", "a report needs a link")
        metrics = None if query.metric is None else [query.metric]
        return self.query(query.as_of_ns if query.as_of_ns > 0 else now_ns, [query.link], metrics, query.lane, past=query.as_of_ns > 0)

    def inspect(self, now_ns: int) -> dict[str, DataFrame]:
        """What is fresh, stale and in conflict on the first links, each list cut at the limit, and one row on what was left out."""
        most, seen = self.limits.inspection_entries, self.registry()
        held = seen.select("link_id", "link_generation").orderBy("link_id", "link_generation").limit(most)
        metrics = self.metrics(now_ns).join(F.broadcast(held), ["link_id", "link_generation"], "left_semi")
        parts = {"freshness": inspection.freshness(metrics), "stale": inspection.stale(metrics), "conflicts": inspection.conflicts(metrics, self.policy)}
        cut = {name: inspection.capped(rows, most) for name, rows in parts.items()}
        left = seen.agg(F.count("*").alias("links_inspected"), F.greatest(F.count("*") - most, F.lit(0)).alias("entries_dropped"))
        left = left.union(cut["freshness"][1].union(cut["stale"][1]).union(cut["conflicts"][1]).select(F.lit(0), "dropped"))
        left = left.agg(F.sum("links_inspected").alias("links_inspected"), F.sum("entries_dropped").alias("entries_dropped"))
        return {name: rows for name, (rows, _) in cut.items()} | {"left_out": left.withColumn("truncated", F.col("entries_dropped") > 0)}

    def explain(self, link_id: str, now_ns: int, generation: int = 1) -> str:
        """The report of one link as text."""
        on = [(link_id, generation)]
        return rendering.report(self.query(now_ns, on).collect(), self.metrics(now_ns, on).collect())

    def statistics(self) -> DataFrame:
        """(name, n): fates at the fence, counter events, links, streams, and what retention would keep or drop."""
        rows = self.log.fenced(self.epoch, self.limits.dedup_window)
        fates = rows.groupBy(F.concat(F.lit("fence-"), "fence").alias("name")).agg(F.count("*").alias("n"))
        kept = rows.where("fence IN ('accepted', 'reordered')")
        steps = counters.steps(counters.with_rules(kept.where("fence = 'accepted' AND semantics = 'counter'"), self.policy))
        events = steps.groupBy(F.concat(F.lit("counter-"), "event").alias("name")).agg(F.count("*").alias("n"))
        streams = kept.groupBy(*STREAM).agg(F.count("*").alias("_n"))
        most = self.limits.stream_history
        sums = streams.agg(
            F.count("*").alias("streams"), F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.greatest(F.col("_n") - most, F.lit(0))), F.lit(0)).alias("beyond-the-ring")
        )
        seen = links.kept_generations(kept, self.limits.generations_per_link, self.registry())
        more = seen.agg(F.count_distinct("link_id").alias("links"), F.count("*").alias("generations"), F.count_if("evicted").alias("evicted-generations"))
        more = more.withColumns({"declarations": F.lit(len(self.declared)), "policy-generations": F.lit(self.policy.generation)})
        long = lambda df: df.unpivot([], df.columns, "name", "n").withColumn("n", F.col("n").cast("long"))
        whole = lambda df: df.select(*(F.col(c).cast("long").alias(c) for c in df.columns))
        return fates.unionByName(events).unionByName(long(whole(sums))).unionByName(long(whole(more)))

    def compact(self) -> None:
        self.log.compact(self.evidence(), self.limits.stream_history, self.limits.dedup_window)
