"""Connected components of an edge table, by hooking to a neighbour of lower random rank and contracting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node id reachable.

    Each round ranks the nodes by a hash of its own, points each to the lowest within two steps, follows pointers twice
    and contracts. Ranks are random, so that chains of pointers are short whatever the ids are and a path shrinks by a
    factor in each round; a star is one node after the first. Edges and pointers of a round are stored tables. Pointers are broadcast while they are few;
    larger ones are shuffled, where adaptive execution splits nodes of many edges. Null ends and loops are ignored.
    """
    e = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = stored(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", 2 * e.count())
    maps: list[DataFrame] = []
    nodes = None
    while n := e.count():

        def rank(name: str, turn: int = len(maps)) -> Column:
            return F.struct(F.xxhash64(name, F.lit(turn)).alias("rank"), F.col(name).alias("id"))

        few = lambda df, n=n: F.broadcast(df) if n <= BROADCAST_IDS else df
        p = e.groupBy("u").agg(F.min(rank("v")).alias("low")).select("u", F.least("low", rank("u"))["id"].alias("p"))
        p = e.join(few(p.select(F.col("u").alias("v"), "p")), "v").groupBy("u").agg(F.min(rank("p"))["id"].alias("p"))
        q = p.select(F.col("u").alias("p"), F.col("p").alias("root"))
        p = stored(p.join(few(q), "p").select("u", F.col("root").alias("p")), "pointers", n)
        c = e.join(few(p), "u").select("v", F.col("p").alias("a")).join(few(p.withColumnRenamed("u", "v")), "v")
        c = stored(c.select(F.col("a").alias("u"), F.col("p").alias("v")).where("u <> v").distinct(), "edges", n)
        dropped(e)
        nodes = n if nodes is None else nodes
        maps.append(p)
        e = c
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    few = lambda df: F.broadcast(df) if nodes <= BROADCAST_IDS else df
    labels = maps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for p in maps[1:]:
        p = few(p.select(F.col("u").alias("root"), F.col("p").alias("next")))
        labels = labels.join(p, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    lowest = labels.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component"))
    out = stored(labels.join(few(lowest), "root").select("node", "component"), "components", nodes)
    dropped(e, *maps)
    return out
