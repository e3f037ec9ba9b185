"""Consistent sharding through a lookup table that shards fill in turns.

Each shard has a preference order over the slots of a prime-sized table: offset + k * skip modulo the size. Shards take
turns claiming their first free slot until the table is full, so their shares differ by one slot at most, and adding or
dropping a shard moves few keys. Filling and placement are DataFrame functions throughout; the table has ``slots`` rows
whatever the data, is broadcast, and a key finds its shard with one lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SHARDS, SLOTS = 32, 4093
#: Preferences that a shard tries before it looks through all it has left.
_AHEAD = 31


def _digits(text: Column, at: int) -> Column:
    """Eight hexadecimal digits of the MD5 sum as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table. ``slots`` must be a prime, larger than the number of shards.

    Shard names must be distinct and not null; they take turns in the given order.
    """
    names = list(shards)
    if not names or len(set(names)) < len(names) or None in names:
        raise ValueError("shard names must be distinct, and one at least")
    if slots <= len(names) or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime larger than the number of shards")
    row = spark.range(1).select(F.array(*(F.lit(x) for x in names)).alias("names"))
    offset = F.transform("names", lambda x: (_digits(x, 1) % slots).cast("int"))
    skip = F.transform("names", lambda x: (_digits(x, 9) % (slots - 1) + 1).cast("int"))
    row = stored(row.select("names", offset.alias("offset"), skip.alias("skip")), "preferences")

    def turn(state: Column, t: Column) -> Column:
        shard = (t % len(names)).cast("int")
        place = lambda k: ((F.get("offset", shard) + k.cast("long") * F.get("skip", shard)) % slots).cast("int")
        start = F.get(state["next"], shard)
        # the slots that the shard prefers next: a few, and all of them only if those are taken
        free = lambda end: F.get(F.filter(F.sequence(start, end), lambda k: F.get(state["owner"], place(k)) == -1), F.lit(0))
        taken = F.coalesce(free(F.least(start + _AHEAD, F.lit(slots - 1))), free(F.lit(slots - 1)))

        def claimed(k: Column) -> Column:
            put = lambda a, at, x, n: F.concat(F.slice(a, F.lit(1), at), F.array(x), F.slice(a, at + 2, F.lit(n)))
            return F.struct(put(state["owner"], place(k), shard, slots).alias("owner"), put(state["next"], shard, F.least(k + 1, F.lit(slots - 1)), len(names)).alias("next"))

        # the array of one claim binds it, so that it is found once a turn
        return F.get(F.transform(F.array(taken), claimed), F.lit(0))

    start = F.struct(F.array_repeat(F.lit(-1), slots).alias("owner"), F.array_repeat(F.lit(0), len(names)).alias("next"))
    owner = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, turn, lambda s: s["owner"])
    filled = row.select("names", F.posexplode(owner).alias("slot", "owner"))
    return stored(filled.select("slot", F.get("names", F.col("owner")).alias("shard")), "lookup")


def shard(df: DataFrame, key: str, table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``df`` with columns slot and shard added (replaced, if it has such columns already).

    A key's slot comes from its text, so equal keys meet in one shard; a null key counts as the empty text. Rows that
    repeat are placed alike, every row is placed, and an empty ``df`` gives an empty result. ``table`` has ``slots``
    rows at most, which bounds what is broadcast.
    """
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    rest = df.drop("slot", "shard").withColumn("slot", (_digits(text, 1) % slots).cast("int")) if key not in ("slot", "shard") else None
    if rest is None:
        raise ValueError("the key must not be named slot or shard")
    return rest.join(F.broadcast(table), "slot").select(*(f"`{c}`" for c in rest.columns), "shard")


#: The same table, filled by a recursive query over turns.
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS shard FROM range({SHARDS}) t(i)
), prefs AS (
  SELECT list((CAST(('0x' || substr(md5(shard), 1, 8)) AS BIGINT)) % {SLOTS} ORDER BY i) AS off,
         list((CAST(('0x' || substr(md5(shard), 9, 8)) AS BIGINT)) % {SLOTS - 1} + 1 ORDER BY i) AS skip FROM shards
), filled AS (
  SELECT 0 AS t, [-1 FOR x IN range({SLOTS})] AS owner
  UNION ALL
  SELECT t + 1, list_transform(owner, lambda o, j: CASE WHEN j = s + 1 THEN t % {SHARDS} ELSE o END)
  FROM (
    SELECT t, owner, list_filter(
      list_transform(range({SLOTS}), lambda k: (off[t % {SHARDS} + 1] + k * skip[t % {SHARDS} + 1]) % {SLOTS}),
      lambda p: owner[p + 1] = -1)[1] AS s
    FROM filled, prefs WHERE t < {SLOTS}
  )
), slots AS (
  SELECT unnest(owner) AS i, unnest(range({SLOTS})) AS slot FROM filled WHERE t = {SLOTS}
)
SELECT d.doc_id, CAST(d.slot AS INTEGER) AS slot, shards.shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {SLOTS} AS slot FROM documents) d
JOIN slots ON slots.slot = d.slot JOIN shards ON shards.i = slots.i
"""
