"""MinHash near-duplicates by fast similarity sketching, banding, and a check on full shingle sets.

The sketch has ``bands * rows`` coordinates. In round i every shingle is hashed to one coordinate and a value there;
a coordinate keeps the smallest (round, value). As many rounds again follow in which every shingle goes to one fixed
coordinate, so each coordinate is filled whatever the size of the set. Sketches agree in a coordinate with the Jaccard
similarity of the sets as probability; with 48 bands of 6 rows a pair at 0.8 stays unseen with odds of 5e-7.

Equal word sequences are folded into a class first. In each of a few turns, every bucket of a band names a leader, and
its members outside the leader's component are compared with it; what this links becomes one component. Classes that
share a bucket across components are then joined on their prefixes: two sets at 80 % or more must share one of the
rarest fifth of their shingles. Members of a large group that are not alike enough mostly share what is common; those
that share more are compared in blocks, in which texts are copied once per block of the other side, not per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, sliced, small, stored
from .components import connected_components

_EMPTY = np.uint64(2**64 - 1)
_CHUNK = 1 << 17
#: Counters of shingles that order the prefixes.
_COUNTERS = 1 << 18
#: Texts that meet a leader in one block, or stand on a side of a block of comparisons, and all shingles of such a side.
_BLOCK, _SHINGLES = 512, 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(i: int) -> np.uint64:
    return np.uint64(((i + 1) * 0x9E3779B97F4A7C15) % 2**64)


def sketch(values: np.ndarray, owner: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t sketches of sets given as hashed members with the index of the set each belongs to."""
    out = np.full(n * t, _EMPTY, np.uint64)
    low = np.uint64(2**32 - 1)
    for i in range(2 * t):
        if not len(values):
            break
        h = _mix(values + _seed(i))
        at = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + at, np.uint64(i << 32) | (h & low))
        left = np.unique(owner)
        left = left[(out.reshape(n, t)[left] == _EMPTY).any(axis=1)]
        stay = np.zeros(n, bool)
        stay[left] = True
        keep = stay[owner]
        values, owner = values[keep], owner[keep]
    return out.reshape(n, t)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; ``bytes.lower`` and ``bytes.split`` know ASCII only, as is wanted here."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], width: int) -> set:
    """The distinct shingles themselves; a shorter sequence counts as one shingle."""
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def _hashed(lists: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each list, and the list that each belongs to."""
    flat = np.array([w for x in lists for w in x] or [b""], dtype=object)
    h = pd.util.hash_array(flat, categorize=False)
    found, at = [], 0
    for x in lists:
        w = h[at : at + len(x)]
        at += len(x)
        n = max(min(len(x), 1), len(x) - width + 1)
        s = np.zeros(n, np.uint64)
        for j in range(min(width, len(x))):
            s = _mix(s + w[j : j + n]) + np.uint64(j + 1)
        found.append(np.unique(s))
    return np.concatenate(found), np.repeat(np.arange(len(lists)), [len(x) for x in found])


def _signatures(width: int, bands: int, rows: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                lists, size, start = [], 0, at
                while at < len(texts) and (size < _CHUNK or start == at):
                    lists.append(words_of(texts[at]))
                    size += len(lists[-1])
                    at += 1
                values, owner = _hashed(lists, width)
                s = sketch(values, owner, len(lists), bands * rows).reshape(len(lists), bands, rows)
                key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2])
                for r in range(rows):
                    key = _mix(key + s[:, :, r])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(start, len(lists)),
                        pa.array([hashlib.sha256(b" ".join(x)).digest() for x in lists], pa.binary()),
                        pa.array(np.bincount(owner, minlength=len(lists)), pa.int64()),
                        pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), key.astype(np.int64).ravel()),
                    ],
                    ["doc_id", "digest", "n_shingles", "bands"],
                )

    return batches


def _alike(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _similar(width: int, percent: int):
    """Links of rows (u, block, v, text) that come sorted; a u's own texts lead each of its blocks, with a null v."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in it:
            us, vs = [], []
            for u, block, v, text in zip(*(batch.column(c).to_pylist() for c in ("u", "block", "v", "text")), strict=True):
                if at != (u, block):
                    at, heads = (u, block), []
                own = shingles_of(words_of(text), width)
                if v is None:
                    heads.append(own)
                elif any(_alike(h, own, percent) for h in heads):
                    us.append(u)
                    vs.append(v)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return batches


def _sets(it: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The hashed shingle set of each row."""
    for batch in it:
        for i, text in enumerate(batch.column("text").to_pylist()):
            yield batch, i, _hashed([words_of(text)], width)[0]


def _counted(width: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS, np.int64)
        for _, _, s in _sets(it, width):
            np.add.at(total, (s % np.uint64(_COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["slot", "n"])

    return batches


def _prefixes(width: int, percent: int, counts):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, s in _sets(it, width):
            order = np.lexsort((s, counts.value[(s % np.uint64(_COUNTERS)).astype(np.int64)]))
            s = s[order[: len(s) - _least(len(s), percent) + 1]].astype(np.int64)
            columns = [batch.column(c).slice(i, 1) for c in ("rep", "part", "n")]
            yield pa.record_batch([*columns, pa.array([s], pa.list_(pa.int64()))], ["rep", "part", "n", "shingles"])

    return batches


def _least(n, percent: int):
    """How many of n shingles a set shares at least with any set that is similar enough."""
    return -(-n * percent // 100)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b, by products of incidence matrices."""
    size = [len(x) for x in a], [len(x) for x in b]
    _, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ca, cb = code[: sum(size[0])], code[sum(size[0]) :]
    ra, rb = np.repeat(np.arange(len(a)), size[0]), np.repeat(np.arange(len(b)), size[1])
    _, code = np.unique(np.concatenate([ca[ia := np.isin(ca, cb)], cb[ib := np.isin(cb, ca)]]), return_inverse=True)
    ca, cb, ra, rb = code[: ia.sum()], code[ia.sum() :], ra[ia], rb[ib]
    out = np.zeros((len(a), len(b)))
    for at in range(0, int(code.max(initial=-1)) + 1, 4096):
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        x[ra[i := (ca >= at) & (ca < at + 4096)], ca[i] - at] = 1
        y[rb[i := (cb >= at) & (cb < at + 4096)], cb[i] - at] = 1
        out += x @ y.T
    return out


def _linked(left: list[tuple], right: list[tuple], width: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between two lists of (rep, part, side, text), but for those within a part.

    Many are found by overlaps of hashed sets; all are confirmed on the sets. What stands on both sides is met once.
    """
    if len(left) * len(right) <= 64:
        found = ((i, j) for i in range(len(left)) for j in range(len(right)))
    else:
        a, b = ([_hashed([words_of(x[3])], width)[0] for x in side] for side in (left, right))
        both, na, nb = _overlaps(a, b), np.array([len(x) for x in a]), np.array([len(x) for x in b])
        found = zip(*(x.tolist() for x in np.nonzero(100 * both >= percent * (na[:, None] + nb[None, :] - both))), strict=True)
    held: tuple[int, set] = (-1, set())
    known: dict[int, set] = {}
    for i, j in found:
        (u, part_u, side_u, text_u), (v, part_v, side_v, text_v) = left[i], right[j]
        if part_u == part_v or side_u == side_v and u > v:
            continue
        if held[0] != i:
            held = i, shingles_of(words_of(text_u), width)
        if j not in known:
            if sum(map(len, known.values())) > _SHINGLES:
                known.clear()
            known[j] = shingles_of(words_of(text_v), width)
        if _alike(held[1], known[j], percent):
            yield u, v


def _blocks(it: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(root, left, right) of rows that come sorted by block (root, i, j): those of side 0 and of side 1; side 2 is both."""
    at, sides = None, ([], [])
    for batch in it:
        for root, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", *columns)), strict=True):
            if at != (root, i, j):
                if at is not None:
                    yield at[0], *sides
                at, sides = (root, i, j), ([], [])
            for k in (0, 1):
                if row[2] in (k, 2):
                    sides[k].append(tuple(row))
    if at is not None:
        yield at[0], *sides


def _between(width: int, percent: int):
    """Links of rows (root, i, j, rep, part, side, text) that come sorted by block."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right in _blocks(it, ("rep", "part", "side", "text")):
            found = list(_linked(left, right, width, percent))
            if found:
                yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return batches


def _hopeful(percent: int):
    """(root, rep) of rows (root, i, j, rep, part, side, n, roots, shingles), sorted by block, that may have a link there.

    Two sets share no more than their prefixes do and what the shorter of them has besides. A pair that meets in many
    blocks counts in the least of their common roots only.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root, left, right in _blocks(it, ("rep", "part", "side", "n", "roots", "shingles")):
            sets = [[np.unique(np.array(x[5], np.int64)) for x in side] for side in (left, right)]
            a, b = (
                {"n": [x[3] for x in own], "rest": [x[3] - len(x[5]) for x in own], "lost": [len(x[5]) - len(s) for x, s in zip(own, found, strict=True)],
                 "rep": [x[0] for x in own], "part": [x[1] for x in own], "side": [x[2] for x in own]}
                for own, found in zip((left, right), sets, strict=True)
            )
            a, b = {k: np.array(v)[:, None] for k, v in a.items()}, {k: np.array(v)[None, :] for k, v in b.items()}
            # lost: shingles of one set whose halved hashes are equal
            most = _overlaps(*sets) + a["lost"] + b["lost"] + np.minimum(a["rest"], b["rest"])
            # percent of the union is shared if (100 + percent) * shared >= percent * (both sizes)
            hope = ((100 + percent) * most >= percent * (a["n"] + b["n"])) & (a["part"] != b["part"]) & ((a["side"] != b["side"]) | (a["rep"] < b["rep"]))
            marked = set()
            roots = [[set(x[4]) for x in own] for own in (left, right)]
            for i, j in zip(*(x.tolist() for x in np.nonzero(hope)), strict=True):
                if min(roots[0][i] & roots[1][j]) == root:
                    marked |= {left[i][0], right[j][0]}
            if marked:
                yield pa.record_batch([pa.array([root] * len(marked), pa.int64()), pa.array(sorted(marked), pa.int64())], ["root", "rep"])

    return batches


def _met(of: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """Rows (root, i, j, rep, part, side, *columns) of ``of`` (root, rep, part, size), by sub-block and sorted.

    What isn't of a root's largest part is its left side and cut into sub-blocks i, everything is its right side and cut
    into sub-blocks j, so that each sub-block's sizes and rows are bounded. ``values`` (rep, *columns) are joined last.
    """
    n = of.count()
    large = of.groupBy("root", "part").count().groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("large"))
    of = of.join(small(stored(large, "large", n), BROADCAST_IDS), "root").withColumn("outside", F.col("part") != F.col("large"))
    pieces = lambda f: F.ceil(F.greatest(F.sum(F.when(f, F.col("size"))) / _SHINGLES, F.count_if(f) / _BLOCK)).cast("int")
    size = of.groupBy("root").agg(pieces(F.col("outside")).alias("a"), pieces(F.lit(True)).alias("b")).where("a > 0")
    turn = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    of = of.join(small(stored(size, "sizes", n), BROADCAST_IDS), "root").withColumns({"ti": turn("a"), "tj": turn("b")})
    spot = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    own = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: spot(F.col("ti"), j, F.when(j == F.col("tj"), 2).otherwise(0)))
    across = F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: spot(i, F.col("tj"), F.lit(1)))
    spots = F.when(F.col("outside"), F.concat(own, F.filter(across, lambda x: x["i"] != F.col("ti")))).otherwise(across)
    rows = of.select("root", "rep", "part", F.explode(spots).alias("s")).select("root", "s.i", "s.j", "rep", "part", "s.side")
    rows = rows.join(values, "rep").select("root", "i", "j", "rep", "part", "side", *columns)
    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")


def _across(placed: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between classes of different parts.

    Similar sets share a shingle of their prefixes. A prefix holds a set's first shingles by how often they occur; any
    fixed order is exact, and a table of counters of fixed size gives a good one. Everything that has a shingle goes to
    the block of the part that has it most often. There the prefixes alone are compared, in sub-blocks of bounded size;
    only sets that share enough of them with some other are sent to their blocks again, with their whole texts. Pairs
    are counted within tasks, by products of incidence matrices, and never made into rows.
    """
    texts = docs.join(small(placed, BROADCAST_IDS), docs.doc_id == placed.rep).select("rep", "part", "n", "text")
    texts = stored(texts.dropDuplicates(["rep", "text"]), "residue")
    counts = np.zeros(_COUNTERS, np.int64)
    sums = texts.select("text").mapInArrow(_counted(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # at most _COUNTERS rows
    counts[found["slot"]] = found["n"]
    held = texts.sparkSession.sparkContext.broadcast(counts)
    rows = stored(texts.mapInArrow(_prefixes(width, percent, held), "rep long, part long, n long, shingles array<long>"), "prefixes")
    held.destroy()
    single = rows.select(F.explode("shingles").alias("shingle"), "rep", "part", F.size("shingles").alias("size"))
    parts = single.groupBy("shingle", "part").count().groupBy("shingle")
    keys = parts.agg(F.max_by("part", F.struct("count", "part")).alias("root"), F.count("*").alias("parts")).where("parts > 1")
    of = single.join(keys.select("shingle", "root"), "shingle").groupBy("root", "rep", "part").agg(F.max("size").alias("size"))
    of = stored(of, "blocks")
    roots = of.groupBy("rep").agg(F.collect_set("root").alias("roots"))  # one for each shingle of a prefix at most
    short = F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int"))  # half of the hash does here
    heads = rows.select("rep", "n", short.alias("shingles")).join(roots, "rep")
    hopeful = _met(of, heads, "n", "roots", "shingles").mapInArrow(_hopeful(percent), "root long, rep long").distinct()
    of = of.join(stored(hopeful, "hopeful", of.count()), ["root", "rep"]).join(rows.groupBy("rep").agg(F.max("n").alias("n")), "rep")
    of = stored(of.select("root", "rep", "part", F.col("n").alias("size")), "blocks")
    out = stored(_met(of, texts.select("rep", "text"), "text").mapInArrow(_between(width, percent), "u long, v long"), "links")
    dropped(texts, rows)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v), a stored table, whose full shingle sets are similar enough.

    Every text of a v goes to its u, and the text of a u once to each block of its v.
    """
    ids = stored(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "paired", 2 * pairs.count())
    texts = stored(docs.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi").distinct(), "texts")
    blocks = pairs.groupBy("u").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    tails = pairs.join(blocks, "u").select("u", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"), "v")
    tails = tails.join(texts.withColumnRenamed("doc_id", "v"), "v").select("u", "block", "v", "text")
    heads = blocks.join(texts.withColumnRenamed("doc_id", "u"), "u")
    heads = heads.select("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("v"), "text")
    both = heads.union(tails).repartition("u", "block").sortWithinPartitions("u", "block", "v")  # nulls come first
    out = stored(both.mapInArrow(_similar(width, percent), "u long, v long"), "links")
    dropped(ids, texts)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, turns: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct ``width``-word
    shingles (fewer words: the whole sequence is the one shingle). component_id is the smallest doc_id reachable,
    kept says that it is the row's own. Documents without words, or with a null text, have an empty set and are
    linked with nothing. Rows with a null doc_id are linked with nothing either, have a null component and are kept.
    Rows that repeat a doc_id count as one document of that id in each of their texts. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = stored(
        docs.mapInArrow(_signatures(width, bands, rows), "doc_id long, digest binary, n_shingles long, bands array<long>"),
        "signatures",
    )
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    buckets = classes.select("rep", F.explode("bands").alias("key"))
    many = buckets.groupBy("key").count().where("count > 1").select("key")
    members = stored(buckets.join(many, "key"), "members")
    n = members.count()
    placed = members.withColumn("part", F.col("rep"))
    tested = links = parts = None
    for turn in range(turns):
        first = F.min_by(F.struct("rep", "part"), F.struct(F.xxhash64("rep", F.lit(turn)), "rep"))
        mixed = placed.groupBy("key").agg(first.alias("first"), F.min("part").alias("low"), F.max("part").alias("high"))
        mixed = mixed.where("low <> high").select("key", F.col("first.rep").alias("lead"), F.col("first.part").alias("lead_part"))
        stars = placed.join(mixed, "key").where("part <> lead_part")
        stars = stars.select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct()
        stars = stored(stars if tested is None else stars.join(tested, ["u", "v"], "left_anti"), "stars", n)
        found = _verified(stars, docs, width, percent)
        tested = stars if tested is None else tested.union(stars)
        links = found if links is None else links.union(found)
        parts = connected_components(links).withColumnRenamed("node", "rep")
        placed = members.join(small(parts, BROADCAST_IDS), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    placed = placed.join(mixed, "key", "left_semi").select("rep", "part").distinct()
    placed = stored(placed.join(classes.select("rep", "n").distinct(), "rep"), "mixed", n)
    links = links.union(_across(placed, docs, width, percent))
    copies = stored(classes.where("rep <> last").select("digest", F.col("rep").alias("first")), "copies", classes.count())
    dropped(members, classes, placed, tested, parts)
    # rows of one doc_id with different texts form one document
    twice = signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    of = able.select("doc_id", "digest").join(twice, "doc_id").join(small(copies, BROADCAST_IDS), "digest", "left")
    of = of.select(F.coalesce("first", "doc_id").alias("u"), F.col("doc_id").alias("v")).where("u <> v")
    parts = connected_components(links.union(of.distinct()))
    out = signed.select("doc_id", "n_shingles", "digest").join(small(copies, BROADCAST_IDS), "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
    out = out.join(small(parts, BROADCAST_IDS), "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
