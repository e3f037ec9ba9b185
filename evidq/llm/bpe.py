"""Byte-level BPE: words folded by Spark higher-order functions, looked up in texts, and decoded by putting tokens together.

The words of all texts are counted. Those that occur most, up to a fixed number, are folded once each into ids: the
fold merges, again and again, the first two adjacent parts with the lowest rank, as the library does. It carries the
ranks of all adjacent parts along, so that a merge looks up no more than the two beside it. The ranks are a literal in
the plan, an array of short buckets by hash, as a lookup in a Spark map reads the whole map. The folded words are
broadcast; tasks split texts and look their words up, and merge the rest, rare and very long words, by the same ranks.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import non_empty, sliced, stored

#: Rare words that a task keeps, and the longest word in characters that is kept anywhere.
_CACHE, LONGEST = 100_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slot(key: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def bucketed(entries: DataFrame, key: str, buckets: int) -> Column:
    """The rows of a table of bounded size as one literal: an array of ``buckets`` buckets by the hash of ``key``."""
    named = entries.select(_slot(F.col(key), buckets).alias("slot"), F.struct(*entries.columns).alias("entry"))
    found = named.groupBy("slot").agg(F.collect_list("entry").alias("entries"))
    slots = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("slot"))
    full = slots.join(found, "slot", "left").select("slot", F.coalesce("entries", F.array().cast(found.schema["entries"].dataType)).alias("entries"))
    one = full.agg(F.sort_array(F.collect_list(F.struct("slot", "entries"))).alias("all"))
    return stored(one.select(F.col("all.entries").alias("all")), "literal").scalar()


def _found(table: Column, key: Column, name: str, field: str, buckets: int) -> Column:
    """A field of the entry of a key, or null. The first entry of a bucket is tried before the others are read."""
    bucket = F.get(table, _slot(key, buckets))
    first = F.get(bucket, F.lit(0))
    return F.when(first[name] == key, first[field]).otherwise(F.get(F.filter(bucket, lambda e: e[name] == key), F.lit(0))[field])


class Literals:
    """The literals of a vocabulary, bound to lambda variables: whole tokens, pairs of ids that merge, ids of bytes."""

    WHOLE, PAIRS = 1 << 17, 1 << 20

    def __init__(self, whole: Column, pairs: Column, singles: Column):
        self.whole, self.pairs, self.singles = whole, pairs, singles

    def token(self, word: Column) -> Column:
        return _found(self.whole, word, "token", "rank", self.WHOLE)

    def merge(self, a: Column, b: Column) -> Column:
        """The rank of the merge of two adjacent ids, which is the id it makes, or null."""
        return _found(self.pairs, a.cast("long") * (1 << 20) + b, "key", "rank", self.PAIRS)


def _ranks(v: Literals, p: Column) -> Column:
    """Ranks of the merges of adjacent ids."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: v.merge(F.get(p, i), F.get(p, i + 1)))
    return F.when(F.size(p) < 2, F.array().cast("array<int>")).otherwise(pairs)


def _merged(v: Literals, state: Column) -> Column:
    """One merge: of the first place with the lowest rank. Only the ranks beside it are looked up again."""
    parts, ranks = state["parts"], state["ranks"]
    none = F.array().cast("array<int>")

    def at_place(m: Column) -> Column:
        at, least = m["at"], m["least"]
        left = F.when(at > 1, F.array(v.merge(F.get(parts, at - 2), least))).otherwise(none)
        right = F.when(at + 1 < F.size(parts), F.array(v.merge(least, F.get(parts, at + 1)))).otherwise(none)
        return F.struct(
            F.concat(F.slice(parts, F.lit(1), at - 1), F.array(least), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(ranks, at + 2, F.size(parts))).alias("ranks"),
        )

    place = F.struct(F.array_min(ranks).alias("least"), F.array_position(ranks, F.array_min(ranks)).cast("int").alias("at"))
    return F.when(F.array_min(ranks).isNull(), state).otherwise(_let(place, at_place))


def fold(v: Literals, word: Column) -> Column:
    """Decimal ids, joined by commas, of the bytes of one word: merges are folded over its bytes, lowest rank first."""

    def folded(parts: Column) -> Column:
        start = F.struct(parts.alias("parts"), _ranks(v, parts).alias("ranks"))
        ids = F.aggregate(F.sequence(F.lit(2), F.size(parts)), start, lambda s, _: _merged(v, s), lambda s: s["parts"])
        return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")

    def known(b: Column) -> Column:
        # as Latin-1 text, a character's code point is its byte
        codes = F.transform(F.split(F.decode(b, "ISO-8859-1"), ""), lambda c: F.get(v.singles, F.ascii(c)))
        return F.coalesce(v.token(b).cast("string"), _let(codes, folded))

    return _let(word.cast("binary"), known)


class Vocabulary:
    """Ranks of byte strings, as literals for encoding and decoding. Its size bounds what is broadcast.

    A literal is added as a column and used once, so that the optimizer puts it where it is used and it is never part
    of a row.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.ranks, pairs = ranks, []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(((a << 20) + b, rank))
        whole = spark.createDataFrame([(bytearray(t), r) for t, r in ranks.items()], "token binary, rank int")
        singles = spark.createDataFrame([([ranks[bytes([i])] for i in range(256)],)], "singles array<int>")
        self.literals = {
            "_whole": bucketed(whole, "token", Literals.WHOLE),
            "_pairs": bucketed(spark.createDataFrame(pairs, "key long, rank int"), "key", Literals.PAIRS),
            "_singles": stored(singles, "singles").scalar(),
        }

    def encoded(self, df: DataFrame, name: str, body, **more: Column) -> DataFrame:
        """``df`` with the column ``name`` = body(literals, *more)."""
        call = lambda args: body(Literals(*args[:3]), *args[3:])
        bound = lambda names, args: call(args) if not names else _let(F.col(names[0]), lambda x: bound(names[1:], [*args, x]))
        all_ = self.literals | more
        return df.withColumns(all_).select(*df.columns, bound(list(all_), []).alias(name))


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def common_words(docs: DataFrame, pattern: str, most: int) -> DataFrame:
    """The words that occur most often in all texts, ``most`` at most; ties at the cut are all left out.

    Words of over 64 characters are left out too, which bounds the table's bytes.
    """
    counts = docs.select(F.explode(words(F.col("text"), pattern)).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").count()
    counts = stored(counts, "words")
    step = F.floor(F.log2(F.col("count")) * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).count().collect()  # a thousand rows at most
    least, total = None, 0
    for row in sorted(steps, reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return counts.where(F.lit(False) if least is None else step >= least).select("word")


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the same merges as ``fold``: lowest rank first, of equal ones the first place.

    Adjacent places are kept in a heap and parts in a linked list, so that a word of n bytes takes n log n steps.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at an index: where it ends, who precedes
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, to = heapq.heappop(heap)
        middle = end[at]
        if middle < 0 or middle >= n or end[middle] != to:
            continue  # one of the two parts is gone or has grown
        end[at], end[middle] = to, -1
        if to < n:
            before[to] = at
            if (r := ranks.get(word[at : end[to]])) is not None:
                heapq.heappush(heap, (r, at, end[to]))
        if (left := before[at]) >= 0 and (r := ranks.get(word[left:to])) is not None:
            heapq.heappush(heap, (r, left, to))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class _Ids(dict):
    """Decimal ids of words: the common ones from the table, others merged when they come and kept for a while."""

    def __init__(self, common: pa.Table, ranks: dict[bytes, int]):
        super().__init__(zip(common.column("word").to_pylist(), common.column("ids").to_pylist(), strict=True))
        self.ranks, self.most = ranks, len(self) + _CACHE
        self.common = len(self)

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            for w in list(islice(self, self.common, None)):
                del self[w]
        out = ",".join(map(str, merged(word.encode(), self.ranks)))
        if len(word) <= LONGEST:
            self[word] = out
        return out


def _placed(common, ranks, pattern: str):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        ids = _Ids(pa.ipc.open_stream(common.value).read_all(), ranks.value)
        for batch in sliced(it):
            out = [",".join(map(ids.__getitem__, split(text))) for text in batch.column("text").to_pylist()]
            n = [x.count(",") + 1 if x else 0 for x in out]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.large_string()), pa.array(n, pa.int64())], ["doc_id", "ids", "n_tokens"])

    return batches


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, most: int = 1 << 19) -> DataFrame:
    """doc_id, ids (decimal, joined by commas) and n_tokens for every row of ``docs`` (doc_id, text).

    Texts are whole; a null text counts as empty and has no ids. Rows that repeat are encoded each; a null doc_id
    stays. Other columns are ignored. ``most`` bounds the table of common words, which Spark folds and which is
    broadcast, not what is encoded: tasks merge the other words by the same ranks.
    """
    docs = docs.select("doc_id", non_empty("text").alias("text"))
    frequent = common_words(docs, pattern, most)
    known = vocabulary.encoded(frequent, "ids", lambda v: fold(v, F.col("word"))).toArrow()  # ``most`` short words
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as out:
        out.write_table(known)
    held = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary.ranks)
    return docs.mapInArrow(_placed(held, ranks, pattern), "doc_id long, ids string, n_tokens long")


def _joined(tokens):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {str(i): t for t, i in tokens.value.items()}
        for batch in sliced(it):
            data = [b"".join([pieces[i] for i in x.split(",")]) if x else b"" for x in batch.column("ids").to_pylist()]
            rest = [c for c in batch.schema.names if c != "decoded"]
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(data, pa.binary())], [*rest, "decoded"])

    return batches


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (doc_id, ids, n_tokens) with decoded: the bytes of the ids' tokens put together; no ids give none."""
    tokens = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = encoded.select("doc_id", "ids", "n_tokens")
    return rows.mapInArrow(_joined(tokens), "doc_id long, ids string, n_tokens long, decoded binary")
