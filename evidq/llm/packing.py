"""Best-fit packing of token sequences into bins of fixed length, by hierarchical residual rounds.

Texts become ids; longer ones are cut. In each round, partitions pack their items by best fit, largest first, and emit
the bins that are nearly full; the others go on as items, with what they hold, into a round over fewer partitions. Rounds
end with one partition, or once merging hardly helps; a task holds lengths and places, never texts or ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, non_empty, sliced, stored

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
#: Items of one task, and how many partitions merge into one in each round.
TASK_ITEMS, FAN_IN = 200_000, 8
_BREAK = re.compile(r"(?<=\S) (?=\S)")


#: Characters that are encoded at once; longer texts are parted where the tokenizer parts them anyway.
_AT_ONCE = 1 << 18


def parted(text: str, size: int = _AT_ONCE) -> Iterator[str]:
    """Parts of ``text``, cut before a single blank that no white space follows, and never sooner than after ``size``.

    A byte-level pattern starts a word there whatever stands around, so the ids of the parts are those of the text.
    """
    at = 0
    while len(text) - at > size and (found := _BREAK.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text: whole up to ``size``, else full pieces behind a first that may be shorter."""
    if length <= size:
        return [(0, length)]
    first = length % size or size
    return [(0, first), *((at, size) for at in range(first, length, size))]


def encoder(path: str, pattern: str):
    """An encoder of the byte-level tokenizer file ``path`` that gives its ids as arrays.

    The vocabulary and the special tokens are read through the tokenizers library; texts are encoded by tiktoken, which
    merges by the same ranks in a quarter of the time. ``pattern`` is the file's split into words.
    """
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    # byte-level vocabularies write a byte as the character of its code, or as one from 256 on if it isn't printable
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    rest = iter(range(256, 512))
    byte = {chr(b if b in plain else next(rest)): b for b in range(256)}
    special = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model.get_vocab(with_added_tokens=False).items() if t not in special}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: own.encode_to_numpy(text, allowed_special="all")


def _pieces(path: str, pattern: str, end: int, size: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path, pattern), np.array([end], "<u4")
        for batch in sliced(it):
            rows = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                ids = np.concatenate([*map(encode, parted(text)), tail]).astype("<u4")
                for piece, (at, n) in enumerate(cut(len(ids), size)):
                    rows.append((doc_id, piece, at, n, zlib.crc32(ids[at : at + n])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return batches


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: largest first, into the open bin with the least room that is enough."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    room, count = 0, 0  # bit r of room: some open bin has room for r more
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = room >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                room ^= 1 << left
        else:
            left, b, count = size, count, count + 1
        bins[i], offsets[i] = b, size - left
        left -= n
        if left:
            open_[left].append(b)
            room |= 1 << left
    return bins, offsets


def _round(size: int, full: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in it if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).sort_by([("fill", "descending"), ("name", "ascending")]).combine_chunks()
        members = t.column("members").combine_chunks()
        fills = t.column("fill").to_numpy()
        bins, offsets = best_fit(fills, size)
        order = np.lexsort((offsets, bins))
        taken = members.take(pa.array(order))
        per = np.diff(taken.offsets.to_numpy())
        flat = taken.flatten()
        shift = np.repeat(offsets[order], per)
        at = [flat.field(i) for i in range(5)] + [pa.array(flat.field(5).to_numpy() + shift)]
        n = np.bincount(bins[order], weights=per).astype(np.int64)
        kind = members.type.value_type
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays(at, fields=list(kind)))
        total = np.bincount(bins, weights=fills).astype(np.int64)
        first = out.flatten().take(pa.array(np.cumsum(n) - n))
        name = [f"{a} {b}" for a, b in zip(first.field(0).to_pylist(), first.field(1).to_pylist(), strict=True)]
        for i in range(0, len(total), 4096):
            own = slice(i, i + 4096)
            yield pa.record_batch(
                [pa.array(name[own]), pa.array(total[own]), pa.array(total[own] >= full), out.slice(i, 4096)], ["name", "fill", "closed", "members"]
            )

    return batches


def pack(pieces: DataFrame, size: int = 1024, slack: int = 0, task_items: int = TASK_ITEMS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Bins are filled without gaps from 0, and hold at most ``size``. A bin with at most ``slack`` left is closed in the
    round that made it, so that with no slack every bin with room goes on; in the last round all are closed. Lengths lie
    in 1..size. Rows that repeat are packed each.
    """
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    name = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    items = pieces.select(name.alias("name"), F.col("length").alias("fill"), F.array(item).cast(_MEMBER).alias("members"))
    schema = f"name string, fill long, closed boolean, members {_MEMBER}"
    whole = items.where(F.col("fill") >= size - slack).withColumn("closed", F.lit(True)).select("name", "fill", "closed", "members")
    items = items.where(F.col("fill") < size - slack)
    n = items.count()
    parts, done, rounds, last = max(1, -(-n // task_items)), [whole], [], None
    while True:
        # by a hash of the name, so that a task that runs again meets the same items
        dealt = items.repartition(parts, F.xxhash64("name"))
        made = stored(dealt.mapInArrow(_round(size, size - slack), schema), "bins")
        rounds.append(made)
        rest = made.where("NOT closed")
        left = rest.count()
        if parts == 1 or last is not None and left > 0.999 * last:
            done.append(made)
            break
        done.append(made.where("closed"))
        items, last = rest.select("name", "fill", "members"), left
        parts = max(-(-parts // FAN_IN), -(-left // task_items))
    bins = done[0]
    for more in done[1:]:
        bins = bins.union(more)
    bins = stored(bins.select("members"), "sequences")
    dropped(*rounds)
    bins = bins.withColumn("sequence_id", F.monotonically_increasing_id())
    return bins.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, size: int = 1024, end: int = 2, slack: int = 0) -> DataFrame:
    """Tokenise and pack every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text by the tokenizer file, then ``end``. Documents up to ``size`` stay whole;
    longer ones are cut into pieces of ``size``, the first may be shorter. A null or empty text is the end id alone. A
    null doc_id stays null, rows that repeat are packed each, other columns are ignored, and an empty table gives no
    rows. ``pattern`` is the tokenizer's own split into words. The strings of special tokens get their own ids, as the
    tokenizer gives them by itself. Texts over 2^18 characters are encoded in parts, cut where the pattern starts a word
    whatever stands around.
    """
    texts = docs.select("doc_id", non_empty("text").alias("text"))
    pieces = stored(texts.mapInArrow(_pieces(tokenizer, pattern, end, size), _PIECES), "pieces")
    out = pack(pieces, size, slack)
    dropped(pieces)
    return out
