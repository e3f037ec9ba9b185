"""Removal of repeated passages by Rabin-Karp hashes of every fixed-length word window.

A window's hash is a polynomial in the hashes of its words, so all windows of a text come from a few passes. A window
can only stand in two documents if its anchor does: the run of ``anchor`` words inside it with the smallest hash, which
is the same wherever the window stands. Anchors are a fraction of the windows; they are counted first, and only windows
with an anchor in two documents are counted in turn, by 96 bits of hashes. What of a document's windows also starts in one with a smaller id
is merged into maximal intervals and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, sliced, small, stored

_BASE, _CHECK_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _runs(words: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of all runs of n words."""
    size = len(words) - n + 1
    if size < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * base + words[j : j + size]
    return _mix(h)


def _checks(words: np.ndarray, n: int) -> np.ndarray:
    """32 bits more of every run, by another polynomial."""
    return (_runs(words ^ (words >> np.uint64(29)), n, _CHECK_BASE) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _windows(words: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and anchor of every window."""
    full, part = _runs(words, width), _runs(words, anchor)
    least = part[: len(full)].copy()
    for j in range(1, width - anchor + 1):
        np.minimum(least, part[j : j + len(full)], out=least)
    return full, least


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Index, words and word hashes of each row; words are hashed for many rows at once."""
    texts, at = batch.column("text").to_pylist(), 0
    while at < len(texts):
        lists, size, start = [], 0, at
        while at < len(texts) and (size < _CHUNK or start == at):
            lists.append(words_of(texts[at]))
            size += len(lists[-1])
            at += 1
        flat = np.array([w for x in lists for w in x] or [b""], dtype=object)
        h, done = pd.util.hash_array(flat, categorize=False), 0
        for i, x in enumerate(lists):
            yield start + i, x, h[done : done + len(x)]
            done += len(x)


def _longs(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts).astype(np.int64)) if parts else pa.array([], pa.int64())


def _anchors(width: int, anchor: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            ids, out, owner = batch.column("doc_id").to_pylist(), [], []
            for i, _, h in _hashed(batch):
                out.append(np.unique(_windows(h, width, anchor)[1]))
                owner.append(np.full(len(out[-1]), ids[i], np.int64))
            yield pa.record_batch([_longs(out), _longs(owner)], ["hash", "doc_id"])

    return batches


def _repeated(width: int, anchor: int):
    """Windows whose anchor is one of the row's repeated anchors."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            ids, known, out, owner, check = batch.column("doc_id").to_pylist(), batch.column("hashes"), [], [], []
            for i, _, h in _hashed(batch):
                full, least = _windows(h, width, anchor)
                mine = known[i].values.to_numpy().astype(np.uint64)
                hit = np.flatnonzero(np.isin(least, mine))
                one, at = np.unique(full[hit], return_index=True)
                out.append(one)
                check.append(_checks(h, width)[hit[at]])
                owner.append(np.full(len(one), ids[i], np.int64))
            yield pa.record_batch([_longs(out), pa.array(np.concatenate([*check, np.empty(0, np.int32)])), _longs(owner)], ["hash", "check", "doc_id"])

    return batches


def _cut(width: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            rows: list[tuple] = []
            texts, known = batch.column("text").to_pylist(), batch.column("hashes")
            for i, words, h in _hashed(batch):
                spans, text, gone = [], texts[i], 0
                if known[i].is_valid:
                    hit = np.flatnonzero(np.isin(_runs(h, width), known[i].values.to_numpy().astype(np.uint64)))
                    for at in hit.tolist():
                        if spans and at <= spans[-1]["end"]:
                            spans[-1]["end"] = at + width
                        else:
                            spans.append({"start": at, "end": at + width})
                    gone = sum(s["end"] - s["start"] for s in spans)
                keep = [w for a, b in zip([0, *(s["end"] for s in spans)], [*(s["start"] for s in spans), len(words)], strict=True) for w in words[a:b]]
                joined = b" ".join(keep)
                if gone:
                    text = joined.decode("utf-8", "surrogatepass")
                rows.append((len(words), gone, spans, text, hashlib.sha256(joined).hexdigest()))
            n, gone, spans, text, digest = zip(*rows, strict=True) if rows else ((),) * 5
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(text, pa.string()), pa.array(digest, pa.string())]
            rest = [c for c in batch.schema.names if c not in ("text", "hashes")]
            yield pa.record_batch([*(batch.column(c) for c in rest), *new], [*rest, "n_words", "n_removed", "spans", "text", "kept_sha256"])

    return batches


def _shared(hashes: DataFrame, *key: str) -> DataFrame:
    """Keys that stand in two documents at least, with the smallest doc_id."""
    both = hashes.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return both.where("low <> high").select(*key, "low")


def repeated_windows(docs: DataFrame, width: int = 13, anchor: int = 6) -> DataFrame:
    """(doc_id, hashes): per document the hashes of its windows that also start in a document with a smaller id."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = stored(docs.mapInArrow(_anchors(width, anchor), "hash long, doc_id long"), "anchors")
    shared = stored(_shared(anchors, "hash").select("hash"), "shared-anchors")
    of_doc = anchors.join(small(shared), "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    of_doc = stored(of_doc, "document-anchors")
    dropped(anchors, shared)
    windows = docs.join(small(of_doc, 10_000), "doc_id").select("doc_id", "text", "hashes")
    # windows are told apart by 96 bits: at 10^13 of them, two different ones are taken for equal with odds of 1 in 1000
    windows = stored(windows.mapInArrow(_repeated(width, anchor), "hash long, check int, doc_id long"), "windows")
    shared = stored(_shared(windows, "hash", "check"), "shared-windows")
    later = windows.join(small(shared), ["hash", "check"]).where("doc_id > low")
    later = stored(later.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")), "document-windows")
    dropped(of_doc, windows, shared)
    return later


def remove_repeats(docs: DataFrame, width: int = 13, anchor: int = 6, carried: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns ``carried``, n_words, n_removed, spans, text, kept_sha256.

    A window is ``width`` consecutive words (runs of anything but ASCII white space, unchanged) of one document. Every
    word covered by a window whose word sequence also starts in a document with a smaller doc_id is removed; windows are
    judged on the texts as given, and spans are the maximal intervals [start, end) of removed words. text is the kept
    words joined by one space if any was removed, else as it was; kept_sha256 is of the kept words so joined. Null
    texts stay null and have no words. Rows with a null doc_id lose nothing and take nothing. Rows that repeat a doc_id
    are one document, none smaller than the other. Repeats inside a document stay. Other columns than those carried are
    ignored; an empty table gives no rows.
    """
    later = repeated_windows(docs, width, anchor).withColumnRenamed("doc_id", "_of")
    rows = docs.select("doc_id", *carried, "text")
    rows = rows.join(small(later, 10_000), rows.doc_id == F.col("_of"), "left").select("doc_id", *carried, "text", "hashes")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carried).schema)
    new = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string, kept_sha256 string"
    return rows.mapInArrow(_cut(width), f"doc_id long, {kept}{new}")
