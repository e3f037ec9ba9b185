"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records rebuilt by a join.

Payloads are keyed by SHA-256, which is computed again from the stored bytes on reading. Headers are the bytes of
WARC/1.1 record headers, and of the HTTP header that a response's block starts with. ``records`` joins both to whole
records, ``parsed`` reads records back, ``export`` and ``load`` go through plain .warc files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

_ID = "urn:evidq:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _base32(hexadecimal: Column) -> Column:
    """The 40 hexadecimal digits of a SHA-1 in base 32, as WARC files write it: five digits are four."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def _base16(base32: Column) -> Column:
    digits = F.translate(base32, _BASE32, _DIGITS)
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(digits, i, 4), 32, 16), 5, "0") for i in range(1, 33, 4))))


def _http(size: Column) -> Column:
    """The HTTP header before the payload of a response."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def _header(date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    named = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit, size = F.col("record_type") == "revisit", F.col("size")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", named("page_id")),
        line("WARC-Date", F.lit(date)),
        F.when(uri != "", line("WARC-Target-URI", uri)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha1")))),
        line("WARC-Payload-Length", size.cast("string")),  # an extension field: a revisit's block doesn't tell
        F.when(revisit, F.concat(line("WARC-Refers-To", named("refers_to")), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.octet_length(_http(size)) + size).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(_http(size)),
    ).cast("binary")


def archive(pages: DataFrame, least: int = 1000, date: str = "2000-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` (page_id, url, html): the stored headers (header, sha256, revisit) and payloads (sha256, payload).

    One header per row. Of equal payloads of ``least`` bytes or more, the rows with the largest page_id are responses
    and the others revisit them; with only null page_ids all are responses, and null ids revisit any other. Smaller
    payloads are all responses, their bytes stored once too. A null html is an empty payload, a null url leaves out the
    target. Rows that repeat give a record each. Other columns are ignored; an empty table gives an empty archive.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.length("payload").cast("long")})
    payloads = stored(rows.select("sha256", "payload").dropDuplicates(["sha256"]), "warc-payloads", codec="zstd")
    owner = rows.where(F.col("size") >= least).groupBy(F.col("sha256").alias("of")).agg(F.max("page_id").alias("owner"))
    heads = rows.select("page_id", "url", "sha256", "sha1", "size").join(owner, F.col("sha256") == F.col("of"), "left")
    again = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    heads = heads.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("owner")))
    heads = heads.select(_header(date).alias("header"), "sha256", (F.col("record_type") == "revisit").alias("revisit"))
    return stored(heads, "warc-headers", codec="zstd"), payloads


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Rebuild every record, byte by byte: (record). A revisit has no block.

    Fails if the stored bytes of a payload don't have the digest that they are stored by, or are missing.
    """
    fine = F.sha2("payload", 256) == F.col("sha256")
    checked = payloads.withColumn("payload", F.when(fine, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary")))
    # a revisit takes no payload along
    responses, revisits = headers.where("NOT revisit"), headers.where("revisit")
    body = F.coalesce("payload", F.raise_error(F.lit("a payload is missing")).cast("binary"))
    end = F.lit(b"\r\n\r\n")
    whole = responses.join(checked, "sha256", "left").select(F.concat("header", body, end).alias("record"))
    return whole.union(revisits.select(F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """What records (record) say: page_id, record_type, refers_to, target, payload, payload_bytes, payload_digest.

    The payload of a response is what follows its HTTP header, its size and digest are computed from it and must be as
    the record's header says; a revisit has no payload of its own (null), and size and digest are its header's.
    """
    text = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    rows = records.select("record", F.concat(text, F.lit("\r\n")).alias("head"))
    field = lambda name, value: F.regexp_extract("head", rf"\r\n{name}: {value}\r\n", 1)
    number = lambda name: field(name, rf"<{_ID}(-?\d*)>").try_cast("long")
    rows = rows.select(
        "record", number("WARC-Record-ID").alias("page_id"), field("WARC-Type", r"(\w+)").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI", r"([^\r]*)").alias("target"), _base16(field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})")).alias("digest"),
        field("WARC-Payload-Length", r"(\d+)").cast("long").alias("size"), (F.octet_length("head") + 2).alias("start"),
        field("Content-Length", r"(\d+)").cast("int").alias("length"),
    )
    # the payload is the end of the block
    payload = F.expr("substring(record, CAST(start + length - size + 1 AS INT), CAST(size AS INT))")
    rows = rows.withColumn("payload", F.when(F.col("record_type") == "response", payload))
    own = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("digest"))
    bytes_ = F.when(F.col("payload").isNotNull(), F.octet_length("payload")).otherwise(F.col("size")).cast("long")
    fine = (own == F.col("digest")) & (bytes_ == F.col("size"))
    digest = F.when(fine, own).otherwise(F.raise_error(F.lit("a record's payload isn't what its header says")))
    return rows.select("page_id", "record_type", "refers_to", "target", "payload", bytes_.alias("payload_bytes"), digest.alias("payload_digest"))


def export(records: DataFrame, path: str, rows: int = 5000) -> None:
    """Write records as .warc text files of at most ``rows`` records under ``path``; payloads are UTF-8."""
    # the line separator is a record's last line end
    text = records.select(F.expr("substring(record, 1, octet_length(record) - 2)").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n").option("maxRecordsPerFile", rows).text(path)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for data in batch.column("content").to_pylist():
            out, at = [], 0
            while at < len(data):
                block = data.index(b"\r\n\r\n", at) + 4
                length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at:block]).group(1))
                out.append(data[at : block + length + 4])
                at = block + length + 4
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def load(spark: SparkSession, path: str) -> DataFrame:
    """(record) of the .warc files under ``path``, cut by their content lengths; a file is read by one task."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_cut, "record binary")


#: Columns of ``op5_warc``.
ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) AS h, sha256(body) AS k FROM p
), o AS (
  SELECT k, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY k
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN owner IS NOT NULL AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner IS NOT NULL AND page_id <> owner THEN owner END AS refers_to
FROM d LEFT JOIN o USING (k)
"""
