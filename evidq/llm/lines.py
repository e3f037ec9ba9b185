"""Removal of lines that spread over many sites, counted with HyperLogLog sketches.

A first aggregation keeps the lines seen on two sites at least. For these, one sketch of sites per line hash is built
and merged by aggregation. Lines whose estimate lies near the threshold get an exact distinct count; only the others
are decided by their estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, dropped, small, stored

_BLANK = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    lines = docs.select(
        "doc_id", F.col(site).alias("site"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    line = F.trim("line", F.lit(_BLANK))
    lines = lines.where(F.length(line) >= min_chars)
    return lines.select("doc_id", "site", "text_hash", "pos", F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def spread_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, min_chars: int = 1, lg_k: int = 12) -> DataFrame:
    """Line hashes (h, g) seen on at least ``min_sites`` distinct sites, with the place (doc_id, pos) of the first."""
    lines = _lines(docs, site, min_chars)
    several = lines.groupBy("h", "g").agg(F.min("site").alias("low"), F.max("site").alias("high")).where("low <> high").select("h", "g")
    several = stored(several, "several")
    n = several.count()
    on_sites = lines.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, ["h", "g"])
    sketches = on_sites.groupBy("h", "g").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first"),
    )
    sketches = stored(sketches.select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("sites")), "sketches")
    band = max(1, round(6 * 1.04 / 2 ** (lg_k / 2) * min_sites))
    near = sketches.where(f"sites BETWEEN {min_sites - band} AND {min_sites + band}").select("h", "g", "first")
    exact = lines.join(small(near), ["h", "g"]).select("h", "g", "first", "site").distinct()
    exact = exact.groupBy("h", "g", "first").agg(F.count("site").alias("sites")).where(f"sites >= {min_sites}")
    clear = sketches.where(f"sites > {min_sites + band}")
    out = stored(clear.select("h", "g", "first").union(exact.select("h", "g", "first")), "spread", n)
    dropped(several, sketches)
    return out


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, min_chars: int = 1, lg_k: int = 12) -> DataFrame:
    """``docs`` with its columns, and n_lines and n_removed last; text is without the lines found on many sites.

    A line is what stands between newlines, compared without the blanks around it. Blank lines always stay; every other
    line is counted, unless a larger ``min_chars`` exempts those of fewer characters. A line on at least ``min_sites``
    distinct values of ``site`` is removed everywhere but where it comes first: in the smallest doc_id, at its first place there. A null site is no site, but its documents lose lines too;
    rows with a null doc_id never come first. A null text stays null, with no lines. Rows of equal doc_id and text
    are treated alike. A document can end up empty; its row stays. Other columns pass through, whatever their names, but
    for n_lines and n_removed, which are replaced.
    """
    spread = spread_lines(docs, site, min_sites, min_chars, lg_k)
    hits = _lines(docs, site, min_chars).join(small(spread), ["h", "g"])
    first = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))
    hits = hits.where(~F.coalesce(first, F.lit(False))).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    hits = stored(hits, "hits").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "gone")
    # the row as one column, so that no name of its columns can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    met = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("row.text") == F.col("hit_hash"))
    both = rows.join(small(hits), met, "left")
    lines = F.split("row.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return both.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in kept), n_lines.alias("n_lines"), n_gone.alias("n_removed"))


#: Columns of ``op3_line_dedup``: doc_id, n_lines, n_removed, text_sha256.
ORACLE = """
WITH parts AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts
), cut AS (
  SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM numbered
), spread AS (
  SELECT body, min({'d': doc_id, 'p': pos}) AS first FROM cut WHERE length(body) >= 1
  GROUP BY body HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT cut.*, spread.body IS NOT NULL AND first <> {'d': doc_id, 'p': pos} AS gone FROM cut LEFT JOIN spread USING (body)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
