"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space, which is also what ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side may be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Rows of a pair of ids up to which it may be broadcast, a few megabytes.
BROADCAST_IDS = 200_000
#: Rows of narrow tables in one file.
ROWS_A_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a session in one process (tests) may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evidq-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    ``rows`` is an upper bound of its rows, if one is known; the files then hold up to ROWS_A_FILE rows each, as many
    small files cost more than they hold. ``codec`` is for tables of texts, where a slower one saves much disk.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # the shuffle files of this write are of no use once it is done
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, with the hint to broadcast it if it has at most ``rows`` rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def sliced(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, as whole texts can be long; at the end Arrow's spare memory goes back."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def non_empty(column: str | F.Column) -> F.Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
