"""Small frames from Python rows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StructType


def _plain(value, kind: DataType):
    if value is None:
        return None
    if isinstance(kind, ArrayType):
        return [_plain(x, kind.elementType) for x in value]
    if isinstance(kind, StructType):
        return {f.name: _plain(x, f.dataType) for f, x in zip(kind.fields, value, strict=True)}
    return value


def local_frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few rows as a relation that is part of the plan: its size is known, and no Python worker reads it."""
    kind = StructType.fromDDL(schema)
    table = pa.Table.from_pylist([_plain(r, kind) for r in rows], schema=to_arrow_schema(kind))
    return spark.createDataFrame(table, schema=kind)
