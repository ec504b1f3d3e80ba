"""Rows and files into frames that fit a schema."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarrygrid.schema import coerced, project, project_rows, schema_keys, struct

#: Fixed value: rows of a chunk.
CHUNK = 2500


def chunks(rows: Sequence[Any], size: int = CHUNK) -> Iterator[Sequence[Any]]:
    for k in range(0, len(rows), size):
        yield rows[k : k + size]


def empty(spark: SparkSession, schema: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame([], struct(schema))


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: Mapping[str, str], key: str | None) -> DataFrame:
    """Rows as a frame of the schema; values are coerced, what a row lacks is null."""
    names = schema_keys(schema, key) if key else list(schema)
    kinds = {n: schema.get(n, "string") for n in names}
    data = [tuple(r.get(n) if kinds[n] == "string" else coerced(r.get(n), kinds[n]) for n in names) for r in project_rows(rows, names)]
    return spark.createDataFrame(data, struct(kinds))


def read(spark: SparkSession, path: str, schema: Mapping[str, str] | None = None, key: str | None = None, format: str = "parquet", **options) -> DataFrame:
    """A file or folder in any format that Spark reads; only the schema's columns are scanned."""
    reader = spark.read.format(format).options(**options)
    if schema and format in ("csv", "json"):
        reader = reader.schema(struct(schema))
    df = reader.load(path)
    return project(df, schema, key) if schema else df
