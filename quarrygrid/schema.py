"""Column types, and schemas from declarations and one sample row.

Types: string, float, integer, date, datetime, boolean.  A declared type wins, then the cell
type, then the sample value, then string.  Nested declarations are walked; scalar fields of the
sample that nobody declared are added, arrays and objects are not; the key is always there; a
declaration with an expression is a calculated column and not part of the schema.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "float": T.DoubleType(),
    "integer": T.LongType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "boolean": T.BooleanType(),
}
#: What a cell type says about the column.
CELL_TYPES = {"number": "float", "text": "string", "date": "date", "dateString": "string", "boolean": "boolean"}
NUMERIC = ("float", "integer")


def col(name: str) -> Column:
    """A column by its literal name, which may hold dots and back quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of_value(value: Any) -> str | None:
    """The type that one sample value suggests; None for null, arrays and objects.

    A whole number suggests float: later rows may hold fractions, and nothing else was declared.
    """
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "float"
    if isinstance(value, dt.datetime):
        return "datetime"
    if isinstance(value, dt.date):
        return "date"
    return "string" if isinstance(value, str) else None


def type_of_field(kind: T.DataType) -> str | None:
    """The type of a Spark column; None for what the query surface has no type for."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "string" if isinstance(kind, T.StringType) else None


def leaves(definitions: Iterable[Mapping]) -> Iterator[Mapping]:
    """The column declarations, header groups unfolded."""
    for d in definitions:
        if d.get("children"):
            yield from leaves(d["children"])
        elif d.get("field"):
            yield d


def derive(definitions: Iterable[Mapping], key: str, sample: Mapping[str, Any] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(schema, calculated expressions) of declarations with field, type, cellDataType, expression."""
    sample, schema, calc = sample or {}, {}, {}

    def kind(field: str, d: Mapping) -> str:
        return d.get("type") or CELL_TYPES.get(d.get("cellDataType")) or type_of_value(sample.get(field)) or "string"

    for d in leaves(definitions):
        if d.get("expression"):
            calc[d["field"]] = d["expression"]
        else:
            schema[d["field"]] = kind(d["field"], d)
    for field, value in sample.items():
        if field not in schema and field not in calc and (t := type_of_value(value)):
            schema[field] = t
    if key not in schema and key not in calc:
        schema[key] = kind(key, {})
    return schema, calc


def of_frame(df: DataFrame) -> dict[str, str]:
    """The schema of a frame's columns that have a type here."""
    return {f.name: t for f in df.schema.fields if (t := type_of_field(f.dataType))}


def schema_keys(schema: Mapping[str, str], key: str) -> list[str]:
    return [*schema, *([] if key in schema else [key])]


def struct(schema: Mapping[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK_TYPES[t]) for n, t in schema.items()])


def project(df: DataFrame, schema: Mapping[str, str], key: str | None) -> DataFrame:
    """The columns of the schema (and the key) that df has; columns stay unconverted where their type fits."""
    have = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in (schema_keys(schema, key) if key else schema) if n in have]
    out = []
    for n in names:
        want = schema.get(n)
        out.append(col(n) if not want or type_of_field(have[n]) == want else col(n).cast(SPARK_TYPES[want]).alias(n))
    return df.select(*out) if out else df


def project_rows(rows: Sequence[Mapping[str, Any]], keys: Sequence[str]) -> list[dict[str, Any]]:
    """Rows with the keys alone; a key that a row lacks stays absent.  Without rows or keys, copies."""
    if not rows or not keys:
        return [dict(r) for r in rows]
    return [{k: r[k] for k in keys if k in r} for r in rows]


def coerced(value: Any, kind: str | None) -> Any:
    """An edited cell as its column's type: empty text is null, integers are cut, the rest is text."""
    if value is None or value == "":
        return None
    if kind in NUMERIC:
        try:
            number = float(value)
        except (TypeError, ValueError):
            return None
        return int(number) if kind == "integer" else number
    if kind == "boolean":
        return value if isinstance(value, bool) else str(value).lower() == "true"
    if kind in ("date", "datetime"):
        return value
    return str(value)
