"""Views out to files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygrid.schema import col


def export_columns(definitions: Sequence[Mapping], hidden: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(field, heading) of the displayed columns that have a field, in order."""
    return [(d["field"], d.get("headerName") or d["field"]) for d in definitions if d.get("field") and not d.get("hide") and d["field"] not in hidden]


def export_frame(df: DataFrame, columns: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """The columns under their headings; fields that the view does not have are passed over."""
    return df if columns is None else df.select(*[col(f).alias(h) for f, h in columns if f in df.columns])


def write(df: DataFrame, path: str, format: str = "csv", columns: Sequence[tuple[str, str]] | None = None, limit: int | None = None, mode: str = "error", **options) -> None:
    """Writes a view in any format that Spark writes; csv has a heading line.

    A limit is taken before the write and keeps the view's order.  xlsx goes through pandas and
    needs a spreadsheet writer; it is for small exports only, so it wants a limit.
    """
    out = export_frame(df if limit is None else df.limit(limit), columns)
    if format == "xlsx":
        if limit is None:
            raise ValueError("a spreadsheet export needs a limit")
        out.toPandas().to_excel(path, index=False)
        return
    if format == "csv":
        options = {"header": True, "nullValue": ""} | options
        out = out.select(*[col(n) if t not in ("timestamp", "timestamp_ntz") else F.date_format(col(n), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias(n) for n, t in out.dtypes])
    out.write.format(format).options(**options).mode(mode).save(path)
