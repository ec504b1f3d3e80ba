"""Sorting and windows of rows: nulls last in both directions, ties by key, so pages never overlap."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygrid.model import Sort
from quarrygrid.schema import NUMERIC, col

#: Fixed value: how grids name the column that shows the group.
AUTO_GROUP = "ag-Grid-AutoColumn"


def order_by(sort: Sequence[Sort], columns: Collection[str], ties: Sequence[str], types: Mapping[str, str], abs_sort: bool = False, group: str | None = None) -> list[Column]:
    """Sort keys; unknown columns are passed over.

    abs_sort makes every sort of a numeric column of `types` one by absolute value; of a pivot
    column the type is that of its measure.
    """
    out = []
    for s in sort:
        name = group if s.field == AUTO_GROUP and group else s.field
        if name not in columns:
            continue
        numeric = types.get(name.rsplit("|", 1)[-1]) in NUMERIC
        x = F.abs(col(name)) if s.absolute and numeric or abs_sort and numeric else col(name)
        out.append(x.desc_nulls_last() if s.descending else x.asc_nulls_last())
    return out + [col(t).asc_nulls_last() for t in ties if t in columns]


def window(df: DataFrame, order: Sequence[Column], start: int = 0, end: int | None = None) -> DataFrame:
    """Rows [start, end) of df in order; a bounded window is planned as a top-k, not as a full sort."""
    out = df.orderBy(*order) if order else df
    if start:
        out = out.offset(start)
    return out if end is None else out.limit(max(0, end - start))
