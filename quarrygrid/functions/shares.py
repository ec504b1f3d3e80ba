"""Shares of an aggregate: value / aggregate, as a number, as text, and against a limit."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(value: Column, total: Column) -> Column:
    """value / total; null if the total is null, zero, or not finite."""
    v, t = value.cast("double"), total.cast("double")
    bad = F.isnan(t) | (F.abs(t) == float("inf"))
    return F.when(~bad, F.try_divide(v, t))


def as_percent(x: Column, digits: int = 2) -> Column:
    """'25.00%'; null stays null."""
    return F.when(x.isNotNull(), F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%")))


def exceeds(x: Column, limit: float) -> Column:
    """Strictly above the limit; a missing share is not."""
    return F.coalesce(x > limit, F.lit(False))


def resolved(field: str, func: str, stamped: Mapping[str, Mapping[str, Any]] | None, context: Mapping[str, Mapping[str, Any]] | None, default: Any = None) -> Any:
    """An aggregate that a row refers to: what is stamped on the row goes before what its page has."""
    for matrix in (stamped, context):
        if matrix and func in (matrix.get(field) or {}):
            return matrix[field][func]
    return default
