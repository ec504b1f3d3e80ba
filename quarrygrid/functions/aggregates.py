"""Aggregates by name.

sum is 0 over nothing where grand totals ask for it; first, last and lastByIndex follow an order
column, not the physical order; countDistinct ignores null unless told otherwise; weightedAvg is
sum(v * w) / sum(w) over rows with a value and a weight that is not zero; trafficLight folds a
minimum and a maximum: 1 if both are 1, 3 if both are 3, null if one is missing, else 2.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other spellings of the aggregates' names.
SYNONYMS = {"mean": "avg", "distinct": "countDistinct", "distinct count": "countDistinct", "rag": "trafficLight", "last by index": "lastByIndex"}
#: What is computed for every default measure.
DEFAULT_FUNCTIONS = ("sum", "avg", "min", "max", "count")


@dataclass(frozen=True)
class Context:
    """What an aggregate may need besides its column."""

    order: Column | None = None
    weight: Column | None = None
    empty_sum: bool = False
    count_null: bool = False


class UnknownAggregate(ValueError):
    pass


def _ordered(pick: Callable[[Column, Column], Column]) -> Callable[[Column, Context], Column]:
    def build(x: Column, c: Context) -> Column:
        if c.order is None:
            raise UnknownAggregate("first and last need a key or another column to order by")
        # A struct keeps a null of the chosen row, which the plain form would pass over.
        return pick(F.struct(x.alias("v")), c.order)["v"]

    return build


def _weighted(x: Column, c: Context) -> Column:
    if c.weight is None:
        raise UnknownAggregate("weightedAvg needs a weight column")
    used = x.isNotNull() & c.weight.isNotNull() & (c.weight != 0)
    return F.try_divide(F.sum(F.when(used, x * c.weight)), F.sum(F.when(used, c.weight)))


def _distinct(x: Column, c: Context) -> Column:
    n = F.count_distinct(x)
    return n + F.max(F.when(x.isNull(), 1).otherwise(0)).cast("long") if c.count_null else n


def _light(x: Column, _: Context) -> Column:
    return fold_light(F.min(x), F.max(x))


def fold_light(low: Column, high: Column) -> Column:
    missing = low.isNull() | high.isNull() | F.isnan(low.cast("double")) | F.isnan(high.cast("double"))
    return F.when(missing, F.lit(None)).when((low == 1) & (high == 1), 1).when((low == 3) & (high == 3), 3).otherwise(2).cast("int")


REGISTRY: dict[str, Callable[[Column, Context], Column]] = {
    "sum": lambda x, c: F.coalesce(F.sum(x), F.lit(0)) if c.empty_sum else F.sum(x),
    "avg": lambda x, _: F.avg(x),
    "count": lambda x, _: F.count(x),
    "min": lambda x, _: F.min(x),
    "max": lambda x, _: F.max(x),
    "first": _ordered(F.min_by),
    "last": _ordered(F.max_by),
    "lastByIndex": _ordered(F.max_by),
    "countDistinct": _distinct,
    "median": lambda x, _: F.median(x),
    "stddev": lambda x, _: F.stddev_samp(x),
    "var": lambda x, _: F.var_samp(x),
    "weightedAvg": _weighted,
    "trafficLight": _light,
    "any": lambda x, _: F.any_value(x),
}


def register(name: str, build: Callable[[Column, Context], Column]) -> None:
    """Adds an aggregate: build takes the measure's Column and a Context and returns an aggregate Column."""
    REGISTRY[name] = build


def known(name: str | None) -> str:
    """The registered name of an aggregate; sum if none is given."""
    name = name or "sum"
    name = SYNONYMS.get(name, name)
    if name not in REGISTRY:
        raise UnknownAggregate(f"no aggregate {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return name


def aggregate(name: str | None, x: Column, context: Context | None = None) -> Column:
    return REGISTRY[known(name)](x, context or Context())


def alias(field: str, name: str) -> str:
    """One field with several aggregates: a column name for each."""
    return f"agg_{field}_{re.sub(r'[^a-zA-Z0-9]+', '_', name)}"
