"""Filter models compiled to one boolean Column, applied to rows before any grouping.

Two kinds of models: by column ({field: condition}, all must hold) and advanced trees
({filterType: join, type: AND or OR, conditions: [...]}, leaves with colId).  Conditions:

    text    equals notEqual contains notContains startsWith endsWith blank notBlank
    number  equals notEqual lessThan lessThanOrEqual greaterThan greaterThanOrEqual inRange blank notBlank
    date    the same by whole days, and today yesterday last7Days last14Days last30Days thisMonth thisYear
    set     values; an empty set matches nothing
    multi   filterModels, all must hold
    {operator: AND or OR, conditions: [...]} of one column

Substring tests ignore case, equality does not; negations keep nulls; blank text is null or empty;
ranges hold both ends, and either may be missing; literals are converted to the column's type, and
one that cannot be matches nothing.  An unknown type or operator is an error.

A condition may be null where it does not hold, as in any WHERE; conditions on columns as they are
stored reach the scan.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygrid.schema import NUMERIC, SPARK_TYPES, col

#: Other names of the filter types.
_KINDS = {"agTextColumnFilter": "text", "agNumberColumnFilter": "number", "agDateColumnFilter": "date", "agSetColumnFilter": "set"}
_COMPARE = {"lessThan": operator.lt, "lessThanOrEqual": operator.le, "greaterThan": operator.gt, "greaterThanOrEqual": operator.ge}
#: First day of the presets that count back from today, which they hold.
_DAYS_BACK = {"today": 0, "last7Days": 6, "last14Days": 13, "last30Days": 29}
PRESETS = (*_DAYS_BACK, "yesterday", "thisMonth", "thisYear")


class FilterError(ValueError):
    """The filter model is not part of the language."""


def no() -> Column:
    return F.lit(False)


def both(parts: Iterable[Column]) -> Column | None:
    parts = list(parts)
    return functools.reduce(operator.and_, parts) if parts else None


def either(parts: Iterable[Column]) -> Column | None:
    parts = list(parts)
    return functools.reduce(operator.or_, parts) if parts else None


def preset_days(name: str, now: dt.datetime | dt.date | None = None) -> tuple[dt.date, dt.date]:
    """First and last day of a preset, in UTC; month and year run to today."""
    now = now or dt.datetime.now(dt.timezone.utc)
    if isinstance(now, dt.datetime):
        now = (now.astimezone(dt.timezone.utc) if now.tzinfo else now).date()
    if name == "yesterday":
        return now - dt.timedelta(1), now - dt.timedelta(1)
    if name == "thisMonth":
        return now.replace(day=1), now
    if name == "thisYear":
        return now.replace(month=1, day=1), now
    return now - dt.timedelta(_DAYS_BACK[name]), now


def literal(value: Any, kind: str | None) -> Column:
    """value as a Column of the column's type; null if it cannot be one."""
    if value is None:
        return F.lit(None)
    if kind == "string" or kind is None:
        return F.lit(value if isinstance(value, str) else _as_text(value))
    if isinstance(value, bool) and kind == "boolean":
        return F.lit(value)
    if kind == "float" and isinstance(value, (int, float)):
        return F.lit(float(value))
    if kind == "integer" and isinstance(value, int):
        return F.lit(value)
    if kind == "integer":  # 2.5 equals no whole number, so it must not be cut to one
        return F.lit(_as_text(value)).try_cast("double")
    return F.lit(_as_text(value)).try_cast(SPARK_TYPES.get(kind, T.TimestampNTZType()))


def _as_text(value: Any) -> str:
    """A value as text, whole numbers without a fraction and truth values in lower case."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def is_in(c: Column, kind: str | None, values: Sequence[Any]) -> Column:
    """One of the values, null among them if listed; no values match nothing."""
    some = [v for v in values if v is not None]
    out = c.isin(*[literal(v, kind) for v in some]) if some else no()
    return out | c.isNull() if len(some) < len(values) else out


def _blank(c: Column, kind: str | None) -> Column:
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def _equal(c: Column, value: Column | None, op: str) -> Column:
    """equals and notEqual; no value means null, and a null differs from every value."""
    if value is None:
        return c.isNull() if op == "equals" else c.isNotNull()
    return c == value if op == "equals" else (c != value) | c.isNull() | value.isNull()


def _text(c: Column, kind: str | None, op: str, value: Any) -> Column:
    if value is not None and not isinstance(value, (str, int, float, bool)):
        raise FilterError(f"a text filter compares with text, not {value!r}")
    if op in ("equals", "notEqual"):
        return _equal(c, None if value is None else literal(value, kind), op)
    if value is None:
        raise FilterError(f"{op} needs a text")
    needle, hay = F.lit(_as_text(value).lower()), F.lower(c.cast("string"))
    found = {"contains": F.contains, "notContains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](hay, needle)
    return ~F.coalesce(found, F.lit(False)) if op == "notContains" else found


def _ordered(c: Column, op: str, low: Column | None, high: Column | None) -> Column:
    """Comparison of one column with one literal, or with the ends of a range."""
    if op == "inRange":
        ends = ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
        if not ends:
            raise FilterError("inRange needs an end")
        return both(ends)
    if op in ("equals", "notEqual"):
        return _equal(c, low, op)
    if low is None:
        raise FilterError(f"{op} needs a value")
    return _COMPARE[op](c, low)


def _number(value: Any) -> Column | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise FilterError(f"a number filter compares with a number, not {value!r}")
    return F.lit(value)


def _day(value: Any) -> dt.date | None:
    if value is None:
        return None
    text = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value
    try:
        return dt.date.fromisoformat(str(text)[:10])
    except ValueError as e:
        raise FilterError(f"not a day: {value!r}") from e


def _by_day(c: Column, kind: str, op: str, low: dt.date | None, high: dt.date | None) -> Column:
    """Comparison by whole days.  A time is compared with the edges of days, so that the scan can use it."""
    if kind not in ("datetime", "datetime_ntz"):
        day = c if kind == "date" else c.cast("string").substr(1, 10).try_cast("date")
        return _ordered(day, op, *(None if d is None else F.lit(d) for d in (low, high)))
    start = lambda d: F.lit(d.isoformat()).cast("timestamp_ntz" if kind == "datetime_ntz" else "timestamp")
    after = lambda d: start(d + dt.timedelta(1))
    if op == "inRange":
        ends = ([c >= start(low)] if low else []) + ([c < after(high)] if high else [])
        if not ends:
            raise FilterError("inRange needs an end")
        return both(ends)
    if low is None:
        return _ordered(c, op, None, None)
    return {
        "equals": lambda: (c >= start(low)) & (c < after(low)),
        "notEqual": lambda: (c < start(low)) | (c >= after(low)) | c.isNull(),
        "lessThan": lambda: c < start(low),
        "lessThanOrEqual": lambda: c < after(low),
        "greaterThan": lambda: c >= after(low),
        "greaterThanOrEqual": lambda: c >= start(low),
    }[op]()


#: The operators that every kind of ordered condition has.
_ORDERED_OPS = ("equals", "notEqual", "inRange", *_COMPARE)


def condition(field: str, c: Mapping[str, Any], schema: Mapping[str, str], now: Any = None) -> Column:
    """One simple condition on one column."""
    kind = _KINDS.get(c.get("filterType"), c.get("filterType")) or "text"
    if field not in schema:
        raise FilterError(f"no column {field!r}")
    x, of, op = col(field), schema[field], c.get("type")
    if kind == "set":
        if not isinstance(c.get("values"), (list, tuple)):
            raise FilterError("a set filter needs values")
        return is_in(x, of, c["values"])
    if op in ("blank", "notBlank"):
        return _blank(x, of) if op == "blank" else ~_blank(x, of)
    if kind == "text" and op in ("equals", "notEqual", "contains", "notContains", "startsWith", "endsWith"):
        return _text(x, of, op, c.get("filter"))
    if kind == "number" and op in _ORDERED_OPS:
        # A column of another type is read as numbers, where its text is one; what is none compares with nothing.
        x = x if of in NUMERIC else x.cast("string").try_cast("double")
        return _ordered(x, op, _number(c.get("filter")), _number(c.get("filterTo")))
    if kind == "date" and op in (*_ORDERED_OPS, *PRESETS):
        if op in PRESETS:
            return _by_day(x, of, "inRange", *preset_days(op, now))
        return _by_day(x, of, op, _day(c.get("dateFrom", c.get("filter"))), _day(c.get("dateTo", c.get("filterTo"))))
    raise FilterError(f"no {kind} filter {op!r}")


def column_filter(field: str, c: Mapping[str, Any], schema: Mapping[str, str], now: Any = None) -> Column | None:
    """A simple, compound or multi condition on one column; None if it has no part."""
    if isinstance(c.get("conditions"), (list, tuple)) and isinstance(c.get("operator"), str):
        inherit = {"filterType": c["filterType"]} if c.get("filterType") else {}
        some = [{**inherit, **x} for x in c["conditions"]]
        if c["operator"].upper() == "OR":
            return one_of(field, some, schema) if _all_equal(some, schema.get(field)) else either(column_filter(field, x, schema, now) for x in some)
        return both(column_filter(field, x, schema, now) for x in some)
    if c.get("filterType") == "multi":
        return both(p for x in c.get("filterModels") or [] if x for p in [column_filter(field, x, schema, now)] if p is not None)
    return condition(field, c, schema, now)


def _all_equal(some: Sequence[Mapping], of: str | None) -> bool:
    """Are these conditions on a column of type `of` all equalities with values of that type?"""
    kinds = (None, "text", "number") if of in NUMERIC else (None, "text")
    name = lambda x: _KINDS.get(x.get("filterType"), x.get("filterType"))
    return bool(some) and all(name(x) == "set" or x.get("type") == "equals" and x.get("filter") is not None and name(x) in kinds for x in some)


def one_of(field: str, some: Sequence[Mapping], schema: Mapping[str, str]) -> Column:
    """Equalities of one column joined by OR: a list that the scan can use."""
    values = dict.fromkeys(v for x in some for v in (x["values"] if "values" in x else [x["filter"]]))
    return is_in(col(field), schema.get(field), list(values))


def advanced(node: Mapping[str, Any], schema: Mapping[str, str], now: Any = None) -> Column | None:
    """A node of an advanced tree; joins without conditions hold everything (AND) or nothing (OR)."""
    if node.get("filterType") == "join":
        some = node.get("conditions") or []
        if str(node.get("type", "AND")).upper() == "OR":
            fields = {x.get("colId") for x in some}
            if len(fields) == 1 and None not in fields and _all_equal(some, schema.get(next(iter(fields)))):
                return one_of(fields.pop(), some, schema)
            parts = [p if (p := advanced(x, schema, now)) is not None else F.lit(True) for x in some]
            return either(parts) if parts else no()
        return both(p for x in some for p in [advanced(x, schema, now)] if p is not None)
    return column_filter(node["colId"], node, schema, now) if node.get("colId") else None


def is_advanced(model: Mapping[str, Any] | None) -> bool:
    return bool(model) and (model.get("filterType") == "join" or isinstance(model.get("colId"), str))


def filter_model(model: Mapping[str, Any] | None, schema: Mapping[str, str], now: Any = None) -> Column | None:
    """The Column of a filter model of either kind; None if it filters nothing."""
    if not model:
        return None
    if is_advanced(model):
        return advanced(model, schema, now)
    return both(p for f, c in model.items() if c for p in [column_filter(f, c, schema, now)] if p is not None)


def active_model(by_column: Mapping | None, tree: Mapping | None) -> Mapping:
    """The model in force: an advanced tree wins."""
    return tree or by_column or {}


def quick_columns(schema: Mapping[str, str], key: str | None, fields: Sequence[str] | None = None) -> list[str]:
    """The text columns that the quick filter searches: not the key, and only `fields` where given."""
    return [n for n, t in schema.items() if t == "string" and n != key and (not fields or n in fields)]


def quick_filter(text: str | None, columns: Sequence[str]) -> Column | None:
    """The trimmed text, in any case, somewhere in one of the columns; no text filters nothing."""
    needle = (text or "").strip().lower()
    if not needle:
        return None
    return either(F.contains(F.lower(col(c)), F.lit(needle)) for c in columns) if columns else no()


def path_filter(fields: Sequence[str], keys: Sequence[Any], schema: Mapping[str, str]) -> Column | None:
    """Equality with the group keys, level by level; None is the null group, '' of a text column null or ''."""
    parts = []
    for f, k in zip(fields, keys, strict=False):
        x, of = col(f), schema.get(f)
        parts.append(x.isNull() if k is None else x.isNull() | (x == "") if k == "" and of == "string" else x == literal(k, of))
    return both(parts)


def with_path(model: Mapping[str, Any] | None, fields: Sequence[str], keys: Sequence[Any], schema: Mapping[str, str]) -> dict[str, Any]:
    """A by-column model with the group path in it; the path takes the place of a filter on the same field."""
    out = dict(model or {})
    for f, k in zip(fields, keys, strict=False):
        out[f] = {"filterType": "set", "values": [k]} if k != "" else {"filterType": "set", "values": [None, ""]}
    return out
