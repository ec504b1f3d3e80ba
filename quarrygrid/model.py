"""Requests and datasets.  Requests may be given as dataclasses or as plain JSON-like objects."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrygrid import schema as S
from quarrygrid.functions.aggregates import known
from quarrygrid.functions.expressions import compile_expression
from quarrygrid.operators.predicates import active_model


class RequestError(ValueError):
    """A request names what the dataset does not have."""


@dataclass(frozen=True)
class Measure:
    field: str
    func: str = "sum"
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.field


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    absolute: bool = False


@dataclass
class Dataset:
    """A named table with its key (None: rows without one are only appended), calculated columns and tree."""

    name: str
    frame: DataFrame | None
    schema: dict[str, str]
    key: str | None
    calc: dict[str, str] = field(default_factory=dict)
    tree: list[str] = field(default_factory=list)
    weight: str | None = "quantity"
    default_measures: tuple[str, ...] = ()
    version: int = 0
    rows: int | None = None

    @property
    def types(self) -> dict[str, str]:
        """Types of all columns, calculated ones too; times without a zone are told apart."""
        calculated = S.of_frame(self.base.select(*[S.col(c) for c in self.calc])) if self.calc else {}
        zoneless = {f.name for f in self.frame.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
        return {n: "datetime_ntz" if t == "datetime" and n in zoneless else t for n, t in {**self.schema, **calculated}.items()}

    @property
    def base(self) -> DataFrame:
        """The table's columns and its calculated columns, which every operator sees alike."""
        out = S.project(self.frame, self.schema, self.key)
        for name, text in self.calc.items():  # one may use those before it
            out = out.withColumn(name, compile_expression(text, set(out.columns)))
        return out

    @property
    def columns(self) -> list[str]:
        """Leaf columns in alphabetical order."""
        return sorted({*S.schema_keys(self.schema, self.key or ""), *self.calc} - {""})


@dataclass(frozen=True)
class ViewRequest:
    """One level of a grid: a window of leaf rows, groups or pivot rows."""

    dataset: str = "main"
    start: int = 0
    end: int | None = None
    groups: tuple[str, ...] = ()
    keys: tuple[Any, ...] = ()
    measures: tuple[Measure, ...] = ()
    pivots: tuple[str, ...] = ()
    pivot_mode: bool = False
    filters: Mapping[str, Any] = field(default_factory=dict)
    sort: tuple[Sort, ...] = ()
    quick_text: str | None = None
    quick_fields: tuple[str, ...] = ()
    tree: bool = False
    abs_sort: bool = False
    keep: str | None = None
    limit: int | None = None

    @classmethod
    def of(cls, request: ViewRequest | Mapping[str, Any]) -> ViewRequest:
        """From a plain object with the fields of the grid protocol; unfinished column entries are left out."""
        if isinstance(request, ViewRequest):
            return request
        r = dict(request)
        fields = lambda name: tuple(c["field"] for c in r.get(name) or () if c.get("field"))
        measures, names = [], set()
        for c in r.get("valueCols") or ():
            if c.get("field"):
                label = c["field"] if c["field"] not in names else f"{c['field']}_{c.get('aggFunc') or 'sum'}"
                names.add(label)
                measures.append(Measure(c["field"], known(c.get("aggFunc")), label))
        return cls(
            dataset=r.get("dataset", "main"),
            start=int(r.get("startRow") or 0),
            end=r.get("endRow"),
            groups=fields("rowGroupCols"),
            keys=tuple(r.get("groupKeys") or ()),
            measures=tuple(measures),
            pivots=fields("pivotCols"),
            pivot_mode=bool(r.get("pivotMode")),
            filters=active_model(r.get("filterModel"), r.get("advancedFilterModel")),
            sort=tuple(Sort(s["colId"], s.get("sort") == "desc", bool(s.get("abs"))) for s in r.get("sortModel") or () if s.get("colId")),
            quick_text=r.get("quickFilterText"),
            quick_fields=tuple(r.get("quickFilterFields") or ()),
            tree=bool(r.get("treeData")),
            abs_sort=bool(r.get("absSort")),
            keep=r.get("rowKeepExpression"),
            limit=r.get("limit"),
        )

    def fingerprint(self, version: int = 0) -> str:
        """The same for equal requests on the same version of a dataset."""
        text = json.dumps([dataclasses.asdict(self), version], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Page:
    """A window of a view; counts and aggregates are computed when asked for."""

    frame: DataFrame
    view: DataFrame
    request: ViewRequest
    pivot_fields: list[str] = field(default_factory=list)
    version: int = 0

    @property
    def rows(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.frame.collect()]

    @property
    def row_count(self) -> int:
        return self.view.count()


def row_id(request: ViewRequest, row: Mapping[str, Any], key: str | None, tree: Sequence[str] = ()) -> str:
    """A name for a collected row: `g:` or `t:` with the path of a group, `tl:` with a tree's leaf, else the row's key.

    Parts of a path are joined by `|`, which is escaped in them as in pivot columns; a null group is `\\0`.
    """
    text = lambda v: "\\0" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|")
    levels = tree if request.tree else request.groups
    if len(request.keys) < len(levels) and "group_key" in row:
        return ("t:" if request.tree else "g:") + "|".join(map(text, (*request.keys, row["group_key"])))
    own = None if key is None else row.get(key)
    return ("tl:" if request.tree else "") + ("" if own is None else str(own))


@dataclass(frozen=True)
class Change:
    """A dataset has a new version; keys of the changed rows, or None if everything is to be read again."""

    dataset: str
    version: int
    keys: list[Any] | None


@dataclass(frozen=True)
class Transaction:
    """Removes come first, then added and updated rows; what a row does not hold stays as it is."""

    add: Sequence[Mapping[str, Any]] = ()
    update: Sequence[Mapping[str, Any]] = ()
    remove: Sequence[Any] = ()

    @classmethod
    def of(cls, tx: Transaction | Mapping[str, Any]) -> Transaction:
        return tx if isinstance(tx, Transaction) else cls(tuple(tx.get("add") or ()), tuple(tx.get("update") or ()), tuple(tx.get("remove") or ()))
