"""View requests compiled to one lazy frame: filter, then group or pivot, then shape.

The order is fixed (calculated columns, all filters, mode, shape, sort, window); what reaches the
scan, which columns are read and how joins are done is left to the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygrid.functions.aggregates import Context, aggregate
from quarrygrid.functions.expressions import compile_predicate
from quarrygrid.model import Dataset, Measure, Page, RequestError, ViewRequest
from quarrygrid.operators import predicates as P
from quarrygrid.operators.ordering import order_by, window
from quarrygrid.schema import col

#: Fixed value: what stands between the parts of a pivot column's name.
SEPARATOR = "|"
GROUP_KEY, CHILD_COUNT = "group_key", "child_count"
#: The one group of a pivot without row groups.
ROOT, ROOT_KEY = "pivot_root", "root"
#: As many pivot columns as the engine plans by default; more are an error, not a silent cut.
MOST_PIVOT_KEYS = 10_000


def filtered(ds: Dataset, request: ViewRequest, now=None, path: Sequence[str] = ()) -> DataFrame:
    """The leaf rows that a request is about; path: the group columns that its keys belong to."""
    types = ds.types
    parts = [
        P.path_filter(path, request.keys, types),
        P.filter_model(request.filters, types, now),
        P.quick_filter(request.quick_text, P.quick_columns(ds.schema, ds.key, request.quick_fields)),
        compile_predicate(request.keep, set(ds.base.columns)) if request.keep and request.keep.strip() else None,
    ]
    where = P.both(p for p in parts if p is not None)
    return ds.base if where is None else ds.base.where(where)


def context(ds: Dataset, empty_sum: bool = False) -> Context:
    has = set(ds.base.columns)
    order = col(ds.key) if ds.key else None
    return Context(order, col(ds.weight) if ds.weight and ds.weight in has else None, empty_sum)


def check(ds: Dataset, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in ds.base.columns]:
        raise RequestError(f"{ds.name} has no column {', '.join(map(repr, missing))}")


def measures(ds: Dataset, wanted: Sequence[Measure], empty_sum: bool = False) -> list[Column]:
    check(ds, [m.field for m in wanted])
    c = context(ds, empty_sum)
    return [aggregate(m.func, col(m.field), c).alias(m.label) for m in wanted]


def group_level(df: DataFrame, field: str, aggregates: Sequence[Column]) -> DataFrame:
    """One row a group: the group's value, its key as text ('' for null), its leaf count, the measures."""
    out = df.groupBy(col(field).alias("group_value")).agg(F.count(F.lit(1)).alias(CHILD_COUNT), *aggregates)
    rest = [c for c in out.columns if c not in ("group_value", field)]
    return out.select(F.col("group_value").alias(field), F.coalesce(F.col("group_value").cast("string"), F.lit("")).alias(GROUP_KEY), *map(col, rest))


def tree_group(df: DataFrame, field: str) -> DataFrame:
    return df.withColumns({"group": F.lit(True), "tree_key": F.col(GROUP_KEY), "tree_label": col(field).cast("string")})


def tree_leaf(df: DataFrame, key: str | None) -> DataFrame:
    label = col(key).cast("string") if key else F.lit(None).cast("string")
    return df.withColumns({"group": F.lit(False), "tree_key": label, "tree_label": label})


def pivot_key(pivots: Sequence[str]) -> Column:
    """The values of the pivot columns as one text; null is 'null', a separator inside is escaped."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.replace(col(p).cast("string"), F.lit(SEPARATOR), F.lit("\\" + SEPARATOR)), F.lit("null")) for p in pivots])


def pivoted(ds: Dataset, df: DataFrame, field: str | None, pivots: Sequence[str], wanted: Sequence[Measure], next_field: str | None = None, keys: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows by group (or one row), a column `key|measure` for each pivot key and measure.

    keys: the pivot keys; where not given, a query for the distinct ones runs first.  child_count
    counts the distinct values of the next group level, 0 on the last.
    """
    check(ds, [*pivots, *([field] if field else [])])
    df = df.withColumn("pivot_key", pivot_key(pivots)).withColumn("group_value", col(field) if field else F.lit(ROOT_KEY))
    if keys is None:
        found = df.select("pivot_key").distinct().limit(MOST_PIVOT_KEYS + 1).collect()
        if len(found) > MOST_PIVOT_KEYS:
            raise RequestError(f"more than {MOST_PIVOT_KEYS} pivot keys")
        keys = sorted(r.pivot_key for r in found)
    # Cells first, by hash aggregation; pivoting then only places them.
    cells = df.groupBy("group_value", "pivot_key").agg(*[m.alias(f"m{k}") for k, m in enumerate(measures(ds, wanted))])
    placed = cells.groupBy("group_value").pivot("pivot_key", list(keys)).agg(*[F.first(f"m{k}").alias(f"m{k}") for k in range(len(wanted))]) if keys and wanted else cells.select("group_value").distinct()
    names, columns = [], []
    for k in keys if wanted else ():
        for n, m in enumerate(wanted):
            names.append(f"{k}{SEPARATOR}{m.label}")
            columns.append(col(k if len(wanted) == 1 else f"{k}_m{n}").alias(names[-1]))
    out = placed.select("group_value", *columns)
    if next_field:
        inner = df.groupBy("group_value").agg(F.count_distinct(col(next_field)).alias("n")).select(F.col("group_value").alias("v"), "n")
        out = out.join(inner, F.col("group_value").eqNullSafe(F.col("v")), "left")
        child = F.coalesce("n", F.lit(0))
    else:
        child = F.lit(0)
    shown = field or ROOT
    return out.select(F.col("group_value").alias(shown), F.coalesce(F.col("group_value").cast("string"), F.lit("")).alias(GROUP_KEY), child.cast("long").alias(CHILD_COUNT), *map(col, names)), names


def compile_view(ds: Dataset, request: ViewRequest, now=None) -> Page:
    """The view of a request, without and with its window."""
    groups = tuple(ds.tree) if request.tree and ds.tree else request.groups
    keys = request.keys[: len(groups)]
    depth = len(keys)
    check(ds, groups)
    df = filtered(ds, request, now, groups)
    types, fields = ds.types, []
    group = groups[depth] if depth < len(groups) else None
    if request.pivot_mode:
        if groups and group is None:  # nothing is below the last level of a pivot
            view, fields = pivoted(ds, df.limit(0), groups[-1], request.pivots, request.measures, None, ())
        elif request.pivots:
            view, fields = pivoted(ds, df, group, request.pivots, request.measures, groups[depth + 1] if depth + 1 < len(groups) else None)
        else:
            name = group or ROOT
            view = group_level(df if group else df.withColumn(ROOT, F.lit(ROOT_KEY)), name, measures(ds, request.measures))
        ties = [group or ROOT]
    elif group is not None:
        view = group_level(df, group, measures(ds, request.measures))
        view = tree_group(view, group) if request.tree else view
        ties = [group]
    else:
        view = df.select(*[col(c) for c in ds.columns])
        view = tree_leaf(view, ds.key) if request.tree else view
        ties = [ds.key] if ds.key else ds.columns
    order = order_by(request.sort, view.columns, ties, ds.schema, request.abs_sort, group)
    return Page(window(view, order, request.start, request.end), view, request, fields, ds.version)


def all_levels(ds: Dataset, request: ViewRequest, now=None) -> DataFrame:
    """The whole hierarchy of a request in one pass, with the level of each row (0: grand total)."""
    groups = tuple(ds.tree) if request.tree and ds.tree else request.groups
    check(ds, groups)
    df = filtered(ds, request, now, groups)
    # A null group and a level that is rolled up are told apart by the grouping bits.
    out = df.rollup(*[col(g) for g in groups]).agg(F.grouping_id().alias("bits"), F.count(F.lit(1)).alias(CHILD_COUNT), *measures(ds, request.measures))
    level = F.lit(len(groups)) - F.bit_count("bits")
    return out.withColumn("level", level.cast("int")).drop("bits")
