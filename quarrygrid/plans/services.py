"""What is asked of a dataset besides views: aggregates, series, distinct values, details, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrygrid.functions.aggregates import DEFAULT_FUNCTIONS, aggregate, alias, known
from quarrygrid.functions.shares import share
from quarrygrid.model import Dataset, Measure, ViewRequest
from quarrygrid.operators import predicates as P
from quarrygrid.plans.views import check, compile_view, context, filtered
from quarrygrid.schema import col

ROW_COUNT = "row_count"
#: Rows that are returned where a request names no limit.
SERIES_LIMIT, DETAIL_LIMIT, QUERY_LIMIT, EXPORT_LIMIT = 500, 500, 50_000, 100_000


def specs(ds: Dataset, request: ViewRequest) -> list[Measure]:
    """Pairs of field and function for a request: defaults of the dataset, its measures, and their sums."""
    out: dict[tuple[str, str], Measure] = {}
    for f in ds.default_measures:
        for func in DEFAULT_FUNCTIONS if f in ds.base.columns else ():
            out[f, func] = Measure(f, func)
    for m in request.measures:
        for func in (known(m.func), "sum"):
            out[m.field, func] = Measure(m.field, func)
    return list(out.values())


def aggregates(ds: Dataset, request: ViewRequest, now=None, pairs: Sequence[Measure] | None = None) -> DataFrame:
    """One row: row_count and one column a pair, all in one pass over the filtered rows."""
    pairs = specs(ds, request) if pairs is None else pairs
    check(ds, [m.field for m in pairs])
    c = context(ds, empty_sum=True)
    types = ds.types
    # Text has no sum: the sum that every measure brings along is left out for it.
    pairs = [m for m in pairs if m.func not in ("sum", "avg") or types.get(m.field) in ("float", "integer")]
    columns = [aggregate(m.func, col(m.field), c).alias(alias(m.field, m.func)) for m in pairs]
    return filtered(ds, request, now).agg(F.count(F.lit(1)).alias(ROW_COUNT), *columns)


def aggregate_matrix(ds: Dataset, request: ViewRequest, now=None) -> dict[str, Any]:
    """{totals: field to sum, aggregates: field to function to value, rowCount}."""
    pairs = specs(ds, request)
    row = aggregates(ds, request, now, pairs).first().asDict()
    matrix: dict[str, dict[str, Any]] = {}
    for m in pairs:
        if alias(m.field, m.func) in row:
            matrix.setdefault(m.field, {})[m.func] = row[alias(m.field, m.func)]
    return {"totals": {f: v["sum"] for f, v in matrix.items() if "sum" in v}, "aggregates": matrix, "rowCount": row[ROW_COUNT]}


def with_aggregates(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of df with the columns of a one-row frame."""
    return df.join(F.broadcast(one_row), how="cross")


def with_share(df: DataFrame, field: str, total: DataFrame, func: str = "sum", name: str | None = None) -> DataFrame:
    """df with field / aggregate of the filtered set; total: a row of aggregates()."""
    one = total.select(F.col(alias(field, func)).alias("share_total"))
    return with_aggregates(df, one).withColumn(name or f"{field}_share", share(col(field), F.col("share_total"))).drop("share_total")


def counts(ds: Dataset, request: ViewRequest, now=None) -> DataFrame:
    """One row: total and filtered row counts; no other column is read."""
    total = ds.base.agg(F.count(F.lit(1)).alias("total_count"))
    return with_aggregates(total, filtered(ds, request, now).agg(F.count(F.lit(1)).alias("filtered_count")))


def series(ds: Dataset, category: str, request: ViewRequest, now=None, limit: int | None = SERIES_LIMIT) -> DataFrame:
    """category and the measures, by category, null last."""
    check(ds, [category, *[m.field for m in request.measures]])
    c = context(ds)
    columns = [aggregate(m.func, col(m.field), c).alias(m.label) for m in request.measures]
    grouped = filtered(ds, request, now).groupBy(col(category).alias("category"))
    out = (grouped.agg(*columns) if columns else grouped.agg(F.count(F.lit(1)).alias("count"))).orderBy(F.col("category").asc_nulls_last())
    return out if limit is None else out.limit(limit)


def distinct_values(ds: Dataset, field: str) -> DataFrame:
    """value: the distinct values of a column as text, in order; none for an unknown column."""
    if field not in ds.base.columns:
        return ds.base.select(F.lit("").alias("value")).limit(0)
    return ds.base.select(col(field).alias("v")).where("v is not null").distinct().select(F.col("v").cast("string").alias("value")).orderBy("value")


def detail(ds: Dataset, match: Mapping[str, Any], limit: int | None = DETAIL_LIMIT) -> DataFrame:
    """Rows whose columns equal the given values, null equal to null."""
    check(ds, list(match))
    types = ds.types
    where = P.both(col(f).isNull() if v is None else col(f) == P.literal(v, types.get(f)) for f, v in match.items())
    out = ds.base if where is None else ds.base.where(where)
    out = out.orderBy(*([col(ds.key)] if ds.key else [col(c) for c in ds.columns]))
    return out if limit is None else out.limit(limit)


def details_of(master: DataFrame, ds: Dataset, fields: Mapping[str, str], limit: int = DETAIL_LIMIT, prefix: str = "master_") -> DataFrame:
    """The detail rows of every master row, at most `limit` each, master columns prefixed.

    fields: detail column to master column.  A crowded master is ranked in a partition of its own
    rows only, and a window group limit cuts it before the shuffle.
    """
    m = master.select(*[col(c).alias(prefix + c) for c in master.columns])
    order = [col(ds.key)] if ds.key else [col(c) for c in ds.columns]
    few = ds.base.withColumn("detail_no", F.row_number().over(W.partitionBy(*[col(a) for a in fields]).orderBy(*order))).where(F.col("detail_no") <= limit)
    on = [few[f"`{a}`"].eqNullSafe(m[f"`{prefix}{b}`"]) for a, b in fields.items()]
    return m.join(few, on, "left")


def query_all(ds: Dataset, request: ViewRequest, now=None, structure: bool = False, limit: int | None = QUERY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows up to the limit, the view before it); leaf rows unless the structure is asked for."""
    request = replace(request, start=0, end=None)
    if not structure:
        request = replace(request, groups=(), keys=(), pivots=(), pivot_mode=False, tree=False)
    page = compile_view(ds, request, now)
    return (page.frame if limit is None else page.frame.limit(limit)), page.view


def group_leaf_rows(ds: Dataset, request: ViewRequest, now=None) -> DataFrame:
    """All leaf rows under a group path, without a limit; the path overrides a filter on its fields."""
    if P.is_advanced(request.filters):
        df = filtered(ds, request, now, request.groups)
    else:
        own = P.with_path(request.filters, request.groups, request.keys, ds.types)
        df = filtered(ds, replace(request, filters=own, keys=()), now)
    return df.select(*[col(c) for c in ds.columns])
