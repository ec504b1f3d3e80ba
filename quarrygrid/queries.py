"""Registered queries of the pivot engine over the test tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygrid import schema as S
from quarrygrid.engine import Engine
from quarrygrid.functions.shares import as_percent, exceeds
from quarrygrid.operators import mutations
from quarrygrid.plans import services
from quarrygrid.schema import col
from quarrygrid.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The day that date presets count from here.
NOW = dt.datetime(1998, 6, 15)


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def engine(spark: SparkSession, sf_dir: str, table: str, key: str | None, **options) -> Engine:
    """An engine whose dataset `main` is a test table; keys of the test tables are unique."""
    e, df = Engine(spark, NOW), spark.read.parquet(f"{sf_dir}/{table}.parquet")
    e.configure("main", S.of_frame(df), key, **options)
    e.load("main", df, unique=True)
    return e


def orders(spark, sf_dir, **options) -> Engine:
    return engine(spark, sf_dir, "orders", "o_orderkey", **options)


def lineitem(spark, sf_dir, **options) -> Engine:
    return engine(spark, sf_dir, "lineitem", None, **{"weight": "l_quantity", **options})


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Floating sums differ in the last digits between engines."""
    return df.select(*[F.round(col(n), digits).alias(n) if t == "double" else col(n) for n, t in df.dtypes])


def by(*fields: str) -> list[dict]:
    return [{"field": f} for f in fields]


def of(*pairs: str) -> list[dict]:
    """'sum o_totalprice' and so on."""
    return [{"field": p.split()[1], "aggFunc": p.split()[0]} for p in pairs]


# --- groups, leaves, pages ---


@query("SELECT o_orderstatus, o_orderstatus AS group_key, count(*) AS child_count, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2")
def group_top(spark, sf_dir):
    return rounded(orders(spark, sf_dir).view({"rowGroupCols": by("o_orderstatus", "o_orderpriority"), "valueCols": of("sum o_totalprice")}))


@query("SELECT o_orderpriority, o_orderpriority AS group_key, count(*) AS child_count, round(avg(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1, 2")
def group_path(spark, sf_dir):
    r = {"rowGroupCols": by("o_orderstatus", "o_orderpriority"), "groupKeys": ["F"], "valueCols": of("avg o_totalprice"), "filterModel": {"o_totalprice": {"filterType": "number", "type": "greaterThan", "filter": 1000}}, "sortModel": [{"colId": "o_totalprice", "sort": "desc"}], "startRow": 0, "endRow": 100}
    return rounded(orders(spark, sf_dir).view(r))


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 30")
def group_leaves_page(spark, sf_dir):
    r = {"rowGroupCols": by("o_orderstatus", "o_orderpriority"), "groupKeys": ["O", "1-URGENT"], "sortModel": [{"colId": "o_totalprice", "sort": "desc"}], "endRow": 30}
    return orders(spark, sf_dir).view(r)


@query("SELECT o_orderkey, round(offset_price, 2) AS offset_price FROM (SELECT o_orderkey, o_totalprice - 200000 AS offset_price FROM orders) ORDER BY abs(offset_price) DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def leaf_page_abs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") - 200000).alias("offset_price"))
    e = Engine(spark)
    e.configure("main", {"o_orderkey": "integer", "offset_price": "float"}, "o_orderkey")
    e.load("main", df, unique=True)
    return rounded(e.view({"startRow": 100, "endRow": 150, "absSort": True, "sortModel": [{"colId": "offset_price", "sort": "desc"}]}))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 10")
def top_k(spark, sf_dir):
    return orders(spark, sf_dir).view({"endRow": 10, "sortModel": [{"colId": "o_totalprice", "sort": "asc"}]}).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders")
def leaf_projection(spark, sf_dir):
    return orders(spark, sf_dir).view({})


# --- filters ---


def _text_filter(name: str, op: str, needle: str | None, sql: str) -> None:
    def run(spark, sf_dir):
        c = {"filterType": "text", "type": op} | ({"filter": needle} if needle else {})
        return orders(spark, sf_dir).view({"filterModel": {"o_orderpriority": c}}).select("o_orderkey", "o_orderpriority")

    run.__name__ = name
    query(f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {sql}")(run)


_text_filter("filter_text_equals", "equals", "1-URGENT", "o_orderpriority = '1-URGENT'")
_text_filter("filter_text_not_equal", "notEqual", "1-URGENT", "o_orderpriority IS DISTINCT FROM '1-URGENT'")
_text_filter("filter_text_contains", "contains", "hIgH", "contains(lower(o_orderpriority), 'high')")
_text_filter("filter_text_not_contains", "notContains", "hIgH", "NOT coalesce(contains(lower(o_orderpriority), 'high'), false)")
_text_filter("filter_text_starts", "startsWith", "5-l", "starts_with(lower(o_orderpriority), '5-l')")
_text_filter("filter_text_ends", "endsWith", "MEDIUM", "ends_with(lower(o_orderpriority), 'medium')")


def _with_nulls(spark, sf_dir) -> Engine:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    e = Engine(spark)
    e.configure("main", S.of_frame(df), "o_orderkey")
    e.load("main", df, unique=True)
    return e


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL")
def filter_blank(spark, sf_dir):
    return _with_nulls(spark, sf_dir).view({"filterModel": {"status": {"filterType": "text", "type": "blank"}}}).select("o_orderkey")


@query("SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL AND nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'")
def filter_not_blank_keeps_null(spark, sf_dir):
    m = {"status": {"filterType": "text", "type": "notBlank"}, "priority": {"filterType": "text", "type": "notEqual", "filter": "1-URGENT"}}
    return _with_nulls(spark, sf_dir).view({"filterModel": m}).select("o_orderkey", "priority")


@query("SELECT nullif(o_orderstatus, 'F') AS status, coalesce(nullif(o_orderstatus, 'F'), '') AS group_key, count(*) AS child_count, count(DISTINCT nullif(o_orderpriority, '5-LOW')) AS priority FROM orders GROUP BY 1, 2")
def group_null_key(spark, sf_dir):
    return _with_nulls(spark, sf_dir).view({"rowGroupCols": by("status"), "valueCols": of("countDistinct priority")})


def _number_filter(name: str, op: str, sql: str, to: float | None = None) -> None:
    def run(spark, sf_dir):
        c = {"filterType": "number", "type": op, "filter": 150000} | ({"filterTo": to} if to else {})
        return orders(spark, sf_dir).view({"filterModel": {"o_totalprice": c}}).select("o_orderkey", "o_totalprice")

    run.__name__ = name
    query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {sql}")(run)


for _op, _sign in (("equals", "="), ("notEqual", "IS DISTINCT FROM"), ("lessThan", "<"), ("lessThanOrEqual", "<="), ("greaterThan", ">"), ("greaterThanOrEqual", ">=")):
    _number_filter(f"filter_number_{_op}", _op, f"o_totalprice {_sign} 150000")
_number_filter("filter_number_range", "inRange", "o_totalprice BETWEEN 150000 AND 250000", 250000)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-03-01' AND DATE '1997-05-31'")
def filter_date_range(spark, sf_dir):
    c = {"filterType": "date", "type": "inRange", "dateFrom": "1997-03-01 00:00:00", "dateTo": "1997-05-31 00:00:00"}
    return orders(spark, sf_dir).view({"filterModel": {"o_orderdate": c}}).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '2000-01-15'")
def filter_date_after(spark, sf_dir):
    return orders(spark, sf_dir).view({"filterModel": {"o_orderdate": {"filterType": "date", "type": "greaterThan", "dateFrom": "2000-01-15"}}}).select("o_orderkey")


#: First and last day of each preset, counted from NOW.
_PRESET_DAYS = {"today": ("1998-06-15", "1998-06-15"), "yesterday": ("1998-06-14", "1998-06-14"), "last7Days": ("1998-06-09", "1998-06-15"), "last14Days": ("1998-06-02", "1998-06-15"), "last30Days": ("1998-05-17", "1998-06-15"), "thisMonth": ("1998-06-01", "1998-06-15"), "thisYear": ("1998-01-01", "1998-06-15")}


@query(" UNION ALL ".join(f"SELECT '{p}' AS preset, count(*) AS n FROM orders WHERE o_orderdate::DATE BETWEEN DATE '{a}' AND DATE '{b}'" for p, (a, b) in _PRESET_DAYS.items()))
def filter_date_presets(spark, sf_dir):
    e, out = orders(spark, sf_dir), None
    for p in _PRESET_DAYS:
        one = e.counts({"filterModel": {"o_orderdate": {"filterType": "date", "type": p}}}).select(F.lit(p).alias("preset"), F.col("filtered_count").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_set(spark, sf_dir):
    return orders(spark, sf_dir).view({"filterModel": {"o_orderpriority": {"filterType": "set", "values": ["1-URGENT", "2-HIGH"]}}}).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 7, 11)")
def filter_set_typed(spark, sf_dir):
    return orders(spark, sf_dir).view({"filterModel": {"o_custkey": {"filterType": "set", "values": ["1", "7", "11", "none"]}}}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE false")
def filter_set_empty(spark, sf_dir):
    return orders(spark, sf_dir).view({"filterModel": {"o_orderpriority": {"filterType": "set", "values": []}}}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 90000")
def filter_compound_and(spark, sf_dir):
    c = {"filterType": "number", "operator": "AND", "conditions": [{"type": "greaterThanOrEqual", "filter": 1000}, {"type": "lessThan", "filter": 90000}]}
    return orders(spark, sf_dir).view({"filterModel": {"o_totalprice": c}}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_compound_or_equals(spark, sf_dir):
    c = {"filterType": "text", "operator": "OR", "conditions": [{"type": "equals", "filter": "1-URGENT"}, {"type": "equals", "filter": "5-LOW"}]}
    return orders(spark, sf_dir).view({"filterModel": {"o_orderpriority": c}}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 OR o_totalprice BETWEEN 300000 AND 400000")
def filter_or_of_ranges(spark, sf_dir):
    c = {"filterType": "number", "operator": "OR", "conditions": [{"type": "inRange", "filter": 1000, "filterTo": 50000}, {"type": "inRange", "filter": 300000, "filterTo": 400000}]}
    return orders(spark, sf_dir).view({"filterModel": {"o_totalprice": c}}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'e') AND o_orderpriority IN ('1-URGENT', '3-MEDIUM', '2-HIGH')")
def filter_multi(spark, sf_dir):
    c = {"filterType": "multi", "filterModels": [{"filterType": "text", "type": "contains", "filter": "e"}, None, {"filterType": "set", "values": ["1-URGENT", "3-MEDIUM", "2-HIGH"]}]}
    return orders(spark, sf_dir).view({"filterModel": {"o_orderpriority": c}}).select("o_orderkey")


_TREE = {"filterType": "join", "type": "AND", "conditions": [{"filterType": "join", "type": "OR", "conditions": [{"colId": "o_orderstatus", "filterType": "text", "type": "equals", "filter": "F"}, {"colId": "o_orderpriority", "filterType": "text", "type": "contains", "filter": "low"}]}, {"colId": "o_totalprice", "filterType": "number", "type": "greaterThan", "filter": 100000}]}
_TREE_SQL = "(o_orderstatus = 'F' OR contains(lower(o_orderpriority), 'low')) AND o_totalprice > 100000"


@query(f"SELECT o_orderkey FROM orders WHERE {_TREE_SQL}")
def filter_advanced_nested(spark, sf_dir):
    return orders(spark, sf_dir).view({"filterModel": _TREE}).select("o_orderkey")


@query(f"SELECT o_orderstatus, o_orderstatus AS group_key, count(*) AS child_count, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE {_TREE_SQL} GROUP BY 1, 2")
def filter_advanced_grouped(spark, sf_dir):
    return rounded(orders(spark, sf_dir).view({"filterModel": _TREE, "rowGroupCols": by("o_orderstatus"), "valueCols": of("sum o_totalprice")}))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_advanced_flat_or(spark, sf_dir):
    m = {"filterType": "join", "type": "OR", "conditions": [{"colId": "o_orderstatus", "filterType": "text", "type": "equals", "filter": v} for v in ("F", "P")]}
    return orders(spark, sf_dir).view({"filterModel": m}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg')")
def quick_filter(spark, sf_dir):
    return orders(spark, sf_dir).view({"quickFilterText": " UrG "}).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the')")
def quick_filter_documents(spark, sf_dir):
    e = engine(spark, sf_dir, "documents", "doc_id")
    return e.view({"quickFilterText": "tion the", "quickFilterFields": ["text"]}).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P') AND o_totalprice / nullif(o_custkey, 0) > 100")
def row_keep(spark, sf_dir):
    return orders(spark, sf_dir).view({"rowKeepExpression": """not ("o_orderstatus" == 'P') and "o_totalprice" / "o_custkey" > 100"""}).select("o_orderkey")


# --- calculated columns ---

_CALC = {"net": '"l_extendedprice" * (1 - "l_discount")', "ratio": '"l_tax" != 0 and "l_tax" != null ? "l_discount" / "l_tax" : null'}


@query("SELECT l_returnflag, l_returnflag AS group_key, count(*) AS child_count, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount / nullif(l_tax, 0)), 4) AS ratio FROM lineitem GROUP BY 1, 2")
def calc_column_group(spark, sf_dir):
    out = lineitem(spark, sf_dir, calc=_CALC).view({"rowGroupCols": by("l_returnflag"), "valueCols": of("sum net", "avg ratio")})
    return out.withColumns({"net": F.round("net", 2), "ratio": F.round("ratio", 4)})


@query("SELECT CASE WHEN l_quantity >= 40 THEN 1 WHEN l_quantity >= 15 THEN 2 ELSE 3 END AS light, CASE WHEN l_quantity >= 40 THEN '1' WHEN l_quantity >= 15 THEN '2' ELSE '3' END AS group_key, count(*) AS child_count, round(max(abs(l_extendedprice - 50000)), 2) AS far FROM lineitem GROUP BY 1, 2")
def calc_if_ternary(spark, sf_dir):
    calc = {"light": 'if("l_quantity" >= 40, 1, if("l_quantity" >= 15, 2, 3))', "far": 'abs("l_extendedprice" - 50000)'}
    return rounded(lineitem(spark, sf_dir, calc=calc).view({"rowGroupCols": by("light"), "valueCols": of("max far")}))


@query("SELECT count(*) AS row_count, round(sum(l_extendedprice * (1 - l_discount)), 2) AS agg_net_sum FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 30000 AND lower(l_returnflag || '-' || l_linestatus) = 'n-o'")
def calc_filter(spark, sf_dir):
    calc = _CALC | {"pair": """lower(concat("l_returnflag", '-', string("l_linestatus")))"""}
    m = {"net": {"filterType": "number", "type": "greaterThan", "filter": 30000}, "pair": {"filterType": "text", "type": "equals", "filter": "n-o"}}
    return rounded(lineitem(spark, sf_dir, calc=calc).aggregates({"filterModel": m, "valueCols": of("sum net")}))


@query("SELECT o_orderkey, year(o_orderdate) AS y, regexp_matches(o_orderpriority, '^[12]') AS hot, substring(o_orderpriority, 1, 1) AS p FROM orders")
def calc_functions(spark, sf_dir):
    calc = {"y": 'year("o_orderdate")', "hot": """match("o_orderpriority", '^[12]')""", "p": 'substring("o_orderpriority", 1, 1)'}
    return orders(spark, sf_dir, calc=calc).view({}).select("o_orderkey", "y", "hot", "p")


@query("SELECT l_orderkey, l_linenumber::VARCHAR AS l_linenumber FROM lineitem WHERE l_linenumber > 3")
def filter_number_on_text(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("string").alias("l_linenumber"))
    e = Engine(spark, NOW)
    e.configure("main", S.of_frame(df), None)
    e.load("main", df)
    return e.view({"filterModel": {"l_linenumber": {"filterType": "number", "type": "greaterThan", "filter": 3}}}).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def filter_number_not_a_number(spark, sf_dir):
    return orders(spark, sf_dir).view({"filterModel": {"o_orderpriority": {"filterType": "number", "type": "notEqual", "filter": 5}}}).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_advanced_single(spark, sf_dir):
    return orders(spark, sf_dir).view({"advancedFilterModel": {"filterType": "text", "colId": "o_orderstatus", "type": "equals", "filter": "F"}, "filterModel": {"o_orderstatus": {"filterType": "text", "type": "equals", "filter": "O"}}}).select("o_orderkey")


@query("SELECT o_orderpriority, o_orderpriority AS group_key, count(*) AS child_count FROM orders GROUP BY 1, 2 ORDER BY 1 DESC LIMIT 3")
def sort_auto_group(spark, sf_dir):
    return orders(spark, sf_dir).view({"rowGroupCols": by("o_orderpriority"), "sortModel": [{"colId": "ag-Grid-AutoColumn", "sort": "desc"}], "startRow": 0, "endRow": 3})


# --- aggregates ---


@query("SELECT o_orderstatus, o_orderstatus AS group_key, count(*) AS child_count, o_orderstatus AS one FROM orders GROUP BY 1, 2, 4")
def agg_any(spark, sf_dir):
    out = orders(spark, sf_dir, calc={"one": '"o_orderstatus"'}).view({"rowGroupCols": by("o_orderstatus"), "valueCols": of("any one")})
    return out.select("o_orderstatus", "group_key", "child_count", "one")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def message_rows(spark, sf_dir):
    reply = orders(spark, sf_dir).handle({"type": "getRows", "requestId": 1, "request": {"filterModel": {"o_orderstatus": {"filterType": "text", "type": "equals", "filter": "F"}}, "sortModel": [{"colId": "o_totalprice", "sort": "desc"}], "startRow": 0, "endRow": 50}})
    return spark.createDataFrame([(r["o_orderkey"], r["o_totalprice"]) for r in reply["result"]["rowData"]], "o_orderkey long, o_totalprice double")


@query("SELECT event_type, event_type AS group_key, count(*) AS child_count, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, count(DISTINCT user_id) AS users, round(median(value), 4) AS med, round(stddev_samp(value), 4) AS sd, round(var_samp(value), 4) AS vr, round(min(value), 4) AS lo, round(max(value), 4) AS hi, count(value) AS n FROM events GROUP BY 1, 2")
def agg_stats(spark, sf_dir):
    from quarrygrid.model import Measure, ViewRequest

    pairs = [("value", "first", "first_value"), ("value", "lastByIndex", "last_value"), ("user_id", "distinct", "users"), ("value", "median", "med"), ("value", "stddev", "sd"), ("value", "var", "vr"), ("value", "min", "lo"), ("value", "max", "hi"), ("value", "count", "n")]
    r = ViewRequest(groups=("event_type",), measures=tuple(Measure(*p) for p in pairs))
    out = engine(spark, sf_dir, "events", "event_id").view(r)
    return out.withColumns({c: F.round(c, 4) for c in ("med", "sd", "vr", "lo", "hi")})


@query("SELECT l_returnflag, l_returnflag AS group_key, count(*) AS child_count, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def agg_weighted(spark, sf_dir):
    return rounded(lineitem(spark, sf_dir).view({"rowGroupCols": by("l_returnflag"), "valueCols": of("weightedAvg l_extendedprice")}), 4)


@query("SELECT l_linenumber, l_linenumber::VARCHAR AS group_key, count(*) AS child_count, CASE WHEN min(light) IS NULL THEN NULL WHEN min(light) = 1 AND max(light) = 1 THEN 1 WHEN min(light) = 3 AND max(light) = 3 THEN 3 ELSE 2 END AS light FROM (SELECT l_linenumber, CASE WHEN l_linenumber < 3 THEN 1 WHEN l_linenumber > 5 THEN 3 WHEN l_quantity > 25 THEN 1 ELSE 2 END AS light FROM lineitem) GROUP BY 1, 2")
def agg_rag(spark, sf_dir):
    calc = {"light": 'if("l_linenumber" < 3, 1, if("l_linenumber" > 5, 3, "l_quantity" > 25 ? 1 : 2))'}
    return lineitem(spark, sf_dir, calc=calc).view({"rowGroupCols": by("l_linenumber"), "valueCols": of("rag light")})


@query("SELECT count(*) AS row_count, " + ", ".join(f"round({f}({c}), 2) AS agg_{c}_{f}" for c in ("o_totalprice", "o_custkey") for f in ("sum", "avg", "min", "max")) + ", count(o_totalprice) AS agg_o_totalprice_count, count(o_custkey) AS agg_o_custkey_count, count(DISTINCT o_orderpriority) AS agg_o_orderpriority_countDistinct FROM orders WHERE o_orderstatus = 'O'")
def global_aggregates(spark, sf_dir):
    e = orders(spark, sf_dir, default_measures=("o_totalprice", "o_custkey", "missing"))
    out = rounded(e.aggregates({"filterModel": {"o_orderstatus": {"filterType": "text", "type": "equals", "filter": "O"}}, "valueCols": of("countDistinct o_orderpriority")}))
    return out.withColumns({c: F.round(c, 2) for c in ("agg_o_custkey_sum", "agg_o_custkey_min", "agg_o_custkey_max")})


@query("SELECT round(sum(o_totalprice), 2) AS o_totalprice, count(o_orderkey) AS o_orderkey FROM orders")
def grand_total(spark, sf_dir):
    return rounded(orders(spark, sf_dir).grand_total({"rowGroupCols": by("o_orderstatus"), "valueCols": of("sum o_totalprice", "count o_orderkey")}))


@query("SELECT o_orderpriority, round(s / t, 6) AS part, printf('%.2f%%', s / t * 100) AS part_text, s / t > 0.2 AS big FROM (SELECT o_orderpriority, sum(o_totalprice) AS s, sum(sum(o_totalprice)) OVER () AS t FROM orders GROUP BY 1)")
def share_of_total(spark, sf_dir):
    e = orders(spark, sf_dir)
    r = {"rowGroupCols": by("o_orderpriority"), "valueCols": of("sum o_totalprice")}
    out = services.with_share(e.view(r), "o_totalprice", e.aggregates({"valueCols": r["valueCols"]}), "sum", "part")
    return out.select("o_orderpriority", F.round("part", 6).alias("part"), as_percent(F.col("part")).alias("part_text"), exceeds(F.col("part"), 0.2).alias("big"))


@query("SELECT o_orderkey, o_totalprice, row_count, agg_o_totalprice_sum FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20) CROSS JOIN (SELECT count(*) AS row_count, round(sum(o_totalprice), 2) AS agg_o_totalprice_sum FROM orders WHERE o_orderstatus = 'P')")
def page_with_aggregates(spark, sf_dir):
    e = orders(spark, sf_dir)
    r = {"filterModel": {"o_orderstatus": {"filterType": "text", "type": "equals", "filter": "P"}}, "valueCols": of("sum o_totalprice"), "endRow": 20}
    return services.with_aggregates(e.view(r).select("o_orderkey", "o_totalprice"), rounded(e.aggregates(r)))


@query("SELECT count(*) AS total_count, count(*) FILTER (WHERE o_totalprice > 200000) AS filtered_count FROM orders")
def count_matching(spark, sf_dir):
    return orders(spark, sf_dir).counts({"filterModel": {"o_totalprice": {"filterType": "number", "type": "greaterThan", "filter": 200000}}})


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS child_count, round(sum(o_totalprice), 2) AS o_totalprice, (2 - grouping(o_orderstatus) - grouping(o_orderpriority))::INTEGER AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_levels(spark, sf_dir):
    return rounded(orders(spark, sf_dir).levels({"rowGroupCols": by("o_orderstatus", "o_orderpriority"), "valueCols": of("sum o_totalprice")}))


# --- pivots ---


def _cell(func: str, keys: str, label: str) -> str:
    return f'round({func} FILTER (WHERE {keys}), 2) AS "{label}"'


@query("SELECT l_returnflag, l_returnflag AS group_key, 0::BIGINT AS child_count, " + ", ".join(_cell("sum(l_quantity)", f"l_linestatus = '{k}'", f"{k}|l_quantity") for k in "FO") + " FROM lineitem GROUP BY 1, 2")
def pivot_single(spark, sf_dir):
    return rounded(lineitem(spark, sf_dir).view({"pivotMode": True, "rowGroupCols": by("l_returnflag"), "pivotCols": by("l_linestatus"), "valueCols": of("sum l_quantity")}))


@query("SELECT l_returnflag, l_returnflag AS group_key, count(DISTINCT l_linenumber) AS child_count, " + ", ".join(_cell(f, f"l_linestatus = '{k}'", f"{k}|{c}") for k in "FO" for f, c in (("sum(l_quantity)", "l_quantity"), ("avg(l_discount)", "l_discount"))) + " FROM lineitem GROUP BY 1, 2")
def pivot_structure(spark, sf_dir):
    return rounded(lineitem(spark, sf_dir).view({"pivotMode": True, "rowGroupCols": by("l_returnflag", "l_linenumber"), "pivotCols": by("l_linestatus"), "valueCols": of("sum l_quantity", "avg l_discount")}))


@query("SELECT l_linenumber, l_linenumber::VARCHAR AS group_key, 0::BIGINT AS child_count, " + ", ".join(_cell("max(l_tax)", f"l_returnflag = '{a}' AND l_linestatus = '{b}'", f"{a}|{b}|l_tax") for a, b in ("AF", "NF", "NO", "RF")) + " FROM lineitem GROUP BY 1, 2")
def pivot_two_keys(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = Engine(spark)
    e.configure("main", S.of_frame(df), None)
    e.load("main", df)
    m = {"rowKeepExpression": """("l_returnflag" == 'N' or "l_linestatus" == 'F')"""}
    return rounded(e.view({"pivotMode": True, "rowGroupCols": by("l_linenumber"), "pivotCols": by("l_returnflag", "l_linestatus"), "valueCols": of("max l_tax")} | m))


@query("SELECT 'root' AS pivot_root, 'root' AS group_key, 0::BIGINT AS child_count, " + ", ".join(_cell("sum(o_totalprice)", f"o_orderstatus = '{k}'", f"{k}|o_totalprice") for k in "FOP") + " FROM orders")
def pivot_root(spark, sf_dir):
    return rounded(orders(spark, sf_dir).view({"pivotMode": True, "pivotCols": by("o_orderstatus"), "valueCols": of("sum o_totalprice")}))


@query("SELECT o_custkey, o_custkey::VARCHAR AS group_key, 0::BIGINT AS child_count, " + ", ".join(_cell("sum(o_totalprice)", f"o_orderstatus = '{k}'", f"{k}|o_totalprice") for k in "FOP") + """ FROM orders GROUP BY 1, 2 ORDER BY sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') DESC NULLS LAST, o_custkey LIMIT 25""")
def pivot_sorted(spark, sf_dir):
    return rounded(orders(spark, sf_dir).view({"pivotMode": True, "rowGroupCols": by("o_custkey"), "pivotCols": by("o_orderstatus"), "valueCols": of("sum o_totalprice"), "sortModel": [{"colId": "P|o_totalprice", "sort": "desc"}], "endRow": 25}))


@query("SELECT l_linestatus, l_linestatus AS group_key, 0::BIGINT AS child_count, " + ", ".join(f"""CASE WHEN min(light) FILTER (WHERE {w}) IS NULL THEN NULL WHEN min(light) FILTER (WHERE {w}) = 1 AND max(light) FILTER (WHERE {w}) = 1 THEN 1 WHEN min(light) FILTER (WHERE {w}) = 3 AND max(light) FILTER (WHERE {w}) = 3 THEN 3 ELSE 2 END AS "{k}|light" """ for k in "ANR" for w in (f"l_returnflag = '{k}'",)) + " FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 3 WHEN l_quantity > 25 THEN 1 ELSE 2 END AS light FROM lineitem) GROUP BY 1, 2")
def pivot_rag(spark, sf_dir):
    calc = {"light": """if("l_returnflag" == 'A', 1, if("l_returnflag" == 'R', 3, "l_quantity" > 25 ? 1 : 2))"""}
    return lineitem(spark, sf_dir, calc=calc).view({"pivotMode": True, "rowGroupCols": by("l_linestatus"), "pivotCols": by("l_returnflag"), "valueCols": of("trafficLight light")})


@query("SELECT o_orderstatus, o_orderstatus AS group_key, count(*) AS child_count, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1, 2")
def pivot_without_columns(spark, sf_dir):
    return rounded(orders(spark, sf_dir).view({"pivotMode": True, "rowGroupCols": by("o_orderstatus"), "valueCols": of("sum o_totalprice")}))


@query("SELECT o_orderstatus, o_orderstatus AS group_key, 0::BIGINT AS child_count FROM orders WHERE false")
def pivot_past_last_level(spark, sf_dir):
    return orders(spark, sf_dir).view({"pivotMode": True, "rowGroupCols": by("o_orderstatus"), "groupKeys": ["F"], "pivotCols": by("o_orderpriority"), "valueCols": of("sum o_totalprice")})


# --- trees ---


@query("SELECT o_orderpriority, o_orderpriority AS group_key, count(*) AS child_count, round(sum(o_totalprice), 2) AS o_totalprice, true AS \"group\", o_orderpriority AS tree_key, o_orderpriority AS tree_label FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2")
def tree_level(spark, sf_dir):
    return rounded(orders(spark, sf_dir, tree=["o_orderstatus", "o_orderpriority"]).view({"treeData": True, "groupKeys": ["O"], "valueCols": of("sum o_totalprice")}))


@query("SELECT o_orderkey, false AS \"group\", o_orderkey::VARCHAR AS tree_key, o_orderkey::VARCHAR AS tree_label FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'")
def tree_leaves(spark, sf_dir):
    out = orders(spark, sf_dir, tree=["o_orderstatus", "o_orderpriority"]).view({"treeData": True, "groupKeys": ["P", "2-HIGH"]})
    return out.select("o_orderkey", "group", "tree_key", "tree_label")


# --- services ---


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL")
def distinct_values(spark, sf_dir):
    return orders(spark, sf_dir).distinct_values("main", "o_orderpriority")


@query("SELECT o_custkey AS category, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def series(spark, sf_dir):
    r = {"filterModel": {"o_orderstatus": {"filterType": "text", "type": "equals", "filter": "F"}}, "valueCols": of("sum o_totalprice")}
    return rounded(orders(spark, sf_dir).series("o_custkey", r, limit=None))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 500")
def detail_lookup(spark, sf_dir):
    return orders(spark, sf_dir).detail("main", {"o_custkey": 7, "o_orderstatus": "O"}).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey AS master_c_custkey, o_orderkey, detail_no FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS detail_no FROM orders) ON o_custkey = c_custkey AND detail_no <= 3")
def detail_join(spark, sf_dir):
    master = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return orders(spark, sf_dir).details_of(master, "main", {"o_custkey": "c_custkey"}, 3).select("master_c_custkey", "o_orderkey", F.col("detail_no").cast("long").alias("detail_no"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 50000")
def group_leaf_rows(spark, sf_dir):
    r = {"rowGroupCols": by("o_orderstatus", "o_orderpriority"), "groupKeys": ["F", "1-URGENT"], "filterModel": {"o_orderpriority": {"filterType": "text", "type": "equals", "filter": "5-LOW"}, "o_totalprice": {"filterType": "number", "type": "greaterThan", "filter": 50000}}}
    return orders(spark, sf_dir).group_leaf_rows(r).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def query_all(spark, sf_dir):
    e = engine(spark, sf_dir, "events", "event_id")
    r = {"filterModel": {"event_type": {"filterType": "text", "type": "equals", "filter": "purchase"}}, "sortModel": [{"colId": "value", "sort": "desc"}]}
    return e.query_all(r, limit=None).select("event_id", "value")


# --- changes ---


def _changed(spark, sf_dir) -> Engine:
    """Partial patches, removals and added rows on orders, one after another, through the engine."""
    e = orders(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e.upsert("main", table.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("P").alias("o_orderstatus")))
    e.upsert("main", table.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(2.0).alias("o_totalprice")))
    e.apply("main", {"update": [{"o_orderkey": k, "o_totalprice": None} for k in range(1, 40)], "add": [{"o_orderkey": 0, "o_orderstatus": "A"}]})
    e.apply("main", {"remove": [3, {"o_orderkey": 7}], "update": [{"o_orderkey": 7, "o_orderpriority": "again"}, {"o_orderkey": 5, "o_totalprice": 1.5}]})
    return e


@query("WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 'A' WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 0 THEN 2.0 WHEN o_orderkey = 5 THEN 1.5 WHEN o_orderkey BETWEEN 1 AND 39 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey NOT IN (3, 7)) SELECT * FROM a UNION ALL SELECT -o_orderkey, 'N', 2.0, NULL FROM orders WHERE o_orderkey <> 0 UNION ALL SELECT k, CASE WHEN k % 5 = 0 AND k > 0 THEN NULL WHEN k = 0 THEN 'A' END, CASE WHEN k = 5 THEN 1.5 END, CASE WHEN k = 7 THEN 'again' END FROM range(0, 40) t(k) WHERE k NOT IN (SELECT o_orderkey FROM a) AND k <> 3")
def engine_changes(spark, sf_dir):
    return _changed(spark, sf_dir).view({}).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def load_last_of_each_key(spark, sf_dir):
    e, df = Engine(spark, NOW), spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    e.configure("main", S.of_frame(df), "user_id")
    e.load("main", df, order="event_id")
    return e.view({}).select("user_id", "event_type", "value")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    start = df.select("user_id", "event_type", "value").limit(0)
    return mutations.upserted(start, mutations.as_patches(df, "event_id"), "user_id")


def _transaction(spark, sf_dir, customers: DataFrame) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    gone = base.where("o_orderkey % 7 = 0").select("o_orderkey")
    names = lambda *x: F.array(*map(F.lit, x))
    update = base.where("o_orderkey % 3 = 0 and o_orderkey % 7 != 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"), names("o_orderkey", "o_orderstatus", "o_totalprice").alias(mutations.PRESENT), F.lit(2).cast("long").alias(mutations.SEQ))
    add = customers.select((-F.col("c_custkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"), names("o_orderkey", "o_orderstatus", "o_totalprice").alias(mutations.PRESENT), F.lit(1).cast("long").alias(mutations.SEQ))
    return mutations.upserted(mutations.removed(base, gone, "o_orderkey"), add.unionByName(update), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE NOT o_orderkey % 7 = 0 UNION ALL SELECT -c_custkey, 'N', c_acctbal, NULL FROM customer")
def transaction_apply(spark, sf_dir):
    return _transaction(spark, sf_dir, spark.read.parquet(f"{sf_dir}/customer.parquet"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(windows.tumbling(df, "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]))


@query("SELECT min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, user_id, count(*) AS n FROM (SELECT ts, user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT ts, user_id, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def events_sessions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windows.sessions(df, "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
