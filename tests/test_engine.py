"""Views, aggregates, services and changes on small tables made for their corner cases."""

import datetime as dt
import random

import pytest

from quarrygrid import schema as S
from quarrygrid.engine import Engine
from quarrygrid.functions.aggregates import UnknownAggregate, register
from quarrygrid.model import RequestError, ViewRequest
from quarrygrid.operators import mutations as M
from quarrygrid.plans import services
from quarrygrid.sources import generated, ingest, sinks
from quarrygrid.streaming import feed

SCHEMA = {"id": "string", "desk": "string", "ccy": "string", "pnl": "float", "n": "integer", "quantity": "float"}
ROWS = [
    {"id": "a", "desk": "FX", "ccy": "USD", "pnl": 10.0, "n": 1, "quantity": 2.0},
    {"id": "b", "desk": "FX", "ccy": "EUR", "pnl": -40.0, "n": 3, "quantity": 0.0},
    {"id": "c", "desk": "FX", "ccy": "a|b", "pnl": None, "n": 3, "quantity": 1.0},
    {"id": "d", "desk": "", "ccy": None, "pnl": 5.0, "n": 1, "quantity": None},
    {"id": "e", "desk": None, "ccy": "USD", "pnl": 7.0, "n": None, "quantity": 3.0},
    {"id": "f", "desk": None, "ccy": "USD", "pnl": 1.0, "n": 2, "quantity": 1.0},
]


@pytest.fixture
def e(spark):
    out = Engine(spark, dt.datetime(2024, 3, 15))
    out.configure("main", SCHEMA, "id", {"bps": '"n" != 0 and "n" != null ? "pnl" / "n" * 100 : null'}, ["desk", "ccy"])
    out.load("main", ROWS)
    return out


def by(*f):
    return [{"field": x} for x in f]


def of(*p):
    return [{"field": x.split()[1], "aggFunc": x.split()[0]} for x in p]


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_groups(e):
    got = rows(e.view({"rowGroupCols": [*by("desk"), {"field": ""}], "valueCols": of("sum pnl", "avg bps")}))
    assert [(r["desk"], r["group_key"], r["child_count"], r["pnl"]) for r in got] == [("", "", 1, 5.0), ("FX", "FX", 3, -30.0), (None, "", 2, 8.0)]
    assert {c for r in got for c in r} == {"desk", "group_key", "child_count", "pnl", "bps"}
    # A measure on the group's own field and two on one field keep apart.
    got = rows(e.view({"rowGroupCols": by("ccy"), "groupKeys": [], "valueCols": of("count pnl", "max pnl")}))
    assert {"pnl", "pnl_max"} <= set(got[0])


def test_path_and_leaves(e):
    r = {"rowGroupCols": by("desk", "ccy"), "groupKeys": ["FX"], "sortModel": [{"colId": "ag-Grid-AutoColumn", "sort": "desc"}]}
    assert [x["ccy"] for x in rows(e.view(r))] == ["a|b", "USD", "EUR"]
    assert [x["id"] for x in rows(e.view(r | {"groupKeys": ["FX", "a|b"]}))] == ["c"]
    assert [x["id"] for x in rows(e.view(r | {"groupKeys": [None, "USD"]}))] == ["e", "f"]
    assert {x["id"] for x in rows(e.view({"rowGroupCols": by("desk"), "groupKeys": [""]}))} == {"d", "e", "f"}
    assert e.view({}).columns == sorted([*SCHEMA, "bps"])


def test_sorting_and_pages(e):
    names = lambda **r: [x["id"] for x in rows(e.view(r))]
    assert names(sortModel=[{"colId": "pnl", "sort": "asc"}]) == ["b", "f", "d", "e", "a", "c"]
    assert names(sortModel=[{"colId": "pnl", "sort": "desc"}]) == ["a", "e", "d", "f", "b", "c"]
    assert names(sortModel=[{"colId": "pnl", "sort": "desc"}], absSort=True) == ["b", "a", "e", "d", "f", "c"]
    assert names(sortModel=[{"colId": "pnl", "sort": "asc", "abs": True}], startRow=1, endRow=3) == ["d", "e"]
    assert names(sortModel=[{"colId": "nope", "sort": "asc"}, {"colId": "n", "sort": "desc"}]) == ["b", "c", "f", "a", "d", "e"]
    assert e.page({"startRow": 2, "endRow": 4}).row_count == 6
    plan = e.view({"startRow": 1, "endRow": 3, "sortModel": [{"colId": "pnl", "sort": "asc"}]})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_aggregates(e):
    want = {"sum": -17.0, "avg": -17 / 5, "count": 5, "min": -40.0, "max": 10.0, "first": 10.0, "last": 1.0, "lastByIndex": 1.0, "countDistinct": 5, "median": 5.0}
    m = e.aggregate_matrix({"valueCols": of(*(f"{f} pnl" for f in want))})
    assert m["rowCount"] == 6 and m["totals"] == {"pnl": -17.0}
    assert {k: v for k, v in m["aggregates"]["pnl"].items() if k in want} == pytest.approx(want)
    one = e.aggregates({"valueCols": of("stddev n", "var n", "weightedAvg pnl", "rag n", "sum pnl", "any desk"), "filterModel": {"id": {"filterType": "set", "values": ["a", "e", "f"]}}}).first()
    assert one.agg_n_stddev == pytest.approx(0.7071, abs=1e-4) and one.agg_n_var == pytest.approx(0.5) and one.agg_pnl_weightedAvg == pytest.approx((20 + 21 + 1) / 6)
    assert one.agg_n_trafficLight == 2
    none = e.aggregates({"valueCols": of("sum pnl", "avg pnl", "weightedAvg pnl", "rag n"), "filterModel": {"id": {"filterType": "set", "values": []}}}).first()
    assert (none.row_count, none.agg_pnl_sum, none.agg_pnl_avg, none.agg_pnl_weightedAvg, none.agg_n_trafficLight) == (0, 0.0, None, None, None)
    # first and last keep a null of the row they name.
    assert rows(e.view({"rowGroupCols": by("desk"), "valueCols": of("last pnl"), "filterModel": {"desk": {"filterType": "text", "type": "equals", "filter": "FX"}}}))[0]["pnl"] is None
    with pytest.raises(UnknownAggregate):
        e.view({"rowGroupCols": by("desk"), "valueCols": of("mode pnl")})
    from pyspark.sql import functions as F

    register("range", lambda x, _: F.max(x) - F.min(x))
    assert e.aggregates({"valueCols": of("range pnl")}).first().agg_pnl_range == 50.0


@pytest.mark.parametrize(("values", "want"), [((1, 1), 1), ((3, 3), 3), ((1, 3), 2), ((2, 2), 2), ((None, None), None)])
def test_light(spark, values, want):
    e = Engine(spark)
    e.configure("main", {"id": "string", "rag": "integer"}, "id")
    e.load("main", [{"id": str(k), "rag": v} for k, v in enumerate(values)])
    assert e.grand_total({"valueCols": of("trafficLight rag")}).first().rag == want


def test_shares(e):
    from pyspark.sql import functions as F

    from quarrygrid.functions import shares

    total = e.aggregates({"valueCols": of("sum pnl", "max pnl")})
    got = {r["id"]: r["s"] for r in rows(services.with_share(e.view({}), "pnl", total, "max", "s"))}
    assert got["a"] == 1.0 and got["b"] == -4.0 and got["c"] is None
    df = e.spark.createDataFrame([(25.0, 100.0), (25.0, 0.0), (25.0, None), (None, 1.0), (1.0, float("inf"))], "v double, t double")
    out = df.select(shares.share(F.col("v"), F.col("t")).alias("s")).select("s", shares.as_percent(F.col("s")).alias("p"), shares.exceeds(F.col("s"), 0.25).alias("x")).collect()
    assert [tuple(r) for r in out] == [(0.25, "25.00%", False), *[(None, None, False)] * 4]


def test_pivot(e):
    page = e.page({"pivotMode": True, "rowGroupCols": by("desk", "id"), "pivotCols": by("ccy"), "valueCols": of("sum pnl")})
    assert page.pivot_fields == ["EUR|pnl", "USD|pnl", "a\\|b|pnl", "null|pnl"]
    got = {r["desk"]: r for r in page.rows}
    assert got["FX"]["USD|pnl"] == 10.0 and got["FX"]["child_count"] == 3 and got[""]["null|pnl"] == 5.0 and got[None]["USD|pnl"] == 8.0 and got[None]["EUR|pnl"] is None
    two = e.page({"pivotMode": True, "pivotCols": by("desk", "ccy"), "valueCols": of("sum pnl", "rag n")})
    assert two.rows[0]["pivot_root"] == "root" and two.rows[0]["FX|EUR|pnl"] == -40.0 and two.rows[0]["null|USD|n"] == 2
    last = e.page({"pivotMode": True, "rowGroupCols": by("desk"), "groupKeys": ["FX"], "pivotCols": by("ccy"), "valueCols": of("sum pnl")})
    assert last.rows == [] and last.row_count == 0
    # A filter tree is about leaves, not about pivot rows.
    kept = e.page({"pivotMode": True, "rowGroupCols": by("desk"), "pivotCols": by("ccy"), "valueCols": of("sum pnl"), "filterModel": {"filterType": "join", "type": "AND", "conditions": [{"colId": "id", "filterType": "text", "type": "equals", "filter": "a"}]}})
    assert kept.pivot_fields == ["USD|pnl"] and len(kept.rows) == 1


def test_tree(e):
    got = rows(e.view({"treeData": True, "valueCols": of("sum pnl")}))
    assert [(r["tree_key"], r["group"]) for r in got] == [("", True), ("FX", True), ("", True)]
    assert [(r["tree_key"], r["tree_label"], r["group"]) for r in rows(e.view({"treeData": True, "groupKeys": ["FX", "EUR"]}))] == [("b", "b", False)]


def test_services(e):
    assert [r.value for r in e.distinct_values("main", "ccy").collect()] == ["EUR", "USD", "a|b"]
    assert e.distinct_values("main", "nope").count() == 0 and e.distinct_values("main", "bps").count() == 4
    assert [(r["category"], r["pnl"]) for r in rows(e.series("desk", {"valueCols": of("sum pnl")}))] == [("", 5.0), ("FX", -30.0), (None, 8.0)]
    assert [r["id"] for r in rows(e.detail("main", {"desk": None, "n": "2"}))] == ["f"] and e.detail("main", {"ccy": "USD"}, 2).count() == 2
    master = e.spark.createDataFrame([("USD",), (None,), ("CHF",)], "cur string")
    assert sorted((r["master_cur"] or "-", r["id"] or "-") for r in rows(e.details_of(master, "main", {"ccy": "cur"}, 2))) == [("-", "d"), ("CHF", "-"), ("USD", "a"), ("USD", "e")]
    assert tuple(e.counts({"quickFilterText": "fx"}).first()) == (6, 3) and e.count_matching("main", {"n": {"filterType": "number", "type": "equals", "filter": 3}}) == 2
    assert e.query_all({"limit": 2}).count() == 2 and e.query_all({"limit": None, "rowGroupCols": by("desk")}).count() == 6 and e.query_all({"includeStructure": True, "rowGroupCols": by("desk")}).count() == 3
    r = {"rowGroupCols": by("desk"), "groupKeys": ["FX"], "filterModel": {"desk": {"filterType": "text", "type": "equals", "filter": "other"}}}
    assert e.group_leaf_rows(r).count() == 3
    levels = rows(e.levels({"rowGroupCols": by("desk", "ccy"), "valueCols": of("sum pnl")}))
    assert sorted(r["level"] for r in levels) == [0, 1, 1, 1, 2, 2, 2, 2, 2] and sum(r["child_count"] for r in levels if r["level"] == 1) == 6
    with pytest.raises(RequestError):
        e.view({"rowGroupCols": by("nope")})
    with pytest.raises(RequestError):
        e.view({"dataset": "nope"})


def test_changes(e):
    e.apply("main", {"remove": ["a", {"id": "b"}], "update": [{"id": "a", "pnl": 99.0}, {"id": "c", "ccy": None}, {"pnl": 3.0}], "add": [{"id": "g", "desk": "New"}]})
    got = {r["id"]: r for r in rows(e.view({}))}
    assert set(got) == {"a", "c", "d", "e", "f", "g"}
    assert got["a"]["pnl"] == 99.0 and got["a"]["desk"] is None  # removed first, so only the patch is left
    assert got["c"]["ccy"] is None and got["c"]["desk"] == "FX" and got["g"]["pnl"] is None
    e.edit("main", "g", "pnl", "12.5")
    e.edit("main", "g", "n", "3.9")
    e.edit("main", "g", "desk", "")
    row = e.detail("main", {"id": "g"}).first()
    assert (row.pnl, row.n, row.desk) == (12.5, 3, None)
    version = e.dataset("main").version
    assert e.remove("main", []).version == version
    e.clear("main")
    assert e.size("main") == 0 and e.dataset("main").version == version + 1


def test_random_transactions_against_a_dict(spark):
    r = random.Random(4)
    e = Engine(spark, compact=0)
    e.configure("main", {"k": "integer", "a": "float", "b": "string"}, "k")
    want: dict = {}
    txs = []
    for _ in range(14):
        patch = lambda: {"k": r.randrange(8)} | ({"a": r.choice([None, 1.0, 2.5])} if r.random() < 0.6 else {}) | ({"b": r.choice([None, "x", ""])} if r.random() < 0.6 else {})
        txs.append({"add": [patch() for _ in range(r.randrange(3))], "update": [patch() for _ in range(r.randrange(4))], "remove": [r.randrange(8) for _ in range(r.randrange(2))]})
    for tx in txs:
        for k in tx["remove"]:
            want.pop(k, None)
        for p in [*tx["add"], *tx["update"]]:
            want.setdefault(p["k"], {"a": None, "b": None}).update({c: v for c, v in p.items() if c != "k"})
    e.apply_all("main", txs)
    assert len(M.coalesced(txs, "k")) < len(txs)
    assert {x["k"]: {"a": x["a"], "b": x["b"]} for x in rows(e.view({}))} == want


def test_changed_keys():
    assert M.changed_keys({"add": [{"id": 1}], "update": [{"id": 2}, {"x": 1}]}, "id") == ([1, 2], False)
    assert M.changed_keys({"remove": [1]}, "id") == ([], True) and M.changed_keys({}, "id") == ([], True)


def test_listeners_and_versions(e):
    seen, pages = [], []
    stop = e.subscribe(lambda c: seen.append((c.dataset, c.keys)))
    end = e.watch({"rowGroupCols": by("desk"), "valueCols": of("sum pnl")}, pages.append)
    assert e.is_current(pages[0])
    e.apply("main", {"update": [{"id": "a", "pnl": 1.0}]})
    assert not e.is_current(pages[0]) and e.is_current(pages[1])
    e.apply("main", {"remove": ["b"]})
    e.upsert("main", [{"id": "z"}])
    end(), stop(), stop()
    e.remove("main", ["z"])
    assert seen == [("main", ["a"]), ("main", None), ("main", ["z"])] and len(pages) == 4
    assert [{r["desk"]: r["pnl"] for r in p.rows}["FX"] for p in pages[:3]] == [-30.0, -39.0, 1.0]


def test_load_collapses_equal_keys_and_appends_without_key(spark, e):
    e.load("main", [{"id": "x", "pnl": 1.0, "desk": "A"}, {"id": "x", "pnl": 2.0}])
    assert rows(e.view({}))[0] | {} == {"id": "x", "pnl": 2.0, "desk": "A", "ccy": None, "n": None, "quantity": None, "bps": None}
    e.configure("log", {"a": "integer"}, None)
    e.load("log", [{"a": 1}, {"a": 1}])
    e.upsert("log", [{"a": 2}])
    assert e.size("log") == 3
    df = spark.createDataFrame([(1, "p", 5), (1, "q", 9), (2, "r", 1)], "id long, v string, seq long")
    e.configure("seqd", {"id": "integer", "v": "string", "seq": "integer"}, "id")
    e.load("seqd", df, order="seq")
    assert {(r["id"], r["v"]) for r in rows(e.view({"dataset": "seqd"}))} == {(1, "q"), (2, "r")}


def test_cache_and_fingerprint(e):
    r = {"valueCols": of("sum pnl")}
    assert e.aggregate_matrix(r) is e.aggregate_matrix(r | {"sortModel": [{"colId": "pnl", "sort": "asc"}]})
    for k in range(10):
        e.aggregate_matrix(r | {"quickFilterText": str(k)})
    assert len(e.cache) == 8
    e.remove("main", ["a"])
    assert e.aggregate_matrix(r)["totals"]["pnl"] == -27.0
    a, b = ViewRequest.of(r), ViewRequest.of(r | {"startRow": 5})
    assert a.fingerprint() == ViewRequest.of(dict(r)).fingerprint() != b.fingerprint() != b.fingerprint(1)


def test_schema_derivation():
    defs = [{"headerName": "G", "children": [{"field": "assetClass"}, {"field": "sector", "cellDataType": "text"}]}, {"field": "cusip", "cellDataType": "dateString"}, {"field": "px", "type": "integer"}, {"field": "bps", "expression": '"px" * 2'}, {"headerName": "no field"}]
    schema, calc = S.derive(defs, "id", {"px": 1.5, "book": "b", "dailyPnl": 3, "spark": [1, 2], "obj": {}, "on": True, "when": dt.datetime(2024, 1, 1), "bps": 9})
    assert schema == {"assetClass": "string", "sector": "string", "cusip": "string", "px": "integer", "book": "string", "dailyPnl": "float", "on": "boolean", "when": "datetime", "id": "string"}
    assert calc == {"bps": '"px" * 2'}
    assert S.coerced("", "float") is None and S.coerced("2.9", "integer") == 2 and S.coerced("x", "float") is None and S.coerced(5, "string") == "5"


def test_dotted_names(spark):
    e = Engine(spark)
    e.configure("main", {"id": "string", "rating.moody": "string", "a`b": "float"}, "id", {"up": 'lower("rating.moody")'})
    e.load("main", [{"id": "1", "rating.moody": "Aa", "a`b": 2.0}])
    assert rows(e.view({"rowGroupCols": by("rating.moody"), "valueCols": of("sum a`b"), "filterModel": {"rating.moody": {"filterType": "text", "type": "equals", "filter": "Aa"}}})) == [{"rating.moody": "Aa", "group_key": "Aa", "child_count": 1, "a`b": 2.0}]
    assert rows(e.view({}))[0]["up"] == "aa"


def test_sources_and_sinks(spark, e, tmp_path):
    assert [len(c) for c in ingest.chunks(list(range(6000)))] == [2500, 2500, 1000]
    assert S.project_rows([{"a": 1, "x": 2}, {}], ["a", "b"]) == [{"a": 1}, {}] and S.project_rows([{"a": 1}], []) == [{"a": 1}]
    cols = sinks.export_columns([{"field": "id", "headerName": "Key"}, {"field": "pnl"}, {"field": "n", "hide": True}, {"headerName": "none"}])
    e.export({"sortModel": [{"colId": "pnl", "sort": "desc"}]}, str(tmp_path / "csv"), columns=cols)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["Key", "pnl"] and back.count() == 6
    for fmt in ("parquet", "json", "orc"):
        e.export({}, str(tmp_path / fmt), fmt, limit=3)
        assert ingest.read(spark, str(tmp_path / fmt), {"id": "string", "pnl": "float"}, "id", fmt).count() == 3
    p = generated.parcels(spark, 500)
    assert p.select("id").distinct().count() == 500 and p.exceptAll(generated.parcels(spark, 500).repartition(7)).count() == 0
    assert p.where("fee < 2 or fee > 90 or depot is null").count() == 0


def test_messages(spark):
    e = Engine(spark)
    ok = lambda **m: e.handle({"requestId": "1", **m})
    assert ok(type="configure", config={"dataset": "main", "schema": {"id": "string", "v": "float"}, "index": "id"}) == {"type": "configureResult", "requestId": "1", "ok": True, "rowCount": 0}
    assert ok(type="setRowData", dataset="main", rows=[{"id": "a", "v": 1.0}, {"id": "b", "v": 2.0}])["rowCount"] == 2
    assert ok(type="updateRows", dataset="main", rows=[{"id": "c", "v": 4.0}])["rowCount"] == 3
    assert ok(type="removeRows", dataset="main", ids=["a"])["rowCount"] == 2
    assert ok(type="applyTransaction", request={"dataset": "main", "update": [{"id": "b", "v": 5.0}]})["ok"]
    page = ok(type="getRows", request={"dataset": "main", "startRow": 0, "endRow": 1, "valueCols": of("sum v")})["result"]
    assert page["rowData"] == [{"id": "b", "v": 5.0}] and page["rowCount"] == 2 and page["totals"] == {"v": 9.0}
    assert ok(type="getFilterValues", dataset="main", field="id")["values"] == ["b", "c"]
    assert ok(type="getAggregates", request={"dataset": "main", "valueCols": of("max v")})["result"]["aggregates"]["v"]["max"] == 5.0
    assert ok(type="queryAll", request={"dataset": "main", "limit": 1})["result"]["rowCount"] == 2
    assert ok(type="getSeriesData", request={"dataset": "main", "categoryField": "id", "valueCols": of("sum v")})["result"]["rowCount"] == 2
    assert ok(type="getDetailRows", request={"dataset": "main", "match": {"id": "c"}})["result"]["rowData"][0]["v"] == 4.0
    assert not ok(type="getRows", request={"dataset": "nope"})["ok"] and "nope" in ok(type="getRows", request={"dataset": "nope"})["error"]
    assert not ok(type="other")["ok"] and ok(type="dispose")["ok"] and not e.datasets


def test_feed(spark, tmp_path):
    base = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y"), ("c", 3.0, "z")], "id string, v double, w string")
    store = feed.SnapshotStore(spark, str(tmp_path / "store"), "id", keep=2)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(base, 0)
    changes = tmp_path / "in"
    schema = "id string, v double, seq long, gone boolean"
    seen = []
    for k, part in enumerate([[("a", 9.0, 2, None), ("a", 8.0, 1, None), ("d", 4.0, 3, None)], [("b", None, 4, True), ("c", 7.0, 5, False)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(changes))
        q = feed.apply_feed(feed.folder_stream(spark, str(changes), schema), store, str(tmp_path / "cp"), removal="gone", on_change=lambda df, v: seen.append((v, sorted(r.id for r in df.collect()))))
        q.awaitTermination(120)
        assert store.version == k + 1
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 9.0, "x"), ("c", 7.0, "z"), ("d", 4.0, None)]
    assert seen == [(1, ["a", "d"]), (2, ["b", "c"])] and store.versions() == [1, 2]
    # A batch that runs again makes the same version again.
    feed.apply_batch(store, spark.createDataFrame([("b", None, 4, True), ("c", 7.0, 5, False)], schema), 1, removal="gone")
    assert store.version == 2 and store.read().count() == 3


def test_windows_on_a_stream(spark, tmp_path, small):
    from pyspark.sql import functions as F

    from quarrygrid.streaming import windows

    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = feed.folder_stream(spark, str(tmp_path / "e"), events.schema)
    counted = lambda df: windows.tumbling(df, "ts", "1 day", [], [F.count(F.lit(1)).alias("n")], "1 day")
    q = counted(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, counted(events).collect()))
    sliding = windows.sliding(events, "ts", "2 days", "1 day", [], [F.count(F.lit(1)).alias("n")])
    assert sum(r.n for r in sliding.collect()) == 2 * events.count()


def plan_leaves(df):
    plan = df._jdf.queryExecution().analyzed()
    return plan.collectLeaves().size()


def test_many_changes_cost_what_they_hold(spark):
    """50 upserts, a removal and an edit: one plan of one size, and the rows that a plain table would have."""
    e = Engine(spark)
    e.configure("main", {"id": "string", "v": "float", "w": "string"}, "id")
    rows = {f"k{k}": {"id": f"k{k}", "v": float(k), "w": "x"} for k in range(100)}
    e.load("main", list(rows.values()))
    sizes = []
    for k in range(50):
        patch = {"id": f"k{k * 3 % 130}", "v": float(-k)} if k % 2 else {"id": f"k{k}", "w": None}
        e.upsert("main", [patch])
        rows[patch["id"]] = {"id": patch["id"], "v": None, "w": None} | rows.get(patch["id"], {}) | patch
        if k in (5, 49):
            sizes.append(plan_leaves(e.dataset("main").frame))
    assert sizes[0] == sizes[1]
    e.remove("main", ["k1", "k2"])
    e.edit("main", "k2", "w", "back")
    rows.pop("k1")
    rows["k2"] = {"id": "k2", "v": None, "w": "back"}
    assert sorted(map(str, (r.asDict() for r in e.dataset("main").frame.select("id", "v", "w").collect()))) == sorted(map(str, rows.values()))
    assert e.size("main") == len(rows)


def test_pending_rows_are_written_when_many(spark):
    e = Engine(spark, most_pending=5, compact=2)
    written = e._written
    seen = []
    e._written = lambda name, frame: seen.append(name) or written(name, frame)
    e.configure("main", {"id": "integer", "v": "float"}, "id")
    e.upsert("main", [{"id": k, "v": 1.0} for k in range(4)])
    e.upsert("main", [{"id": k, "v": 2.0} for k in range(2, 9)])
    assert seen == ["main"]
    if spark.conf.get("spark.checkpoint.dir", None):
        assert plan_leaves(e.dataset("main").frame) == 1
    for k in range(6):
        e.upsert("main", spark.createDataFrame([(k, 9.0)], "id long, v double"))
    assert seen == ["main"] * 4
    assert sorted(tuple(r) for r in e.dataset("main").frame.collect()) == [(k, 9.0 if k < 6 else 2.0) for k in range(9)]


def test_blocks_are_shared_patched_and_dropped(spark):
    from concurrent.futures import ThreadPoolExecutor

    e = Engine(spark)
    e.configure("main", {"id": "string", "v": "float"}, "id")
    e.load("main", [{"id": f"k{k:02}", "v": float(k)} for k in range(10)])
    b = e.blocks(4)
    plain, sorted_ = {"dataset": "main"}, {"dataset": "main", "sortModel": [{"colId": "v", "sort": "desc"}]}
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: b.get(plain, 1), range(4)))
    assert b.queries == 1 and all(x is got[0] for x in got) and [r["id"] for r in got[0]] == ["k04", "k05", "k06", "k07"]
    assert b.get(sorted_, 0)[0]["id"] == "k09" and b.queries == 2
    e.upsert("main", [{"id": "k05", "v": 99.0}])
    # The row is replaced where it stands; the sorted block, in which it moves, is read again.
    assert b.get(plain, 1)[1] == {"id": "k05", "v": 99.0} == b.find("main", "k05") and b.queries == 2
    assert b.get(sorted_, 0)[0]["id"] == "k05" and b.queries == 3
    e.remove("main", ["k00"])
    assert [r["id"] for r in b.get(plain, 0)] == ["k01", "k02", "k03", "k04"] and b.queries == 4
    assert b.get(plain, 1)[0]["id"] == "k05" and b.queries == 5
    e.upsert("main", [{"id": "k00", "v": 1.0}])
    assert b.get(plain, 1)[0]["id"] == "k04"
    b.close()


def test_throttle_leads_and_trails():
    import time

    from quarrygrid.streaming.refresh import Throttle

    seen = []
    t = Throttle(lambda: seen.append(1), 0.2)
    for _ in range(5):
        t()
    assert len(seen) == 1
    time.sleep(0.5)
    assert len(seen) == 2
    t()
    t()
    t.close()
    time.sleep(0.4)
    assert len(seen) == 3


def test_row_ids_and_stamped_aggregates():
    from quarrygrid.functions.shares import resolved
    from quarrygrid.model import ViewRequest, row_id

    r = ViewRequest(groups=("a", "b"), keys=("x|y",))
    assert row_id(r, {"group_key": None}, "id") == "g:x\\|y|\\0" and row_id(ViewRequest(), {"id": 5}, "id") == "5"
    assert row_id(ViewRequest(tree=True, keys=()), {"group_key": "q"}, "id", ["a"]) == "t:q" and row_id(ViewRequest(tree=True, keys=("q",)), {"id": 1}, "id", ["a"]) == "tl:1"
    assert resolved("v", "sum", {"v": {"sum": 0}}, {"v": {"sum": 5}}) == 0 and resolved("v", "sum", {"v": {"max": 1}}, {"v": {"sum": 5}}) == 5 and resolved("v", "sum", None, {}, 7) == 7
