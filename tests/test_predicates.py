"""Filter models against a row-by-row evaluator, and each decision on its own."""

import datetime as dt
import random

import pytest

from quarrygrid.operators import predicates as P

SCHEMA = {"id": "integer", "desk": "string", "region": "string", "pnl": "float", "n": "integer", "day": "date", "at": "datetime_ntz", "ok": "boolean"}
NOW = dt.datetime(2024, 3, 15, 12)


def rows():
    r = random.Random(1)
    out = [(0, None, "", None, None, None, None, None), (1, "", None, 0.0, 0, dt.date(2024, 3, 15), dt.datetime(2024, 3, 15, 0, 0), True)]
    for i in range(2, 120):
        day = dt.date(2024, 3, 15) - dt.timedelta(r.randrange(120))
        out.append((i, r.choice(["IG Credit", "credit", "FX (a+b)", "Eq\\'s", "", None]), r.choice(["EMEA", "APAC", None]), r.choice([None, -2.5, 0.0, 10.0, 1e6]), r.choice([None, 0, 1, 7]), r.choice([None, day]), dt.datetime.combine(day, r.choice([dt.time(0), dt.time(23, 59, 59)])), r.choice([True, False, None])))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "id long, desk string, region string, pnl double, n long, day date, at timestamp_ntz, ok boolean").cache()


def evaluate(c, value, kind):
    """One simple condition on one value, by the words of the language."""
    of, op = c["filterType"], c.get("type")
    if of == "set":
        return value in c["values"]
    if op in ("blank", "notBlank"):
        blank = value is None or kind == "string" and value == ""
        return blank == (op == "blank")
    if of == "text":
        if op in ("equals", "notEqual"):
            return (value == c["filter"]) == (op == "equals")
        hay, needle = None if value is None else value.lower(), c["filter"].lower()
        found = hay is not None and {"contains": needle in hay, "notContains": needle in hay, "startsWith": hay.startswith(needle), "endsWith": hay.endswith(needle)}[op]
        return not found if op == "notContains" else found
    if of == "date":
        value = value.date() if isinstance(value, dt.datetime) else value
        if op in P.PRESETS:
            a, b = P.preset_days(op, NOW)
            return value is not None and a <= value <= b
        low, high = (dt.date.fromisoformat(c[k][:10]) if c.get(k) else None for k in ("dateFrom", "dateTo"))
    else:
        low, high = c.get("filter"), c.get("filterTo")
    if op == "inRange":
        return value is not None and (low is None or value >= low) and (high is None or value <= high)
    if op in ("equals", "notEqual"):
        return (value == low) == (op == "equals")
    return value is not None and {"lessThan": value < low, "lessThanOrEqual": value <= low, "greaterThan": value > low, "greaterThanOrEqual": value >= low}[op]


def walk(node, row):
    if node.get("filterType") == "join":
        return (any if node["type"] == "OR" else all)(walk(x, row) for x in node["conditions"])
    if "conditions" in node:
        return (any if node["operator"] == "OR" else all)(walk({"colId": node["colId"], "filterType": node["filterType"], **x}, row) for x in node["conditions"])
    return evaluate(node, row[list(SCHEMA).index(node["colId"])], SCHEMA[node["colId"]])


def simple(r):
    kind = r.choice(["text", "number", "date", "set", "blank"])
    if kind == "text":
        return {"colId": r.choice(["desk", "region"]), "filterType": "text", "type": r.choice(["equals", "notEqual", "contains", "notContains", "startsWith", "endsWith"]), "filter": r.choice(["credit", "FX (a+b)", "A", "", "\\", "a+b"])}
    if kind == "number":
        op = r.choice(["equals", "notEqual", "lessThan", "lessThanOrEqual", "greaterThan", "greaterThanOrEqual", "inRange"])
        c = {"colId": r.choice(["pnl", "n"]), "filterType": "number", "type": op, "filter": r.choice([-2.5, 0, 1, 10])}
        return c | {"filterTo": r.choice([1, 7, 100])} if op == "inRange" and r.random() < 0.8 else c
    if kind == "date":
        op = r.choice([*P.PRESETS, "equals", "notEqual", "lessThan", "greaterThanOrEqual", "inRange"])
        return {"colId": r.choice(["day", "at"]), "filterType": "date", "type": op, "dateFrom": "2024-02-10 00:00:00", "dateTo": "2024-03-14"}
    if kind == "set":
        return r.choice([{"colId": "desk", "filterType": "set", "values": r.sample(["credit", "", None, "nope"], r.randrange(4))}, {"colId": "n", "filterType": "set", "values": [0, 7]}])
    return {"colId": r.choice(list(SCHEMA)), "filterType": "text", "type": r.choice(["blank", "notBlank"])}


def tree(r, depth):
    if depth and r.random() < 0.7:
        return {"filterType": "join", "type": r.choice(["AND", "OR"]), "conditions": [tree(r, depth - 1) for _ in range(r.randrange(1, 4))]}
    return simple(r)


def test_random_trees(frame):
    r, data = random.Random(2), rows()
    models = [tree(r, 3) for _ in range(60)]
    columns = [P.filter_model(m, SCHEMA, NOW).alias(f"m{k}") for k, m in enumerate(models)]
    got = frame.select("id", *columns).collect()
    for k, m in enumerate(models):
        assert {x.id for x in got if x[f"m{k}"]} == {row[0] for row in data if walk(m, row)}, m


def test_by_column_models(frame):
    r, data = random.Random(3), rows()
    for _ in range(12):
        parts = {c["colId"]: c for c in (simple(r) for _ in range(3))}
        got = {x.id for x in frame.where(P.filter_model(parts, SCHEMA, NOW)).collect()}
        assert got == {row[0] for row in data if all(walk(c, row) for c in parts.values())}
    for op in ("AND", "OR"):
        c = {"colId": "pnl", "filterType": "number", "operator": op, "conditions": [{"type": "inRange", "filter": -3, "filterTo": 0}, {"type": "greaterThan", "filter": 5}]}
        assert {x.id for x in frame.where(P.filter_model({"pnl": c}, SCHEMA)).collect()} == {row[0] for row in data if walk(c, row)}


def ids(frame, column):
    return sorted(r.id for r in frame.where(column).collect())


def test_decisions(frame):
    data = rows()
    model = lambda f, **c: P.filter_model({f: c}, SCHEMA, NOW)
    # Negations keep nulls; blank text is null or empty; equality minds case, substrings do not.
    assert 0 in ids(frame, model("desk", filterType="text", type="notEqual", filter="x")) and 0 in ids(frame, model("desk", filterType="text", type="notContains", filter="c"))
    assert {0, 1} <= set(ids(frame, model("desk", filterType="text", type="blank")))
    assert ids(frame, model("desk", filterType="text", type="equals", filter="CREDIT")) == []
    assert ids(frame, model("desk", filterType="text", type="contains", filter="CREDIT")) == [r[0] for r in data if r[1] and "credit" in r[1].lower()]
    # Sets: typed values, none match nothing, unusable ones match nothing.
    assert ids(frame, model("desk", filterType="set", values=[])) == []
    assert ids(frame, model("n", filterType="set", values=["7", "x"])) == [r[0] for r in data if r[4] == 7]
    assert ids(frame, model("ok", filterType="set", values=["true"])) == [r[0] for r in data if r[7]]
    assert ids(frame, model("day", filterType="set", values=["2024-03-15", "no day"])) == [r[0] for r in data if r[5] == dt.date(2024, 3, 15)]
    # The last second of a day belongs to it.
    late = [r[0] for r in data if r[6] and r[6].date() == dt.date(2024, 3, 14)]
    assert ids(frame, model("at", filterType="date", type="equals", dateFrom="2024-03-14")) == late
    # Null values ask for null.
    assert ids(frame, model("n", filterType="number", type="equals", filter=None)) == [r[0] for r in data if r[4] is None]
    assert P.filter_model({}, SCHEMA) is None and P.filter_model({"desk": None}, SCHEMA) is None
    assert ids(frame, P.filter_model({"filterType": "join", "type": "OR", "conditions": []}, SCHEMA)) == []


def test_multi_quick_path(frame):
    data = rows()
    m = {"desk": {"filterType": "multi", "filterModels": [{"filterType": "text", "type": "contains", "filter": "c"}, None, {"filterType": "set", "values": ["credit"]}]}}
    assert ids(frame, P.filter_model(m, SCHEMA)) == [r[0] for r in data if r[1] == "credit"]
    columns = P.quick_columns(SCHEMA, "id")
    assert columns == ["desk", "region"] and P.quick_columns(SCHEMA, "desk", ["region", "pnl"]) == ["region"]
    assert ids(frame, P.quick_filter("  eMe ", columns)) == [r[0] for r in data if r[2] == "EMEA"]
    assert P.quick_filter("  ", columns) is None and ids(frame, P.quick_filter("x", [])) == []
    assert ids(frame, P.path_filter(["desk", "n"], ["credit", "7"], SCHEMA)) == [r[0] for r in data if r[1] == "credit" and r[4] == 7]
    assert ids(frame, P.path_filter(["desk"], [""], SCHEMA)) == [r[0] for r in data if not r[1]]
    assert ids(frame, P.path_filter(["desk"], [None], SCHEMA)) == [r[0] for r in data if r[1] is None]
    assert P.with_path({"desk": 1, "n": 2}, ["desk"], ["a"], SCHEMA) == {"desk": {"filterType": "set", "values": ["a"]}, "n": 2}
    assert P.active_model({"a": 1}, {"filterType": "join"}) == {"filterType": "join"} and P.active_model(None, None) == {}


@pytest.mark.parametrize("bad", [{"desk": {"filterType": "text", "type": "like", "filter": "x"}}, {"nope": {"filterType": "text", "type": "blank"}}, {"n": {"filterType": "number", "type": "equals", "filter": "7"}}, {"n": {"filterType": "odd", "type": "equals"}}, {"day": {"filterType": "date", "type": "equals", "dateFrom": "soon"}}, {"n": {"filterType": "number", "type": "inRange"}}])
def test_errors(bad):
    with pytest.raises(P.FilterError):
        P.filter_model(bad, SCHEMA)


def test_presets():
    assert P.preset_days("today", NOW) == (dt.date(2024, 3, 15),) * 2
    assert P.preset_days("yesterday", NOW) == (dt.date(2024, 3, 14),) * 2
    assert P.preset_days("last7Days", NOW)[0] == dt.date(2024, 3, 9) and P.preset_days("last30Days", NOW)[0] == dt.date(2024, 2, 15)
    assert P.preset_days("thisMonth", dt.date(2024, 3, 1)) == (dt.date(2024, 3, 1),) * 2
    assert P.preset_days("thisYear", dt.datetime(2024, 1, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=3)))) == (dt.date(2023, 1, 1), dt.date(2023, 12, 31))


def test_pushed_to_the_scan(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = spark.read.parquet(f"{small}/orders.parquet")
    model = {"o_orderstatus": {"filterType": "set", "values": ["F", "P"]}, "o_totalprice": {"filterType": "number", "type": "greaterThan", "filter": 5}}
    model["o_orderdate"] = {"filterType": "date", "type": "inRange", "dateFrom": "1997-01-01", "dateTo": "1997-02-01"}
    plan = df.where(P.filter_model(model, {"o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime_ntz"})).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "In(o_orderstatus" in pushed and "GreaterThan(o_totalprice" in pushed and "LessThan(o_orderdate" in pushed and "o_orderpriority" not in plan
