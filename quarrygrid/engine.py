"""The service: datasets by name, and every operation on them.

Operations return lazy frames; pages and matrices are collected only when read.  Changes make a new
version of a dataset.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarrygrid import schema as S
from quarrygrid.model import Change, Dataset, Page, RequestError, Transaction, ViewRequest
from quarrygrid.operators import mutations
from quarrygrid.operators.predicates import PRESETS
from quarrygrid.plans import services, views
from quarrygrid.sources import ingest, sinks
from quarrygrid.streaming import refresh

#: Fixed value: aggregate results that are remembered.
CACHED = 8


class Engine:
    """now: a fixed time for date presets (else the clock).

    Changed rows wait on the driver, `most_pending` of them at most, and are joined with the snapshot where
    it is read; beyond that, and after `compact` changes given as frames, the dataset is written to the folder in
    spark.checkpoint.dir and read back, so that no plan grows with the number of changes.
    """

    def __init__(self, spark: SparkSession, now=None, compact: int = 4, most_pending: int = 10_000):
        self.spark, self.now, self.compact, self.most_pending = spark, now, compact, most_pending
        self.stored: dict[str, tuple[DataFrame, mutations.Pending, int]] = {}
        self.datasets: dict[str, Dataset] = {}
        self.cache: OrderedDict[str, Any] = OrderedDict()
        self.listeners: list[Callable[[Change], None]] = []

    # --- datasets ---

    def configure(self, name: str, schema: Mapping[str, str], key: str | None = "id", calc: Mapping[str, str] | None = None, tree: Sequence[str] = (), weight: str | None = "quantity", default_measures: Sequence[str] = ()) -> int:
        """A new, empty dataset; one of that name is replaced, its schema too."""
        kinds = {**schema, **({key: "string"} if key and key not in schema else {})}
        if bad := sorted(set(kinds.values()) - set(S.SPARK_TYPES)):
            raise RequestError(f"no column type {', '.join(bad)}")
        version = self.datasets[name].version + 1 if name in self.datasets else 0
        self.stored.pop(name, None)
        self.datasets[name] = Dataset(name, ingest.empty(self.spark, kinds), kinds, key, dict(calc or {}), list(tree), weight, tuple(default_measures), version)
        self.cache.clear()
        return 0

    def configure_columns(self, name: str, definitions: Iterable[Mapping], key: str, sample: Mapping[str, Any] | None = None, **options) -> int:
        schema, calc = S.derive(definitions, key, sample)
        return self.configure(name, schema, key, calc, **options)

    def dataset(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise RequestError(f"no dataset {name!r}")
        ds = self.datasets[name]
        if ds.frame is None:
            snapshot, pending, _ = self.stored[name]
            ds.frame = pending.over(snapshot)
        return ds

    def load(self, name: str, rows: DataFrame | Sequence[Mapping[str, Any]], order: str | None = None, unique: bool = False) -> Dataset:
        """Replaces the rows.  Equal keys collapse to the last row, unless the caller knows keys to be unique."""
        ds = self.datasets.get(name)
        if isinstance(rows, DataFrame):
            if ds is None:
                self.configure(name, S.of_frame(rows), None)
                ds = self.datasets[name]
            frame = S.project(rows, ds.schema, ds.key)
            if ds.key and not unique:
                frame = mutations.collapsed(frame, ds.key, order)
        else:
            ds = self.dataset(name)
            frame = ingest.from_rows(self.spark, [], ds.schema, ds.key)
            frame = mutations.upserted(frame, mutations.patch_frame(self.spark, rows, ds.schema, ds.key), ds.key) if ds.key else ingest.from_rows(self.spark, rows, ds.schema, None)
        return self._changed(ds, frame)

    def _changed(self, ds: Dataset, frame: DataFrame | None, keys: Sequence[Any] | None = None) -> Dataset:
        """A new version.  keys: the rows that changed, where a view can be patched; None asks for a full refresh.

        frame: the rows; None: the snapshot with what is pending.
        """
        new = replace(ds, frame=frame, version=ds.version + 1, rows=None)
        snapshot, pending, frames = self.stored.get(ds.name, (None, None, 0))
        if frame is not None:
            frames += 1
            if self.compact and frames >= self.compact:
                new.frame, frames = self._written(ds.name, frame), 0
            self.stored[ds.name] = (new.frame, mutations.Pending(ds.schema, ds.key), frames)
        elif len(pending) > self.most_pending:
            new.frame = self._written(ds.name, pending.over(snapshot))
            self.stored[ds.name] = (new.frame, mutations.Pending(ds.schema, ds.key), 0)
        self.datasets[ds.name] = new
        self.cache.clear()
        for listener in list(self.listeners):
            listener(Change(ds.name, new.version, None if keys is None else list(keys)))
        return self.dataset(ds.name) if frame is not None else new

    def _written(self, name: str, frame: DataFrame) -> DataFrame:
        """The frame in the shared folder; as it is where there is none to write to."""
        if not (folder := self.spark.conf.get("spark.checkpoint.dir", None)):
            return frame
        path = f"{folder.rstrip('/')}/dataset-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _pending(self, ds: Dataset) -> mutations.Pending | None:
        """Where changed rows of the dataset wait; None if its keys are of a type that cannot."""
        if ds.schema.get(ds.key, "string") not in mutations.Pending.KEYS:
            return None
        if ds.name not in self.stored:
            self.stored[ds.name] = (ds.frame, mutations.Pending(ds.schema, ds.key), 0)
        return self.stored[ds.name][1]

    def register_view(self, name: str, view: str | None = None) -> None:
        """The dataset, calculated columns and all, as a temporary view for SQL."""
        self.dataset(name).base.createOrReplaceTempView(view or name)

    def size(self, name: str) -> int:
        """Rows of the dataset; counted once a version."""
        ds = self.dataset(name)
        if ds.rows is None:
            ds.rows = ds.frame.count()
        return ds.rows

    def clear(self, name: str) -> None:
        ds = self.dataset(name)
        self._changed(ds, ingest.empty(self.spark, ds.schema))

    def close(self) -> None:
        self.datasets.clear()
        self.stored.clear()
        self.cache.clear()
        self.listeners.clear()

    # --- changes ---

    def upsert(self, name: str, rows: Sequence[Mapping[str, Any]] | DataFrame, order: str | None = None) -> Dataset:
        """order: of rows given as a frame, the column by which the last of equal keys wins; it is not kept."""
        ds = self._known(name)
        if not ds.key:
            ds = self.dataset(name)
            more = rows if isinstance(rows, DataFrame) else ingest.from_rows(self.spark, rows, ds.schema, None)
            return self._changed(ds, ds.frame.unionByName(S.project(more, ds.schema, None), allowMissingColumns=True))
        if isinstance(rows, DataFrame):
            return self._changed(ds, mutations.upserted(self.dataset(name).frame, mutations.as_patches(rows, order), ds.key))
        return self.apply(name, {"update": rows})

    def remove(self, name: str, ids: Sequence[Any] | DataFrame) -> Dataset:
        ds = self._known(name)
        if isinstance(ids, DataFrame):
            return self._changed(ds, mutations.removed(self.dataset(name).frame, ids, self._key(ds)))
        return self.apply(name, {"remove": ids}) if ids else self.dataset(name)

    def apply(self, name: str, tx: Transaction | Mapping[str, Any]) -> Dataset:
        ds, tx = self._known(name), Transaction.of(tx)
        keys, full = mutations.changed_keys(tx, self._key(ds))
        if (pending := self._pending(ds)) is None:
            return self._changed(ds, mutations.apply_transaction(self.dataset(name).frame, tx, ds.schema, ds.key), None if full else keys)
        pending.remove(tx.remove)
        pending.upsert([*tx.add, *tx.update])
        return self._changed(ds, None, None if full else keys)

    def _known(self, name: str) -> Dataset:
        """The dataset as it is, whether or not its rows are put together."""
        return self.datasets[name] if name in self.datasets else self.dataset(name)

    def apply_all(self, name: str, transactions: Sequence[Transaction | Mapping[str, Any]]) -> Dataset:
        """A burst of transactions, in order, in as few steps as that allows."""
        for tx in mutations.coalesced(transactions, self._key(self._known(name))):
            self.apply(name, tx)
        return self.dataset(name)

    def edit(self, name: str, key: Any, field: str, value: Any) -> Dataset:
        """One cell; the value is coerced to the column's type."""
        ds = self._known(name)
        return self.upsert(name, [{self._key(ds): key, field: S.coerced(value, ds.schema.get(field))}])

    @staticmethod
    def _key(ds: Dataset) -> str:
        if not ds.key:
            raise RequestError(f"{ds.name} has no key")
        return ds.key

    def subscribe(self, listener: Callable[[Change], None]) -> Callable[[], None]:
        """Calls listener after every change; returns what ends that."""
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener) if listener in self.listeners else None

    def watch(self, request: ViewRequest | Mapping[str, Any], use: Callable[[Page], None], every: float = 0.0) -> Callable[[], None]:
        """Hands a fresh page of the request to `use`, now and after changes of its dataset; returns what ends that.

        every: seconds that pass at least between two pages; changes meanwhile make one page at the end.
        """
        r = ViewRequest.of(request)
        renew = refresh.Throttle(lambda: use(self.page(r)), every)
        renew()
        end = self.subscribe(lambda change: renew() if change.dataset == r.dataset else None)
        return lambda: (end(), renew.close())[0]

    def blocks(self, size: int = refresh.BLOCK) -> refresh.Blocks:
        """A cache of collected blocks of rows over this engine, kept current by its changes."""
        return refresh.Blocks(self, size)

    def is_current(self, page: Page) -> bool:
        """Whether the page is of the newest version of its dataset; an outdated one is to be dropped."""
        ds = self.datasets.get(page.request.dataset)
        return ds is not None and ds.version == page.version

    # --- queries ---

    def page(self, request: ViewRequest | Mapping[str, Any]) -> Page:
        r = ViewRequest.of(request)
        return views.compile_view(self.dataset(r.dataset), r, self.now)

    def view(self, request: ViewRequest | Mapping[str, Any]) -> DataFrame:
        """The window of the request."""
        return self.page(request).frame

    def rows(self, request: ViewRequest | Mapping[str, Any], with_aggregates: bool = True) -> dict[str, Any]:
        """A collected page: rowData, rowCount, pivotResultFields, and the aggregates of the filtered set."""
        page = self.page(request)
        out = {"rowData": page.rows, "rowCount": page.row_count, "pivotResultFields": page.pivot_fields}
        if with_aggregates:
            matrix = self.aggregate_matrix(replace(page.request, groups=(), keys=()))
            out |= {"totals": matrix["totals"], "aggregates": matrix["aggregates"], "filteredRowCount": matrix["rowCount"]}
        return out

    def levels(self, request: ViewRequest | Mapping[str, Any]) -> DataFrame:
        r = ViewRequest.of(request)
        return views.all_levels(self.dataset(r.dataset), r, self.now)

    def aggregates(self, request: ViewRequest | Mapping[str, Any]) -> DataFrame:
        r = ViewRequest.of(request)
        return services.aggregates(self.dataset(r.dataset), r, self.now)

    def aggregate_matrix(self, request: ViewRequest | Mapping[str, Any]) -> dict[str, Any]:
        """Collected aggregates; a few results are remembered until a dataset changes or a preset's day may."""
        r = ViewRequest.of(request)
        ds = self.dataset(r.dataset)
        if self.now is None and any(p in str(r.filters) for p in PRESETS):
            return services.aggregate_matrix(ds, r, self.now)
        mark = replace(r, sort=(), start=0, end=None).fingerprint(ds.version)
        if mark not in self.cache:
            self.cache[mark] = services.aggregate_matrix(ds, r, self.now)
            while len(self.cache) > CACHED:
                self.cache.popitem(last=False)
        return self.cache[mark]

    def grand_total(self, request: ViewRequest | Mapping[str, Any]) -> DataFrame:
        """One row: the request's own measures over the filtered set."""
        r = ViewRequest.of(request)
        ds = self.dataset(r.dataset)
        return views.filtered(ds, r, self.now, r.groups).agg(*views.measures(ds, r.measures, empty_sum=True))

    def counts(self, request: ViewRequest | Mapping[str, Any]) -> DataFrame:
        r = ViewRequest.of(request)
        return services.counts(self.dataset(r.dataset), r, self.now)

    def count_matching(self, name: str, filters: Mapping[str, Any]) -> int:
        return views.filtered(self.dataset(name), ViewRequest(name, filters=filters), self.now).count()

    def series(self, category: str, request: ViewRequest | Mapping[str, Any], limit: int | None = services.SERIES_LIMIT) -> DataFrame:
        r = ViewRequest.of(request)
        return services.series(self.dataset(r.dataset), category, r, self.now, limit)

    def distinct_values(self, name: str, field: str) -> DataFrame:
        return services.distinct_values(self.dataset(name), field)

    def detail(self, name: str, match: Mapping[str, Any], limit: int | None = services.DETAIL_LIMIT) -> DataFrame:
        return services.detail(self.dataset(name), match, limit)

    def details_of(self, master: DataFrame, name: str, fields: Mapping[str, str], limit: int = services.DETAIL_LIMIT) -> DataFrame:
        return services.details_of(master, self.dataset(name), fields, limit)

    def query_all(self, request: ViewRequest | Mapping[str, Any], structure: bool | None = None, limit: int | None = services.QUERY_LIMIT) -> DataFrame:
        structure = bool(request.get("includeStructure")) if structure is None and isinstance(request, Mapping) else bool(structure)
        if isinstance(request, Mapping) and "limit" in request:
            limit = request["limit"]
        r = ViewRequest.of(request)
        return services.query_all(self.dataset(r.dataset), r, self.now, structure, limit)[0]

    def group_leaf_rows(self, request: ViewRequest | Mapping[str, Any]) -> DataFrame:
        r = ViewRequest.of(request)
        return services.group_leaf_rows(self.dataset(r.dataset), r, self.now)

    def export(self, request: ViewRequest | Mapping[str, Any], path: str, format: str = "csv", columns=None, limit: int | None = services.EXPORT_LIMIT, structure: bool = False, **options) -> None:
        sinks.write(self.query_all(request, structure, limit), path, format, columns, **options)

    # --- messages ---

    def handle(self, message: Mapping[str, Any]) -> dict[str, Any]:
        """One message of the request/response protocol; an error is a reply, never an exception."""
        kind, ident = message.get("type"), message.get("requestId")
        try:
            return {"type": f"{kind}Result", "requestId": ident, "ok": True, **self._handle(kind, message)}
        except Exception as e:  # noqa: BLE001
            return {"type": f"{kind}Result", "requestId": ident, "ok": False, "error": str(e) or type(e).__name__}

    def _handle(self, kind: str | None, m: Mapping[str, Any]) -> dict[str, Any]:
        request, name = m.get("request") or {}, m.get("dataset") or (m.get("request") or {}).get("dataset", "main")
        collected = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        if kind == "configure":
            c = m["config"]
            self.configure(c["dataset"], c["schema"], c["index"], c.get("calcExpressions"), c.get("treeFields") or ())
            return {"rowCount": 0}
        if kind == "setRowData":
            self.load(name, m["rows"])
            return {"rowCount": self.size(name)}
        if kind == "getRows":
            return {"result": self.rows(request)}
        if kind == "getFilterValues":
            return {"values": [r.value for r in self.distinct_values(name, m["field"]).collect()]}
        if kind in ("updateRows", "removeRows", "applyTransaction"):
            if kind == "updateRows":
                self.upsert(name, m["rows"])
            elif kind == "removeRows":
                self.remove(name, m["ids"])
            else:
                self.apply(name, request)
            return {"rowCount": self.size(name)}
        if kind == "getAggregates":
            return {"result": self.aggregate_matrix(request)}
        if kind == "queryAll":
            page = services.query_all(self.dataset(name), ViewRequest.of(request), self.now, bool(request.get("includeStructure")), request.get("limit", services.QUERY_LIMIT))
            return {"result": {"rowData": collected(page[0]), "rowCount": page[1].count()}}
        if kind == "getSeriesData":
            rows = collected(self.series(request["categoryField"], request, request.get("limit", services.SERIES_LIMIT)))
            return {"result": {"rowData": rows, "rowCount": len(rows)}}
        if kind == "getDetailRows":
            rows = collected(self.detail(name, request["match"], request.get("limit", services.DETAIL_LIMIT)))
            return {"result": {"rowData": rows, "rowCount": len(rows)}}
        if kind == "dispose":
            self.close()
            return {}
        raise RequestError(f"no operation {kind!r}")
