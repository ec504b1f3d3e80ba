"""Keeping collected pages current: a throttle, and a cache of blocks that changes patch or drop."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Mapping
from concurrent.futures import Future
from dataclasses import replace
from typing import Any

from quarrygrid.model import Change, ViewRequest

#: Rows of a block, seconds between refreshes.
BLOCK, THROTTLE = 200, 0.15


class Throttle:
    """Calls f at once, then at most once in `every` seconds; calls meanwhile make one at the end of that time."""

    def __init__(self, f: Callable[[], Any], every: float = THROTTLE):
        self.f, self.every = f, every
        self.lock, self.last, self.timer = threading.Lock(), float("-inf"), None

    def __call__(self) -> None:
        with self.lock:
            wait = self.last + self.every - time.monotonic()
            if wait > 0:
                if self.timer is None:
                    self.timer = threading.Timer(wait, self._late)
                    self.timer.daemon = True
                    self.timer.start()
                return
            self.last = time.monotonic()
        self.f()

    def _late(self) -> None:
        with self.lock:
            if self.timer is None:
                return
            self.timer, self.last = None, time.monotonic()
        self.f()

    def close(self) -> None:
        """A call that still waits is not made."""
        with self.lock:
            if self.timer is not None:
                self.timer.cancel()
            self.timer = None


class Blocks:
    """Collected blocks of rows by request.  Two askers of a block share one query.

    A change that names its keys is sent only where it can show: in blocks of leaf rows whose filter, sort and
    calculated columns cannot move a row, rows are replaced in place; other blocks of the dataset are dropped, and
    so are all after a change that names none.  A block that was asked for before a change and arrives
    after it is handed to its asker but not kept.
    """

    def __init__(self, engine, size: int = BLOCK, most: int = 100):
        self.engine, self.size, self.most = engine, size, most
        self.lock, self.epoch = threading.RLock(), 0
        self.held: OrderedDict[tuple[str, int], tuple[ViewRequest, Future]] = OrderedDict()
        self.queries = 0
        self.end = engine.subscribe(self.changed)

    def get(self, request: ViewRequest | Mapping[str, Any], number: int) -> list[dict[str, Any]]:
        """The rows of block `number` of the request's view."""
        r = replace(ViewRequest.of(request), start=number * self.size, end=(number + 1) * self.size)
        mark = (replace(r, start=0, end=None).fingerprint(), number)
        with self.lock:
            if found := self.held.get(mark):
                self.held.move_to_end(mark)
            else:
                own: Future = Future()
                self.held[mark], epoch = (r, own), self.epoch
                while len(self.held) > self.most:
                    self.held.popitem(last=False)
        if found:
            return found[1].result()
        try:
            self.queries += 1
            rows = self.engine.page(r).rows
        except BaseException as e:
            with self.lock:
                self.held.pop(mark, None)
            own.set_exception(e)
            raise
        with self.lock:
            if epoch != self.epoch and self.held.get(mark, (None, None))[1] is own:
                self.held.pop(mark)
        own.set_result(rows)
        return rows

    def find(self, dataset: str, key: Any) -> dict[str, Any] | None:
        """A held leaf row by its key."""
        with self.lock:
            for r, block in self.held.values():
                name = self.engine.dataset(dataset).key
                if r.dataset == dataset and self._leaves(r) and block.done():
                    for row in block.result():
                        if row.get(name) == key:
                            return row
        return None

    @staticmethod
    def _leaves(r: ViewRequest) -> bool:
        return not (r.pivots or r.pivot_mode or r.tree or len(r.keys) < len(r.groups))

    def changed(self, change: Change) -> None:
        with self.lock:
            self.epoch += 1
            of = {mark: x for mark, x in self.held.items() if x[0].dataset == change.dataset}
            ds = self.engine.dataset(change.dataset)
            plain = lambda r: self._leaves(r) and not (r.filters or r.sort or r.quick_text or r.keep or r.groups)
            kept = {mark: x for mark, x in of.items() if change.keys is not None and ds.key and plain(x[0]) and x[1].done()}
            places = {row[ds.key]: (block.result(), k) for _, block in kept.values() for k, row in enumerate(block.result())}
            # A key that no block holds may be a new row, which moves all that come after it.
            if change.keys is not None and not set(change.keys) <= set(places):
                kept = {}
            for mark in of.keys() - kept.keys():
                self.held.pop(mark)
            if kept and change.keys:
                fresh = self.engine.page(ViewRequest(change.dataset, filters={ds.key: {"filterType": "set", "values": list(change.keys)}}, end=len(change.keys)))
                for row in fresh.rows:
                    rows, k = places[row[ds.key]]
                    rows[k] = row

    def close(self) -> None:
        self.end()
        self.held.clear()
