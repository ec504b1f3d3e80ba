"""Exact removal of repeated passages by column-wise multi-document suffix sorting.

A byte goes if a `length`-byte string over it also starts earlier (in an earlier document, or
earlier in the same one).  Strings are judged on the input; matches never cross documents.

1. Batches.  Texts are written once to the shared folder, as a table whose buckets hold whole batches
   of about `BATCH` bytes; every later step meets a batch where it lies, and no text is shuffled.
2. Anchors.  Every `length`-byte window chooses its smallest `GRAM`-byte gram by hash (a function of
   the window's bytes alone), so equal windows choose equal grams at equal offsets.  Runs of windows
   with one gram make a segment.  Each batch counts its segments by gram; only grams that the corpus
   has twice or more go on.  (Counts are by 32 bits of the gram's hash within a bucket of the others:
   a collision sends a segment more, nothing else.)
3. Collections.  The segments of a gram, aligned by it, are a collection of bounded length: windows
   at different offsets from their gram cannot be equal.  Segments of a batch that are equal byte for
   byte enter it as one document with a multiplicity, so a passage of a batch is sent once however
   often the batch has it.
4. Columns.  A collection is taken a column at a time from the right.  A round inserts one symbol of
   every document: it reads the transform (the symbol before each suffix, in suffix order), the
   order and the common prefixes that the round before wrote, sequential files all three, orders the
   suffixes by a stable pass over the transform, updates the common prefixes and writes all three
   for the next round.  Neighbours with `length` common bytes are equal windows; all but the first
   occurrence are repeated.  No repeat is decided in any other way, and bytes are compared, not hashes.
5. Batches get the repeated windows back, turn them into runs of bytes and cut their texts.

A gram with more than `MANY` contents would make one large collection.  Its windows are dealt out by a
hash of the window instead of the gram's: documents of `length` bytes, in collections that hold at
most one document a batch for each window, sorted by the same rounds.

Defined results: a null text is an empty one; texts under `length` bytes lose nothing; null doc_ids
come first, rows with equal doc_id are ordered by a hash of the text, equal rows by their place in
the written table; a text of any length is one row of its batch, searched in overlapping pieces of
`CHUNK` bytes; an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_for, saved, work_dir

GRAM = 32
#: Bytes hashed at a time; bytes and rows of a batch.
CHUNK, BATCH, ROWS = 1 << 20, 1 << 24, 1 << 18
#: Contents of a gram beyond which its windows are dealt out one by one; documents of a block of collections.
MANY, BLOCK = 50_000, 1 << 15
#: What a batch hears of a gram: nothing to look for, repeated, repeated with very many contents.
ALONE, SHARED, CROWDED = 0, 1, 2
#: Of equal segments of a batch, which occurrences of a window are repeated: the later ones, or all.
LATER, ALL = 0, 1
#: Packed columns: a document of a collection, and a run of its repeated windows.
MEMBER = [("key", "<u8"), ("entry", "<u4"), ("doc_id", "<i8"), ("hash", "<u4"), ("uid", "<i8"), ("place", "<u4"), ("size", "<u2"), ("off", "<u2"), ("many", "u1")]
HIT = [("entry", "<u4"), ("t", "<u2"), ("n", "<u2"), ("kind", "u1")]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a place within a chunk; the other bits of a gram's hash choose, in every chunk alike.
_PLACE = np.uint64(CHUNK.bit_length() - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def grams(b: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes that start at each place."""
    if len(b) < GRAM:
        return np.empty(0, np.uint64)
    w = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << 8
    w = w[:-2].astype(np.uint32) | w[2:].astype(np.uint32) << 16
    h = _mixed((w[:-4].astype(np.uint64) | w[4:].astype(np.uint64) << np.uint64(32)) * _A)
    for n in (8, 16):
        h = _mixed(h[:-n] * _A + h[n:])
    return h


def content(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of `size` bytes (GRAM at least) from each start; h: the grams' hashes."""
    out = size.astype(np.uint64) * _B
    last = start + size - GRAM
    for k in range(0, int(size.max()) if len(size) else 0, GRAM):
        more = k < size
        step = _mixed(out * _A + h[np.minimum(start + k, last)])
        out = step if more.all() else np.where(more, step, out)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def pieces(lengths: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to one string, cut to searchable pieces: text, start and end, CHUNK bytes together at most.

    Pieces of a long text overlap so that every window lies in exactly one.
    """
    ends = np.cumsum(lengths)
    some: list[tuple[int, int, int]] = []
    held = 0
    for k in np.flatnonzero(lengths >= length).tolist():
        first, last = int(ends[k] - lengths[k]), int(ends[k])
        for a in range(first, last - length + 1, CHUNK - length + 1):
            b = min(a + CHUNK, last)
            if held + b - a > CHUNK:
                yield tuple(np.array(x, np.int64) for x in zip(*some, strict=True))
                some, held = [], 0
            some.append((k, a, b))
            held += b - a
    if some:
        yield tuple(np.array(x, np.int64) for x in zip(*some, strict=True))


def segments(flat: np.ndarray, lengths: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """doc (its number), start (in flat), nw (windows), off (of the gram), key (the gram's hash) and seg (the content's) of every segment."""
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    width = length - GRAM + 1
    for doc, first, last in pieces(lengths, length):
        size = last - first
        b = np.concatenate([flat[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)])
        h = grams(b)
        # The upper bits of a hash, then the place: the smallest is the leftmost of equal grams.
        at = (sliding_min((h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64), width) & np.uint64(CHUNK - 1)).astype(np.int64)
        n = size - length + 1
        own = np.repeat(np.arange(len(size)), n)
        base = np.cumsum(size) - size
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + base[own]
        place = at[start]
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (own[1:] != own[:-1])))
        nw = np.diff(np.append(new, len(start)))
        s0, p, own = start[new], place[new], own[new]
        for x, y in zip(found, (doc[own], s0 - base[own] + first[own], nw, p - s0, h[p], content(h, s0, nw + length - 1)), strict=True):
            x.append(y)
    empty = np.empty(0, np.int64)
    out = [np.concatenate(x) if x else empty for x in found]
    return dict(zip(("doc", "start", "nw", "off", "key", "seg"), [*out[:4], *(x.astype(np.uint64) for x in out[4:])], strict=True))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


def single_windows(flat: np.ndarray, c: dict[str, np.ndarray], length: int) -> dict[str, np.ndarray]:
    """Segments as windows: each a segment of its own, whose key is the hash of the window."""
    some = {name: [] for name in c}
    for k in range(0, len(c["doc"]), 1 << 14):
        nw, start = (c[n][k : k + (1 << 14)] for n in ("nw", "start"))
        at = spread(start, nw)
        size = nw + length - 1
        h = grams(flat[spread(start, size)])
        key = content(h, spread(np.cumsum(size) - size, nw), np.full(len(at), length))
        for name, x in (("doc", np.repeat(c["doc"][k : k + (1 << 14)], nw)), ("start", at), ("nw", np.ones(len(at), np.int64)), ("off", np.zeros(len(at), np.int64)), ("key", key), ("seg", key)):
            some[name].append(x)
    return {name: np.concatenate(x) if x else c[name] for name, x in some.items()}


def entries(flat: np.ndarray, c: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments in the order of their contents; where a new content begins in it; each content's number there.

    Contents are found by their hash and held against the first byte for byte; one that only has the
    hash of another is a content of its own.
    """
    order = np.lexsort((c["start"], c["off"], c["nw"], c["seg"], c["key"]))
    o = {name: c[name][order] for name in ("key", "seg", "nw", "off", "start")}
    new = np.append(True, np.logical_or.reduce([o[n][1:] != o[n][:-1] for n in ("key", "seg", "nw", "off")]))[: len(order)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.flatnonzero(~new)
    for k in range(0, len(later), 1 << 14):
        some = later[k : k + (1 << 14)]
        size = o["nw"][some] + length - 1
        differ = flat[spread(o["start"][some], size)] != flat[spread(o["start"][first[some]], size)]
        if differ.any():
            new[some[np.logical_or.reduceat(differ, np.cumsum(size) - size)]] = True
    return order, new, np.cumsum(new) - 1


def packed(c: dict[str, np.ndarray], kinds: list[tuple[str, str]], at: np.ndarray | slice = slice(None)) -> bytes:
    return b"".join(np.ascontiguousarray(c[name][at], kind).tobytes() for name, kind in kinds)


def unpacked(data: bytes, kinds: list[tuple[str, str]], n: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind in kinds:
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(of)) if len(of) else starts


class Columns:
    """The order of suffixes, their transform and their common prefixes: sequential files of one round, read by the next.

    Files are written over and never cut short, so that no round waits for a disk.
    """

    KINDS = (("order", np.int32), ("transform", np.uint8), ("prefixes", np.uint16))

    def __init__(self, folder: str):
        self.round, self.n = 0, 0
        self.symbols = open(os.path.join(folder, "symbols"), "w+b")  # noqa: SIM115
        self.files = [[open(os.path.join(folder, f"{name}-{k}"), "w+b", buffering=0) for name, _ in self.KINDS] for k in (0, 1)]  # noqa: SIM115

    def close(self) -> None:
        for file in (self.symbols, *self.files[0], *self.files[1]):
            file.close()

    def read(self) -> list[np.ndarray]:
        out = []
        for (_, kind), file in zip(self.KINDS, self.files[self.round], strict=True):
            file.seek(0)
            out.append(np.empty(self.n, kind))
            file.readinto(out[-1])
        return out

    def write(self, *values: np.ndarray) -> None:
        self.round, self.n = 1 - self.round, len(values[0])
        for (_, kind), file, x in zip(self.KINDS, self.files[self.round], values, strict=True):
            file.seek(0)
            file.write(np.ascontiguousarray(x, kind))


def repeated_windows(flat: np.ndarray, size: np.ndarray, group: np.ndarray, off: np.ndarray, rank: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, window's number in it, and kind (LATER or ALL) of every repeated window of the collections.

    flat: the documents' bytes one after another; size: of each; group: its collection, in ascending
    order; off: the gram's offset in it; rank: the order of first occurrences; many: is there more than one.
    """
    edges = np.append(_runs(group)[0], len(group))
    found = [(np.empty(0, np.int64),) * 3]
    base = np.cumsum(size) - size
    at = 0
    with tempfile.TemporaryDirectory() as folder, contextlib.closing(Columns(folder)) as state:
        while at < len(edges) - 1:
            # Whole collections, BLOCK documents together unless one has more.
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK, "right")) - 1)
            a, b = int(edges[at]), int(edges[to])
            own = slice(a, b)
            for d, t, kind in _block(flat[base[a] : base[b - 1] + size[b - 1]], size[own], group[own], off[own], rank[own], many[own], length, state):
                found.append((d + a, t, kind))
            at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block(flat: np.ndarray, size: np.ndarray, group: np.ndarray, off: np.ndarray, rank: np.ndarray, many: np.ndarray, length: int, state: Columns) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    low = -off.astype(np.int64)
    high = low + size
    base = np.cumsum(size) - size - low
    starts, ends = _runs(group)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    group = group.astype(np.uint16) if len(starts) <= 1 << 16 else group
    first, last = int(low.min()), int(high.max())
    # Symbols by column, from the right, in the order of the documents: read once, in sequence.
    by_end = np.argsort(-high, kind="stable")
    entering = np.searchsorted(-high[by_end], np.arange(-last, -first + 1), "right")
    symbols = state.symbols
    symbols.seek(0)
    for column in range(last - 1, first - 1, -1):
        at = np.flatnonzero((low <= column) & (column < high))
        symbols.write(flat[base[at] + column].tobytes())
    symbols.seek(0)
    state.write(np.empty(0), np.empty(0), np.empty(0))
    held = np.zeros(len(size), np.uint8)
    inside = np.flatnonzero((low < last) & (last - 1 < high))
    held[inside] = np.frombuffer(symbols.read(len(inside)), np.uint8)
    for column in range(last - 1, first - 1, -1):
        order, transform, lcp = state.read()
        order, lcp = order.astype(np.int64), lcp.astype(np.int64)
        # Documents whose last symbol this is: their empty suffixes stand before all others of the collection.
        k = last - 1 - column
        if len(come := np.sort(by_end[entering[k - 1] if k else 0 : entering[k]])):
            both = np.concatenate([come, order])
            by = np.argsort(group[both], kind="stable")
            order, transform, lcp = both[by], np.concatenate([held[come], transform])[by], np.concatenate([np.zeros(len(come), np.int64), lcp])[by]
            fresh = by < len(come)
            lcp[fresh] = 0
            lcp[1:][fresh[:-1]] = 0
            lcp[np.append(True, group[order[1:]] != group[order[:-1]])] = 0
        # The round: suffixes in the order of their new first symbol, ties as they were.
        by = np.argsort(transform, kind="stable")
        by = by[np.argsort(group[order[by]], kind="stable")]
        p, q = by[:-1], by[1:]
        same = (group[order[p]] == group[order[q]]) & (transform[p] == transform[q])
        shared = np.zeros(len(order), np.int64)
        if same.any():
            pairs = np.column_stack([p[same] + 1, q[same] + 1]).ravel()
            shared[1:][same] = 1 + np.minimum.reduceat(np.append(lcp, 0), pairs)[::2]
        order, lcp = order[by], np.minimum(shared, length)
        # Equal windows that begin in this column.
        whole = high[order] - column >= length
        if whole.any():
            equal = lcp >= length
            run = np.cumsum(~equal) - 1
            heads = np.flatnonzero(~equal)
            several = (np.diff(np.append(heads, len(order))) > 1)[run] & whole
            least = np.minimum.reduceat(rank[order], heads)[run] == rank[order]
            hit = several & ~least | whole & least & (many[order] > 0)
            if hit.any():
                d = order[hit]
                yield d, column - low[d], np.where(least[hit], LATER, ALL)
        # The transform of the next column.  A document goes when it has no symbol left, or when no window
        # of it can reach `length` bytes in common any more; what closes ranks shares the least of what lay between.
        inside = np.flatnonzero((low < column) & (column - 1 < high))
        held[inside] = np.frombuffer(symbols.read(len(inside)), np.uint8)
        most = np.maximum(lcp, np.append(lcp[1:], 0)) if len(lcp) else lcp
        stay = (low[order] < column) & ((many[order] > 0) | (most + column - low[order] >= length))
        if not stay.all():
            keep = np.flatnonzero(stay)
            lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.append(0, keep[:-1] + 1)) if len(keep) else lcp[:0]
            order = order[keep]
        state.write(order, held[order], lcp)


def census(c: dict[str, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each gram's bucket and 32 bits of its hash (in order), and the gram of each segment."""
    bucket = (c["key"] * _A >> np.uint64(32)) % np.uint64(buckets)
    found, of = np.unique(bucket << np.uint64(32) | c["key"] & np.uint64(0xFFFFFFFF), return_inverse=True)
    return (found >> np.uint64(32)).astype(np.int64), found.astype(np.uint32), of.ravel()


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class Batch:
    """The texts of a batch in document order, and their segments."""

    def __init__(self, table, length: int):
        import xxhash

        raw = [(t or "").encode() for t in table.column("text").to_pylist()]
        ids = [(-(1 << 63) if d is None else d) for d in table.column("doc_id").to_pylist()]
        uids = table.column("uid").to_pylist()
        hashes = [xxhash.xxh32_intdigest(t) for t in raw]
        self.order = sorted(range(len(raw)), key=lambda k: (ids[k], hashes[k], uids[k]))
        self.raw = [raw[k] for k in self.order]
        self.names = {name: np.array([x[k] for k in self.order], kind) for name, x, kind in (("doc_id", ids, np.int64), ("hash", hashes, np.uint32), ("uid", uids, np.int64))}
        self.lengths = np.array([len(t) for t in self.raw], np.int64)
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.segments = segments(self.flat, self.lengths, length)
        self.length = length

    def documents(self, heard, buckets: int) -> list[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """Shared segments, and the windows of crowded grams, each with entries(); heard: bucket and data of the codes."""
        bucket, _, of = census(self.segments, buckets)
        code = np.zeros(len(bucket), np.uint8)
        starts, ends = _runs(bucket)
        at = {int(bucket[a]): slice(a, b) for a, b in zip(starts, ends, strict=True)}
        for k, data in heard:
            code[at[k]] = np.frombuffer(_unzip(data), np.uint8)
        code = code[of]
        some = lambda x: {name: v[code == x] for name, v in self.segments.items()}
        out = []
        for c in (some(SHARED), single_windows(self.flat, some(CROWDED), self.length)):
            out.append((c, *entries(self.flat, c, self.length)))
        return out


def _counted(table, length: int, buckets: int):
    """Of a batch: bucket, batch and data (the grams' 32 bits, their contents and whether they come again)."""
    import pyarrow as pa

    c = Batch(table, length).segments
    bucket, low, of = census(c, buckets)
    order = np.lexsort((c["seg"], of))
    a, b = of[order], c["seg"][order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]
    contents = np.minimum(np.bincount(a[new], minlength=len(low)), (1 << 15) - 1)
    count = (2 * contents + (np.bincount(of, minlength=len(low)) > 1)).astype("<u2")
    starts, ends = _runs(bucket)
    data = [_zip(low[s:e].astype("<u4").tobytes() + count[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
    return pa.table({"bucket": pa.array(bucket[starts], pa.int64()), "batch": pa.array([table.column("batch")[0].as_py()] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})


def _told(table):
    """Of a bucket: what each batch hears of its grams, one code a gram."""
    import pyarrow as pa

    batches, low, count = table.column("batch").to_pylist(), [], []
    for x in table.column("data"):
        data = _unzip(x.as_py())
        n = len(data) // 6
        low.append(np.frombuffer(data, "<u4", n))
        count.append(np.frombuffer(data, "<u2", n, 4 * n))
    of = np.unique(np.concatenate(low), return_inverse=True)[1].ravel()
    counts = np.concatenate(count)
    again = np.bincount(of) + np.bincount(of, counts & 1) > 1
    code = (again * SHARED + (np.bincount(of, counts >> 1) > MANY) * (CROWDED - SHARED) * again).astype(np.uint8)[of]
    parts = np.split(code, np.cumsum([len(x) for x in low])[:-1])
    return pa.table({"batch": pa.array(batches, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(batches), pa.int64()), "data": pa.array([_zip(x.tobytes()) for x in parts], pa.binary())})


def _members(table, heard, length: int, buckets: int, parts: int):
    """Of a batch: part, batch, n and data, the documents of collections."""
    import pyarrow as pa

    own, out, before = Batch(table, length), [], 0
    for c, order, new, number in own.documents(zip(heard.column("bucket").to_pylist(), heard.column("data").to_pylist(), strict=True), buckets):
        first = order[new]
        doc, start = c["doc"][first], c["start"][first]
        m = {"key": c["key"][first], "entry": np.arange(before, before + len(first)), "place": start - own.first[doc] + c["off"][first], "size": c["nw"][first] + length - 1, "off": c["off"][first], "many": np.bincount(number, minlength=len(first)) > 1}
        m |= {name: x[doc] for name, x in own.names.items()}
        before += len(first)
        part = ((m["key"] * _B >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        for a, b in zip(*_runs(part[by]), strict=True):
            at = by[a:b]
            data = packed(m, MEMBER, at) + own.flat[spread(start[at], m["size"][at])].tobytes()
            out.append((int(part[at[0]]), len(at), _zip(data)))
    columns = list(zip(*out, strict=True)) if out else [[]] * 3
    return pa.table({"part": pa.array(columns[0], pa.int64()), "batch": pa.array([table.column("batch")[0].as_py()] * len(out), pa.int64()), "n": pa.array(columns[1], pa.int64()), "data": pa.array(columns[2], pa.binary())})


def _found(table, length: int):
    """Of a part: batch, n and data, the runs of repeated windows that each batch is told."""
    import pyarrow as pa

    width = sum(np.dtype(kind).itemsize for _, kind in MEMBER)
    batches, some, texts = table.column("batch").to_numpy(), [], []
    for n, x in zip(table.column("n").to_pylist(), table.column("data"), strict=True):
        data = _unzip(x.as_py())
        some.append(unpacked(data, MEMBER, n))
        texts.append(np.frombuffer(data, np.uint8, len(data) - n * width, n * width))
    m = {name: np.concatenate([x[name] for x in some]) for name, _ in MEMBER}
    batch = np.repeat(batches, [len(x["key"]) for x in some])
    order = np.argsort(m["key"], kind="stable")
    size = m["size"].astype(np.int64)
    flat = np.concatenate(texts)[spread((np.cumsum(size) - size)[order], size[order])]
    del texts, some
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((m["place"], m["uid"], m["hash"], m["doc_id"]))] = np.arange(len(order))
    d, t, kind = repeated_windows(flat, size[order], m["key"][order], m["off"][order], rank[order], m["many"][order], length)
    by = np.lexsort((t, kind, d))
    d, t, kind = d[by], t[by], kind[by]
    new = np.append(True, (d[1:] != d[:-1]) | (kind[1:] != kind[:-1]) | (t[1:] != t[:-1] + 1))[: len(d)]
    starts = np.flatnonzero(new)
    own = order[d[starts]]
    c = {"entry": m["entry"][own], "t": t[starts], "n": np.diff(np.append(starts, len(d))), "kind": kind[starts]}
    by = np.argsort(batch[own], kind="stable")
    out = [(int(batch[own[by[a]]]), b - a, _zip(packed(c, HIT, by[a:b]))) for a, b in zip(*_runs(batch[own][by]), strict=True)]
    columns = list(zip(*out, strict=True)) if out else [[]] * 3
    return pa.table({"batch": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()), "data": pa.array(columns[2], pa.binary())})


def covered(s0: np.ndarray, nw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal removed runs, from runs of repeated windows."""
    order = np.argsort(s0, kind="stable")
    a, b = s0[order], (s0 + nw + length - 1)[order]
    if not len(a):
        return a, b
    reach = np.maximum.accumulate(b)
    new = np.append(True, a[1:] > reach[:-1])
    return a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def cut(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    """raw without the spans."""
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))


def _spans(table, heard, length: int, buckets: int) -> tuple[list[bytes], list[list[int]], list[list[int]]]:
    """Of a batch: text, starts and ends of the removed runs of each of its rows, in the order of the table."""
    own = Batch(table, length)
    codes, hits = [], []
    for bucket, n, data in zip(*(heard.column(x).to_pylist() for x in ("bucket", "n", "data")), strict=True):
        if bucket is None:
            hits.append(unpacked(_unzip(data), HIT, n))
        else:
            codes.append((bucket, data))
    h = {name: np.concatenate([np.empty(0, np.int64), *(x[name] for x in hits)]).astype(np.int64) for name, _ in HIT}
    doc, start, nw, before = [], [], [], 0
    for c, order, new, number in own.documents(codes, buckets):
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(order)))
        some = np.flatnonzero((h["entry"] >= before) & (h["entry"] < before + len(heads)))
        entry = h["entry"][some] - before
        later = (h["kind"][some] == LATER).astype(np.int64)
        times = n[entry] - later
        at = order[spread(heads[entry] + later, times)]
        doc.append(c["doc"][at])
        start.append(c["start"][at] - own.first[c["doc"][at]] + np.repeat(h["t"][some], times))
        nw.append(np.repeat(h["n"][some], times))
        before += len(heads)
    doc, start, nw = (np.concatenate(x) for x in (doc, start, nw))
    by = np.argsort(doc, kind="stable")
    raw, starts, ends = ([None] * len(own.raw) for _ in range(3))
    edges = np.searchsorted(doc[by], np.arange(len(own.raw) + 1))
    for k, place in enumerate(own.order):
        some = by[edges[k] : edges[k + 1]]
        a, b = covered(start[some], nw[some], length)
        raw[place], starts[place], ends[place] = own.raw[k], a.tolist(), b.tolist()
    return raw, starts, ends


def batches(docs: DataFrame, rest: list[str]) -> tuple[DataFrame, int]:
    """docs as a written table whose buckets hold whole batches: batch, uid, doc_id, text and rest (a struct of these columns).

    Batches are made where the rows are read, so no text is shuffled.  Returned with the number of parts
    that later steps are dealt to.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col("`text`")))).first()[0] or 0
    parts = max(parts_for(4 * total, BATCH), int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))

    def number(rows_: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        batch, held, at = TaskContext.get().partitionId() << 24, 0, 0

        def some_rows(x, first: int, last: int):
            uid = np.arange(at - (last - first), at) + (batch << 18)
            return pa.RecordBatch.from_arrays([pa.array(np.full(last - first, batch)), pa.array(uid), *x.slice(first, last - first).columns], ["batch", "uid", *x.schema.names])

        for x in rows_:
            first = 0
            for k, n in enumerate(pc.fill_null(pc.binary_length(x.column("text")), 0).to_pylist()):
                if at and (held + n > BATCH or at == ROWS):
                    if k > first:
                        yield some_rows(x, first, k)
                    batch, held, at, first = batch + 1, 0, 0, k
                held, at = held + n, at + 1
            if x.num_rows > first:
                yield some_rows(x, first, x.num_rows)

    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("uid", T.LongType()), *own.schema.fields])
    name, path = f"quarrygrid_batches_{uuid.uuid4().hex}", work_dir(spark, "batches")
    own.mapInArrow(number, schema).write.bucketBy(parts, "batch").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name).select("batch", "uid", "doc_id", "text", *(["rest"] if rest else []))
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, as those of any work table
    return out, parts


def cleaned(docs: DataFrame, rest: list[str], length: int, make, schema: T.StructType) -> DataFrame:
    """What make(table, texts, starts, ends) returns for every batch: its rows, their texts' bytes and the runs that go."""
    table, parts = batches(docs, rest)
    texts = table.select("batch", "uid", "doc_id", "text")
    codes = texts.groupBy("batch").applyInArrow(lambda t: _counted(t, length, parts), "bucket long, batch long, data binary").groupBy("bucket").applyInArrow(_told, "batch long, bucket long, data binary")
    codes = saved(codes, "gram-codes")
    members = texts.groupBy("batch").cogroup(codes.groupBy("batch")).applyInArrow(lambda t, heard: _members(t, heard, length, parts, parts), "part long, batch long, n long, data binary")
    hits = members.groupBy("part").applyInArrow(lambda t: _found(t, length), "batch long, n long, data binary")
    heard = codes.select("batch", "bucket", F.lit(None).cast("long").alias("n"), "data").unionByName(hits.select("batch", F.lit(None).cast("long").alias("bucket"), "n", "data"))
    return table.groupBy("batch").cogroup(heard.groupBy("batch")).applyInArrow(lambda t, h: make(t, *_spans(t, h, length, parts)), schema)


def digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of every row of docs (doc_id, text)."""

    def make(table, raw, starts, ends):
        import pyarrow as pa

        kept = [cut(r, a, b) for r, a, b in zip(raw, starts, ends, strict=True)]
        columns = {
            "doc_id": table.column("doc_id"),
            "n_bytes": pa.array(map(len, raw), pa.int64()),
            "n_removed": pa.array((len(r) - len(k) for r, k in zip(raw, kept, strict=True)), pa.int64()),
            "n_spans": pa.array(map(len, starts), pa.int64()),
            "kept_sha256": pa.array(hashlib.sha256(k).hexdigest() for k in kept),
            "starts": pa.array(starts, pa.list_(pa.int64())),
            "ends": pa.array(ends, pa.list_(pa.int64())),
        }
        return pa.table(columns)

    return cleaned(docs, [], length, make, T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"))


def deduplicated(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of docs with the kept text; of a character cut by a span's edge the other bytes go too."""
    rest = [c for c in docs.columns if c != "text"]

    def make(table, raw, starts, ends):
        import pyarrow as pa

        texts = [t if not a else cut(r, a, b).decode(errors="ignore") for t, r, a, b in zip(table.column("text").to_pylist(), raw, starts, ends, strict=True)]
        return pa.table({"rest": table.column("rest"), "text": pa.array(texts, pa.string())})

    schema = T.StructType([T.StructField("rest", docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")).schema["rest"].dataType), T.StructField("text", T.StringType())])
    out = cleaned(docs, rest, length, make, schema)
    return out.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
