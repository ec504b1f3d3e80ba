"""Embedding near-duplicates by an epsilon grid order join.

Vectors of one label are near if their cosine reaches the threshold; for unit vectors that is an
Euclidean distance of at most eps = sqrt(2 - 2 * threshold).  They are turned to their principal
dimensions (from the covariance of all vectors), cut into grid cells of side eps along the leading
ones, and sorted by cell, lexicographically: the epsilon grid order.  The sorted sequence is cut
into intervals of bounded length.  Two intervals whose boxes lie further apart than eps, summed over
the leading dimensions, are skipped; the others are joined recursively, halving the longer one and
skipping again, until what is left is small enough to compare vector by vector, in double precision.

An interval meets every later one near it in one task a pair, which holds two intervals and no more.
Equal vectors take part once, with their number.  A pair of intervals gives back one row for
each vector (how many links it found) and a spanning forest of its links, never the links
themselves; `components` connects the forests.

Defined results: vectors that are null, empty or zero, that hold null or non-finite components, or
have a null label link with nothing, and so do vectors of different length; rows with equal vec_id
are vectors of their own, with the smallest vec_id of their component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import renamed, saved
from .components import components, forest

#: Slack of the skipping test, for the rounding of distances.
SLACK = 1e-6
#: Partial sums of the covariance that are left for the last level, and numbers in a piece of one.
TREE, PIECE = 64, 1 << 16
#: A grid cell is no narrower, so that a unit vector's coordinate has a bounded number of cells.
LEAST_SIDE = 0.05


def _matrix(column) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def axes(vectors: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """For each length of vectors, the leading principal axes of all unit vectors of that length."""

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes).tolist():
                x = _matrix(batch.column("v").filter(pa.array(sizes == d)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                n, s, c = sums.get(d, (0, 0.0, 0.0))
                sums[d] = n + len(x), s + x.sum(axis=0), c + x.T @ x
        part = TaskContext.get().partitionId() % TREE
        for d, (n, s, c) in sums.items():
            flat = np.concatenate([c.ravel(), s, [float(n)]])
            for k in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_pydict({"d": [d], "piece": [k // PIECE], "part": [part], "x": [flat[k : k + PIECE].tolist()]})

    def added(table):
        import pyarrow as pa

        x = sum(np.array(row.values) for row in table.column("x"))
        return pa.table({"d": table.column("d")[:1], "piece": table.column("piece")[:1], "part": table.column("part")[:1], "x": [x.tolist()]})

    # Sums meet piece by piece in two levels, TREE of them in the second; one matrix a length reaches the driver.
    kind = "d long, piece long, part long, x array<double>"
    sums = vectors.select("v", "d").mapInArrow(moments, kind).groupBy("d", "piece", "part").applyInArrow(added, kind)
    sums = sums.withColumn("part", F.lit(0).cast("long")).groupBy("d", "piece", "part").applyInArrow(added, kind)
    total: dict[int, list] = {}
    for r in sorted(sums.collect(), key=lambda r: (r.d, r.piece)):
        total.setdefault(r.d, []).append(np.array(r.x))
    out = {}
    for d, pieces in total.items():
        flat = np.concatenate(pieces)
        n, s, c = flat[-1], flat[d * d : -1], flat[: d * d].reshape(d, d)
        values, turned = np.linalg.eigh(c / n - np.outer(s / n, s / n))
        out[d] = np.round(turned[:, np.argsort(-values)[:leading]], 12)
    return out


def near_boxes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    gap = np.maximum(0.0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float((gap * gap).sum()) <= (eps + SLACK) ** 2


def ego_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, eps: float, small: int = 256) -> Iterator[tuple[slice, slice]]:
    """The pairs of short runs of two sorted intervals that can hold near vectors: the recursive join.

    x, y: the intervals' vectors; px, py: along the leading axes.  With x is y each pair comes once.
    """
    own = x is y
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d or own and d <= a:
            continue
        if not near_boxes((px[a:b].min(axis=0), px[a:b].max(axis=0)), (py[c:d].min(axis=0), py[c:d].max(axis=0)), eps):
            continue
        if b - a <= small and d - c <= small:
            yield slice(a, b), slice(c, d)
        elif own and (a, b) == (c, d):
            m = (a + b) // 2
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def _joined(x: np.ndarray, y: np.ndarray, axis: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of x and y that reach the threshold."""
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    own = x is y
    ux = unit(x)
    uy = ux if own else unit(y)
    px = ux @ axis
    py = px if own else uy @ axis
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    for s, t in ego_pairs(ux, uy, px, py, eps):
        i, j = np.nonzero(ux[s] @ uy[t].T >= threshold - 1e-9)
        i, j = i + s.start, j + t.start
        if own and s == t:
            i, j = i[i < j], j[i < j]
        a, b = x[i], y[j]
        exact = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        yield i[exact >= threshold], j[exact >= threshold]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, leading: int = 6, interval: int = 1024) -> DataFrame:
    """vec_id, label, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    leading: how many principal dimensions make the grid; interval: vectors of a block, about.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    side = max(eps, LEAST_SIDE)
    own = renamed(vectors, ["vec_id", "embedding", "label"]).withColumn("v", F.col("embedding").cast("array<double>"))
    finite = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    fit = F.coalesce(F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda y: y != 0), F.lit(False))
    # Zeros of either sign are one value.
    own = own.withColumn("v", F.when(fit, F.transform("v", lambda y: y + F.lit(0.0)))).select("vec_id", "label", "v")
    # 128 bits tell vectors apart where rows meet; within the join a vector is a running number.
    own = own.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "label"))
    own = saved(own, "vectors")
    distinct = own.where("v is not null").groupBy("label", "v", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("node")).withColumn("d", F.size("v"))
    distinct = saved(distinct.withColumn("key", F.monotonically_increasing_id()), "distinct-vectors")
    along = axes(distinct, leading)

    def celled(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("d").to_numpy()
            cell = np.empty(len(sizes), object)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = _matrix(batch.column("v").take(pa.array(at)))
                grid = np.floor((x / np.linalg.norm(x, axis=1, keepdims=True)) @ along[d] / side)
                # Cells as text that sorts as the numbers do: lexicographic order of the cells.
                cell[at] = ["".join(f"{int(c) + 500:03d}" for c in row) for row in grid]
            yield batch.append_column("cell", pa.array(cell, pa.string()))

    label_type = dict(distinct.dtypes)["label"]
    placed = distinct.select("label", "v", "key", "copies", "h1", "d").mapInArrow(celled, f"label {label_type}, v array<double>, key long, copies long, h1 long, d int, cell string")
    # Intervals of the epsilon grid order: cells in order, a crowded cell cut by the hash of the vector.  Vectors
    # before a cell: those of earlier columns, which are cells alike in the first three dimensions and bounded
    # in number, and those of earlier cells of its column.
    placed = saved(placed, "cells")
    earlier = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    cells = placed.groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("column", F.substring("cell", 1, 9))
    columns = cells.groupBy("label", "d", "column").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier("label", "d", "column")), F.lit(0)))
    cells = cells.withColumn("in_column", F.coalesce(F.sum("n").over(earlier("label", "d", "column", "cell")), F.lit(0)))
    cells = cells.join(columns.drop("n"), ["label", "d", "column"]).withColumn("before", F.col("before") + F.col("in_column"))
    cells = cells.select(F.col("label").alias("_l"), F.col("d").alias("_d"), F.col("cell").alias("_c"), "n", "before")
    spread = F.pmod(F.col("h1"), F.lit(1 << 20)).cast("double") / (1 << 20)
    placed = placed.join(cells, (F.col("label") == F.col("_l")) & (F.col("d") == F.col("_d")) & (F.col("cell") == F.col("_c")))
    placed = placed.withColumn("block", F.floor((F.col("before") + F.floor(spread * F.col("n"))) / interval).cast("long"))

    def boxed(key, table):
        import pyarrow as pa

        d = table.column("d")[0].as_py()
        table = table.sort_by([("cell", "ascending"), ("key", "ascending")])
        x = _matrix(table.column("v").combine_chunks())
        p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ along[d]
        return pa.table({"label": table.column("label")[:1], "d": pa.array([d], pa.int32()), "block": table.column("block")[:1], "low": [p.min(axis=0).tolist()], "high": [p.max(axis=0).tolist()], "keys": [table.column("key").to_pylist()], "copies": [table.column("copies").to_pylist()], "data": pa.array([x.tobytes()], pa.binary())})

    blocks = placed.select("label", "d", "cell", "key", "copies", "v", "block").groupBy("label", "d", "block").applyInArrow(boxed, f"label {label_type}, d int, block long, low array<double>, high array<double>, keys array<long>, copies array<long>, data binary")
    blocks = saved(blocks, "blocks")
    # Boxes are small rows, one a block.  They meet in the cells of the first two dimensions that both
    # reach, one of them widened by a cell; a pair counts in the first cell they share, and only near
    # pairs leave the join.
    def reach(name: str, wider: int) -> DataFrame:
        cell = lambda c, k, more: F.floor((F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) + more) / side).cast("int")
        out = blocks.select("label", "d", F.col("block").alias(name), F.col("low").alias(f"l{name}"), F.col("high").alias(f"h{name}"))
        for k in range(2):
            out = out.withColumn(f"from{k}{name}", cell(f"l{name}", k, -SLACK) - wider).withColumn(f"c{k}", F.explode(F.sequence(F.col(f"from{k}{name}"), cell(f"h{name}", k, SLACK) + wider)))
        return out

    gap = F.zip_with(F.arrays_zip("la", "ha"), F.arrays_zip("lb", "hb"), lambda s, t: F.greatest(F.lit(0.0), s["la"] - t["hb"], t["lb"] - s["ha"]))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    once = (F.col("c0") == F.greatest("from0a", "from0b")) & (F.col("c1") == F.greatest("from1a", "from1b"))
    pairs = reach("a", 0).join(reach("b", 1), ["label", "d", "c0", "c1"]).where((F.col("a") <= F.col("b")) & once & (apart <= (eps + SLACK) ** 2)).select("label", "d", "a", "b")
    one = blocks.select("label", "d", F.col("block").alias("a"), F.col("keys").alias("ka"), F.col("copies").alias("ca"), F.col("data").alias("xa"))
    two = blocks.select("label", "d", F.col("block").alias("b"), F.col("keys").alias("kb"), F.col("copies").alias("cb"), F.col("data").alias("xb"))
    met = saved(pairs.repartition(F.xxhash64("label", "d", "a", "b")), "block-pairs").join(one, ["label", "d", "a"]).join(two, ["label", "d", "b"]).select("d", "a", "b", "ka", "ca", "xa", "kb", "cb", "xb")

    def linked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r, batch=batch: batch.column(c)[r]
                d, same = get("d").as_py(), get("a").as_py() == get("b").as_py()
                ka, kb = (get(c).values.to_numpy() for c in ("ka", "kb"))
                ca, cb = (get(c).values.to_numpy() for c in ("ca", "cb"))
                x = np.frombuffer(get("xa").as_py(), np.float64).reshape(-1, d)
                y = x if same else np.frombuffer(get("xb").as_py(), np.float64).reshape(-1, d)
                na, nb, up = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), {}
                for i, j in _joined(x, y, along[d], threshold):
                    np.add.at(na, i, cb[j])
                    np.add.at(nb, j, ca[i])
                    edges = zip(ka[i].tolist(), kb[j].tolist(), strict=True)
                    up = forest((*up.items(), *edges)) if len(i) else up
                if same:
                    na, nb = na + nb, nb[:0]
                u, v = list(up), list(up.values())
                hit_a, hit_b = np.flatnonzero(na), np.flatnonzero(nb)
                key = np.concatenate([ka[hit_a], kb[: len(nb)][hit_b], np.array(u, np.int64)])
                other = pa.array([None] * (len(hit_a) + len(hit_b)) + v, pa.int64())
                more = np.concatenate([na[hit_a], nb[hit_b], np.zeros(len(u), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(key), other, pa.array(more)], ["key", "other", "more"])

    found = saved(met.mapInArrow(linked, "key long, other long, more long"), "links")
    counts = found.groupBy("key").agg(F.sum("more").alias("more"))
    edges = found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    classes = components(distinct.select("key", "node"), "key", "node", edges)
    classes = classes.join(distinct.select("key", "copies", "h1", "h2"), "key").join(counts, "key", "left")
    # A vector that takes no part meets nothing here: its hashes are left out.
    fit = lambda h: F.when(F.col("v").isNotNull(), F.col(h)).alias(h)
    out = own.select("vec_id", "label", fit("h1"), fit("h2")).join(classes, ["h1", "h2"], "left")
    out = out.select("vec_id", "label", F.coalesce(F.col("copies") - 1 + F.coalesce("more", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
