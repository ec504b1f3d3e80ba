import numpy as np
import pytest

from quarrygrid.llm import ego_join


def brute(rows, threshold=0.93):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float64), np.array(rows[b][1], np.float64)
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out, seen = {}, {}
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], set()
            while todo:
                if (k := todo.pop()) not in group:
                    group.add(k)
                    todo += links[k]
            for k in group:
                seen[k] = min(rows[k][0] for k in group)
        out[rows[i][0]] = (len(links[i]), seen[i])
    return out


def found(df, **options):
    return {r.vec_id: (r.n_links, r.component_id) for r in ego_join.near_duplicates(df, **options).collect()}


def test_same_as_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert found(df, interval=64) == brute(rows)


@pytest.mark.parametrize("interval", [16, 1024])
def test_clusters_copies_and_odd_vectors(spark, interval):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for _ in range(40):
            rows.append((len(rows), [float(x) for x in (centre + rng.normal(size=16) * 0.25).astype(np.float32)], c % 2))
    rows += [(1000 + k, rows[0][1], 0) for k in range(50)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (2003, [None] + [1.0] * 15, 0), (2004, rows[0][1], None), (2005, [1.0, 0.0], 0), (2006, [2.0, 0.0], 0), (2007, [], 0), (2008, [-0.0, 5.0], 1), (2009, [0.0, 3.0], 1), (2010, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    assert found(df, interval=interval) == brute(rows)


def test_one_label(spark):
    """All vectors under one label, in many cells and crowded ones."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 12)), rng.normal(size=12) + 0.3 * rng.normal(size=(300, 12))])
    rows = [(k, [float(v) for v in y.astype(np.float32)], 3) for k, y in enumerate(x)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6), interval=32) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert found(df) == {}


def test_skipping_is_safe():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.eye(8)[:, :3]
    x = x[np.lexsort(np.floor(x @ axis / 0.3).T[::-1])]
    eps = 0.5
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if np.linalg.norm(x[i] - x[j]) <= eps}
    met = set()
    for s, t in ego_join.ego_pairs(x, x, x @ axis, x @ axis, eps, 16):
        pairs = {(i, j) for i in range(s.start, s.stop) for j in range(t.start, t.stop) if i < j}
        assert not pairs & met
        met |= pairs
    assert near <= met and len(met) < 300 * 299 / 2
