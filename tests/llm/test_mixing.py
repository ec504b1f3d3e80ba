import re
from collections import Counter, defaultdict

import pytest

from quarrygrid.llm import mixing


def brute_targets(sizes, weights):
    left, want, fixed = 1.5 * sum(sizes), {}, {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        total = sum(weights[k] for k in free)
        want = {k: (left - sum(fixed.values())) * weights[k] / total for k in free} if free else {}
        over = [k for k in free if want[k] > 2 * sizes[k] + 1e-9]
        if not over:
            return [fixed.get(k, want.get(k)) for k in range(len(sizes))]
        fixed |= {k: 2 * sizes[k] for k in over}


def check(df):
    got, rows = mixing.mixed(df).collect(), df.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, words(r.text)) for r in rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))]), strict=True))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in order:
        assert abs(taken[s] - want[s]) <= largest[s]
    return sorted((r.doc_id or -1, r.size, r.taken) for r in got)


def test_documents(documents):
    assert check(documents) == check(documents.repartition(5))


def test_hot_source_and_capped(spark):
    rows = [(i, "w " * (1 + i * 7919 % 90), "hot" if i % 3 else f"s{i % 9}") for i in range(2000)] + [(5000, "one two", "tiny"), (5001, None, None), (5002, "", "zero")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_odd(odd, none):
    check(odd)
    assert mixing.mixed(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert mixing.mixed_rows(none).columns == none.columns


def test_rows_come_as_often_as_taken(documents, odd):
    want = Counter({r.doc_id: r.copies for r in mixing.mixed(documents).collect() if r.copies})
    out = mixing.mixed_rows(documents)
    assert out.columns == documents.columns and Counter(r.doc_id for r in out.collect()) == want
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_equal_rows_have_their_own_copies(spark):
    """200 rows and 200 equal ones, of two sources: words out are those that the mix takes, source by source."""
    rows = [(i, "w " * (1 + i % 37), "a") for i in range(200)] + [(1000 + i % 2, "w " * (5 + i % 2), "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken, out = Counter(), Counter()
    for r in mixing.mixed(df).collect():
        taken[r.source] += r.taken
    made = mixing.mixed_rows(df).collect()
    for r in made:
        out[r.source] += len(r.text.split())
    assert out == taken and check(df) == check(df.repartition(2))
    assert len({(r.doc_id, r.source) for r in made}) <= 202


@pytest.mark.parametrize("ids", [None, 7])
def test_one_doc_id_for_all(spark, ids):
    check(spark.createDataFrame([(ids, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(500)], "doc_id long, text string, source string"))


def test_unsolved_is_an_error(spark):
    cells = spark.createDataFrame([(0, 5, 10), (0, 9, 10)], "source_no long, size long, n long")
    with pytest.raises(RuntimeError, match="settled"):
        mixing.multipliers(cells, [{"words": 140, "docs": 20, "target": 90.0}], 2.0, steps=1)


def test_least_divergence(spark):
    """The tilted rates have less relative entropy than other rates that meet the target."""
    import numpy as np

    rows = [(i, "w " * n, "a" if i < 60 else "b") for i, n in enumerate(np.random.default_rng(0).integers(1, 200, 120).tolist())]
    got = [r for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.source == "b"]
    rate, size, target = (np.array([getattr(r, c) for r in got], float) for c in ("rate", "size", "target"))
    assert rate @ size == pytest.approx(target[0], rel=1e-6)
    cost = lambda q: float((q * np.log(np.maximum(q, 1e-300)) - q + 1).sum())
    rng = np.random.default_rng(1)
    for _ in range(200):
        step = rng.normal(size=len(rate))
        step -= size * (step @ size) / (size @ size)
        other = rate + 1e-3 * step
        if other.min() > 0 and other.max() <= 2:
            assert cost(other) >= cost(rate) - 1e-9
