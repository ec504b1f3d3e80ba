import hashlib
import random

import numpy as np
import pytest

from quarrygrid.llm import suffix_dedup as S


def brute(rows, length):
    """rows: (order, text); by order: bytes, removed, runs, checksum."""
    first, out = set(), []
    for order, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        cover = np.zeros(len(raw) + 1, np.int64)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in first:
                cover[s] += 1
                cover[s + length] -= 1
            first.add(w)
        gone = np.cumsum(cover)[: len(raw)] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((order, len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def found(df, length=100):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(df, length).collect())


@pytest.mark.parametrize(("many", "batch"), [(50_000, 1 << 24), (1, 1 << 16), (3, 1 << 15)])
def test_same_as_brute_force(spark, documents, many, batch, monkeypatch):
    # The limits decide how windows are dealt out, never what is found; local workers are forked and see them.
    small = documents.where("doc_id < 120").coalesce(1)
    monkeypatch.setattr(S, "MANY", many)
    monkeypatch.setattr(S, "BATCH", batch)
    assert found(small) == brute([(r.doc_id, r.text) for r in small.collect()], 100)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(30, 260))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pool) if r.random() < 0.6 else "".join(r.choice("abcxyz") for _ in range(r.randrange(80))) for _ in range(r.randrange(6)))) for i in range(60)]
    rows += [(60, "a" * 700), (61, "ab" * 400), (62, "a" * 150), (63, None), (64, ""), (65, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == brute(rows, 100)


@pytest.mark.parametrize("block", [1 << 15, 4])
def test_suffix_columns_equal_brute_force(block, monkeypatch):
    """The collections' suffixes one column at a time, against comparing all windows."""
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(5)
    length = 40
    data, group, off, many = [], [], [], []
    for g in range(8):
        core = bytes(r.choice(b"ab") for _ in range(32))
        lefts = [bytes(r.choice(b"ab") for _ in range(8)) for _ in range(3)]
        for _ in range(r.randrange(1, 12)):
            left = r.choice(lefts)[r.randrange(8) :] if r.random() < 0.8 else b""
            whole = left + core + bytes(r.choice(b"ab") for _ in range(r.randrange(8 - min(len(left), 8), 9)))
            if len(whole) >= length:
                data.append(whole)
                group.append(g)
                off.append(len(left))
                many.append(r.random() < 0.2)
    rank = np.array(r.sample(range(len(data)), len(data)))
    flat, size = np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data])
    got = list(zip(*(x.tolist() for x in S.repeated_windows(flat, size, np.array(group, np.uint64), np.array(off), rank, np.array(many), length)), strict=True))
    places = {}
    for k, d in enumerate(data):
        for s in range(len(d) - length + 1):
            places.setdefault((group[k], s - off[k], d[s : s + length]), []).append((rank[k], k, s))
    want = set()
    for some in places.values():
        (_, k, s), *rest = sorted(some)
        want |= {(k, s, S.LATER)} if many[k] else set()
        want |= {(k, s, S.ALL) for _, k, s in rest}
    assert len(got) == len(want) and set(got) == want


def test_equal_hashes_are_told_apart_by_bytes():
    flat = np.frombuffer(b"a" * 110 + b"b" * 110, np.uint8)
    c = {"doc": np.array([0, 1]), "start": np.array([0, 110]), "nw": np.array([11, 11]), "off": np.array([0, 0]), "key": np.ones(2, np.uint64), "seg": np.ones(2, np.uint64)}
    assert S.entries(flat, c, 100)[1].tolist() == [True, True]


def test_gram_of_every_batch(spark, monkeypatch):
    """A passage that each of many batches has, at other places and in other company."""
    monkeypatch.setattr(S, "BATCH", 2000)
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = noise(150)
    rows = [(i, noise(r.randrange(300)) + passage + noise(r.randrange(300))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert S.batches(df, [])[0].select("batch").distinct().count() > 10
    assert found(df) == brute(rows, 100)


def test_very_long_text(spark):
    """64 MB in one row: 16 MB of noise four times, with an odd number of bytes between; and a short text that has a part of it."""
    part = np.random.default_rng(0).integers(97, 123, 1 << 24, np.uint8).tobytes().decode()
    rows = [(1, part + "0" + part + "123" + part + "45678" + part), (2, "9" * 50 + part[5_000_000:5_000_500] + "8" * 50)]
    got = {r.doc_id: r for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = (part + "0123" + "45678").encode()
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (3 << 24, 3, hashlib.sha256(kept).hexdigest())
    assert (got[2].n_removed, got[2].n_spans) == (500, 1)


def test_odd(spark, odd, none):
    got = S.digest(odd).collect()
    assert len(got) == odd.count() and S.digest(none).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id not in (9, 10)}
    assert by[None].n_removed == 0 and by[2].n_removed == by[2].n_bytes and by[3].n_bytes == by[4].n_bytes == 0
    assert by[6].n_removed == by[6].n_bytes - 8 and by[6].n_spans == 1
    assert by[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert sum(r.text is None for r in kept.collect()) == 1
    # Rows that are all equal are still ordered once and for all: one keeps its text.
    twins = spark.createDataFrame([(7, "x" * 99 + "yz" * 60)] * 5, "doc_id long, text string")
    assert sorted(r.n_removed for r in S.digest(twins).collect())[1:] == [219] * 4


def test_kept_text_stays_text(spark):
    base = "".join(chr(0xE0 + k % 30) + str(k) for k in range(60))
    df = spark.createDataFrame([(1, base), (2, "a" + base[1:] + "b")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.deduplicated(df).collect()}
    assert out[1] == base and out[2].startswith("a") and out[2].endswith("b") and len(out[2]) < 5
