import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarrygrid.llm import packing
from quarrygrid.llm.common import tokenizer_path
from quarrygrid.llm.tokenize import load

WORDS = "word_bpe_49k.json"


def check(df, **options):
    got = packing.packed(df, tokenizer_path(WORDS)).collect()
    library = load(tokenizer_path(WORDS))
    want = []
    for r in df.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.append((r.doc_id or -1, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by), -(-sum(r.length for r in got) // 2048)


def test_documents(documents):
    bins, least = check(documents)
    assert bins <= 1.01 * least + 1


def test_odd(odd, none):
    check(odd)
    assert packing.packed(none, tokenizer_path(WORDS)).count() == 0


def test_levels(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), 0, 0, 0, int(n), 0, int(i)) for i, n in enumerate(rng.integers(1, 2049, 6000))]
    df = spark.createDataFrame(rows, packing.PIECE + ", nth long")
    got = packing.pack(df, each=700).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 6000 and max(fill.values()) <= 2048
    assert len(fill) <= 1.02 * sum(fill.values()) / 2048


@pytest.mark.parametrize("seed", range(3))
def test_rule(seed):
    """Every placement makes the sum of squares as small as any other would."""
    rng = np.random.default_rng(seed)
    capacity, lengths = 24, rng.integers(1, 25, 200)
    bins = packing.sum_of_squares(lengths, capacity)
    gaps: list[int] = []

    def squares(g):
        n = np.bincount([x for x in g if 0 < x < capacity], minlength=capacity)
        return int((n * n).sum())

    for size, own in zip(lengths.tolist(), bins.tolist(), strict=True):
        options = [squares([*gaps[:k], g - size, *gaps[k + 1 :]]) for k, g in enumerate(gaps) if g >= size] or [squares([*gaps, capacity - size])]
        if own == len(gaps):
            gaps.append(capacity - size)
        else:
            gaps[own] -= size
        assert gaps[own] >= 0 and squares(gaps) == min(options)


def test_sequences_hold_the_ids(documents):
    df = documents.limit(40)
    library = load(tokenizer_path(WORDS))
    got = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(df, tokenizer_path(WORDS)).collect()])
    want = np.concatenate([[*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in df.collect()])
    assert sorted(got.tolist()) == sorted(want.tolist())
