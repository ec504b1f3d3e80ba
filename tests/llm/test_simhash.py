import random
import re

import xxhash

from quarrygrid.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows, bits=2):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d if d is not None else -1, p, least.get(top(i), -1)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def found(df):
    got = simhash.near_duplicates(df).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id if r.component_id is not None else -1) for r in got)


def test_same_as_brute_force(documents):
    assert found(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd(odd, none):
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []


def test_links_miss_no_pair(spark):
    """Every pair within two bits, whichever bits they are, and no other pair."""
    r = random.Random(4)
    prints = set()
    for _ in range(150):
        x = r.getrandbits(64)
        prints |= {x, x ^ 1 << r.randrange(64), x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), x ^ 7 << r.randrange(60)}
    x = r.getrandbits(64)
    prints |= {x} | {x ^ 1 << a ^ 1 << b for a in range(64) for b in (31, 63, (a * 7 + 1) % 64)}
    prints = sorted(prints)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = {tuple(sorted((signed(p), signed(q)))) for i, p in enumerate(prints) for q in prints[:i] if (p ^ q).bit_count() <= 2}
    got = [(e.a, e.b) for e in simhash.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_one_of_each_group_stays(documents, odd, none):
    for df in (documents, odd, none):
        stay = simhash.representatives(df)
        assert stay.columns == df.columns
        groups = {(r.root) for r in simhash.near_duplicates(df).collect()}
        assert stay.count() == len(groups)
    ids = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert {r.doc_id for r in simhash.representatives(documents).collect()} == ids
