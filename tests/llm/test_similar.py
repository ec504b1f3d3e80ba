import random
import re

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from quarrygrid.llm import quality, similar, simhash
from quarrygrid.llm.components import forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, percent=80):
    """The smallest doc_id of each group; rows: doc_id (not null) and text."""
    found = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if x == y or 100 * len(x & y) >= percent * len(x | y):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min(d, least.get(g, d))
    return sorted(least.values())


def test_stage_same_as_brute_force(spark, small, documents):
    for docs in (quality.kept_rows(documents), documents):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, small).collect()) == brute(rows)


def test_stage_at_the_threshold(spark, small):
    """A text and one with its last words changed: 100 shingles, of which 89 (J = 0.802) or 88 (0.786) are in both."""
    text = [f"w{k}" for k in range(104)]
    changed = lambda n: " ".join([*text[: 104 - n], *(f"x{k}" for k in range(n))])
    for n, stay in ((11, [1]), (12, [1, 2])):
        rows = [(1, changed(0), "en", "a", 1), (2, changed(n), "en", "a", 1)]
        assert sorted(r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), small).collect()) == stay


def test_stage_links_through_others(spark, small):
    """A chain of texts, neighbours alike and ends not, is one group whatever the least of a band is."""
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 120]), "en", "a", 1) for k in range(20)]
    assert brute([r[:2] for r in rows]) == [0]
    assert [r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), small).collect()] == [0]


def test_odd(spark, odd, none):
    stay = similar.representatives(odd)
    assert stay.columns == odd.columns
    assert stay.count() == len({r.root for r in similar.near_duplicates(odd).collect()})
    assert similar.representatives(none).count() == 0


def test_long_texts_same_as_brute_force(spark, small):
    """Two groups of near copies around the threshold, one of texts longer than a sample, one of shorter ones."""
    rng = random.Random(5)
    rows = []
    for length in (1500, 150):
        text = [f"w{length}x{k}" for k in range(length)]
        for k in range(40):
            changed = [f"c{len(rows)}" if rng.random() < 0.022 else w for w in text]
            rows.append((len(rows), " ".join(changed), "en", "a", 1))
    stay = brute([r[:2] for r in rows])
    assert 2 < len(stay) < len(rows)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), small).collect()) == stay


def test_pairs_of_a_group_stay_in_their_block(spark):
    """Of 120 near copies of a short text no more links come out than there are texts in bands, and all are sure."""
    rng = random.Random(6)
    text = [f"w{k}" for k in range(150)]
    docs = spark.createDataFrame([(k, " ".join(f"c{k}" if rng.random() < 0.02 else w for w in text)) for k in range(120)], "doc_id long, text string")
    own = similar.signatures(docs, 5)
    distinct = own.select("fp", "n", "sketch").distinct()
    here = similar.placed(distinct).withColumn("root", F.col("fp"))
    found = similar.sets(docs, own, distinct.select("fp"), 5)
    out = similar.apart(here, distinct, found, 80, block=32, each=500).collect()
    assert all(r.sure for r in out) and 0 < len(out) <= here.count()
    sets = {r.fp: set(r.found) for r in found.collect()}
    alike = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    assert forest((r.a, r.b) for r in out) == forest(alike)
    assert similar.apart(here, distinct, found, 80, last=True).count() == 0


def test_shared_hashes_of_samples():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2000, n)).astype(np.uint64) for n in (30, 900, 1200, 5)]
    cut = [x[:300] for x in sets]
    value, length = np.concatenate(cut), np.array([len(x) for x in cut])
    most = np.array([x[299] if len(x) > 300 else ~np.uint64(0) for x in sets], np.uint64)
    i, j = np.array([0, 0, 0, 1, 1, 2]), np.array([1, 2, 3, 2, 3, 3])
    common, either = similar.shared(i, j, np.cumsum(length) - length, length, np.unique(value, return_inverse=True)[1], value, most)
    for k, (a, b) in enumerate(zip(i, j, strict=True)):
        x, y = ({int(v) for v in sets[c] if v <= min(most[a], most[b])} for c in (a, b))
        assert (common[k], either[k]) == (len(x & y), len(x | y))


def brute_print(found):
    """The wide print of a set of hashes as a list of bits, by counting."""
    mask, count = (1 << 64) - 1, [0] * simhash.WIDTH
    for x in found:
        for k in range(simhash.WIDTH // 64):
            z = (int(x) + (k + 1) * 0x9E3779B97F4A7C15) & mask
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
            z ^= z >> 31
            for b in range(64):
                count[64 * k + b] += z >> b & 1
    return [2 * c > len(found) for c in count]


def test_stage_meets_at_simhash_anchors(spark):
    """Texts meet at code words of the Hamming code within two bits of a block of their SimHash print, and nowhere else."""
    texts = [" ".join(f"w{k}x{i % 7}" for i in range(n)) for k, n in enumerate((0, 1, 7, 30, 300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = {r.fp: similar.shingles(texts[r.doc_id], 5) for r in similar.signatures(docs, 5).collect()}
    prints, blocks = {fp: brute_print(x) for fp, x in own.items()}, simhash.blocks()
    rows = similar.placed(similar.signatures(docs, 5).select("fp", "n", "sketch")).collect()
    assert {r.fp for r in rows} == set(own) and len(rows) == len({(r.fp, r.band) for r in rows})
    for r in rows:
        anchor = [r.band >> k & 1 for k in range(31)]
        assert not np.bitwise_xor.reduce([k + 1 for k in range(31) if anchor[k]] or [0])
        assert sum(a != prints[r.fp][b] for a, b in zip(anchor, blocks[r.band >> 31], strict=True)) <= 2


def test_pairs_at_the_threshold_share_an_anchor():
    rng = np.random.default_rng(2)
    for n, m, both in ((4, 5, 4), (9, 9, 8), (90, 90, 80), (450, 450, 400)):
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n + m - both).astype(np.uint64) * np.uint64(2))
            rng.shuffle(x)
            sketches = np.stack([similar.sketch(x[:n]), similar.sketch(x[n - both :])])
            assert similar.differing(sketches[:1], sketches[1:])[0] <= similar.reach(80)
            ((row, at),) = similar.visits(sketches, np.array([n, m]))
            assert set(at[row == 0]) & set(at[row == 1])


def test_sets_that_meet(spark):
    """meeting() has every set of visitors of an anchor once, but for two that are not alike or too far apart."""
    rng = random.Random(8)
    rows = [" ".join(f"c{rng.random()}" if rng.random() < rate else f"w{k}x{i}" for i in range(60 + k)) for k in range(12) for rate in (0, 0.01, 0.05, 0.2)]
    docs = spark.createDataFrame([*enumerate(rows), (99, "w0x0 " * 3)], "doc_id long, text string")
    distinct = similar.signatures(docs, 5).select("fp", "n", "sketch").distinct()
    whole = {r.fp: (r.n, np.frombuffer(r.sketch, np.uint8)[None]) for r in distinct.collect()}
    visitors = {}
    for r in similar.placed(distinct).collect():
        visitors.setdefault(r.band, set()).add(r.fp)
    want = set()
    for x in visitors.values():
        a, b = sorted(x)[0], sorted(x)[-1]
        (n, p), (m, q) = whole[a], whole[b]
        if len(x) > 2 or len(x) == 2 and 100 * min(n, m) >= 80 * max(n, m) and similar.differing(p, q)[0] <= similar.reach(80):
            want.add(frozenset(x))
    got = {}
    for r in similar.meeting(distinct, 80, each=10, entries=1000).collect():
        got.setdefault(r.band, []).append((r.fp, r.met, r.least))
    assert len(got) == len(want) > 12 and {frozenset(x[0] for x in g) for g in got.values()} == want
    assert all(met == len(g) and least == min(x[0] for x in g) for g in got.values() for _, met, least in g)
    met = similar.meeting(distinct, 80).cache()
    for block in (1024, 2):
        bands, out = {}, similar.pooled(met, block).collect()
        for r in out:
            bands.setdefault(r.band, set()).add(r.fp)
        assert all(any(x <= y for y in bands.values()) for x in want)
        assert len(out) == sum(map(len, bands.values())) <= met.count()


def near_copies(rng, copies, alone=20):
    """Short texts that share most of their words, few of them alike enough for a link, and some texts of their own."""
    text = [f"w{k}" for k in range(120)]
    rows = [" ".join(f"c{rng.random()}" if rng.random() < 0.04 else w for w in text) for _ in range(copies)]
    return [*rows, *(" ".join(f"a{k}x{i}" for i in range(60)) for k in range(alone))]


def test_near_copies_meet_in_few_rows(spark, small, monkeypatch):
    """However many parts the anchors are dealt to, a group of near copies writes few rows a text, not one for each anchor that it shares."""
    rows = [(k, x, "en", "a", 1) for k, x in enumerate(near_copies(random.Random(9), 200))]
    written = {}

    def saved(df, name, plain=similar.saved):
        out = plain(df, name)
        written[name] = max(out.count(), written.get(name, 0))
        return out

    monkeypatch.setattr(similar, "saved", saved)
    monkeypatch.setattr(similar, "parts_for", lambda n, each: 40)
    stay = brute([r[:2] for r in rows])
    assert 25 < len(stay) < len(rows)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, DOCS), small).collect()) == stay
    assert max(written.values()) < 40 * len(rows), written


def test_bands_hold_all_that_meet(spark):
    """Any two sets that meet are in a band together, whether their group is compared whole or anchor by anchor."""
    docs = spark.createDataFrame([*enumerate([*near_copies(random.Random(10), 60), "one two", "one two three", "", "w0 " * 9])], "doc_id long, text string")
    distinct = similar.signatures(docs, 5).select("fp", "n", "sketch").distinct().cache()
    met = {}
    for r in similar.meeting(distinct, 80).collect():
        met.setdefault(r.band, set()).add(r.fp)
    assert len(met) > 100
    for block in (1024, 32, 1):
        held = {}
        for r in similar.bands(distinct, 80, block)[0].collect():
            held.setdefault(r.band, set()).add(r.fp)
        assert all(any(x <= y for y in held.values()) for x in met.values())
