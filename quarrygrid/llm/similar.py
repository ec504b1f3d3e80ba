"""Near-duplicates by SimHash anchors, held against the Jaccard similarity of word shingles.

Shingles: texts are lower-cased (A-Z) and cut into words, as for the fingerprints of `simhash`; a
text is the set of its 5-word shingles, hashed by XXH64.  Two texts are linked where their sets
have a Jaccard similarity of at least 0.8.  Such texts differ in ten of 64 bits on average, beyond the
radius of the fingerprints of `simhash`; wide prints of 512 bits differ in 78.

Search: a text's sketch is its wide print with the steps from a tie, four bits each.  The print's blocks visit
the anchors of the covering code that a near copy visits most likely as well (`simhash.likely_anchors`), and
texts that visit the same anchor meet.  Anchors with the same visitors count once; two texts alone at an anchor
that differ in more than 140 bits do not meet there.  Of pairs at exactly 0.8 the README has the share that
meets at no anchor, as simulated.  Near copies share hundreds of anchors, each with other visitors, so what meets
comes out by labels (`pools`): the likeliest anchors give most of a group one label, and for all anchors a part
then has a row for a label, not for a visit.  Texts that meet are
linked in three steps.  First each text is held against one other, the least found to meet it, by the exact
similarity; that connects most of a group of copies by as many pairs as it has texts.  Then all texts that meet directly
or through others, or those of each anchor if these bring fewer rows (`bands`), that are still in different components are compared in blocks of bounded size, where a pair whose prints
differ in 140 bits or fewer (78 are expected at 0.8, with a deviation of 8) is looked at, once in its block.
Each text brings the 512 smallest hashes of its set.  If that is all of both sets, the block
itself decides by the exact similarity, and a forest of its links leaves it.  Of longer sets the samples only
estimate the similarity; each text's most alike partner is held against the exact one, and last, what is
then still in different components.  So of texts up to 512 shingles no pairs leave a block, of longer
ones those whose samples come within 4.5 deviations of the threshold.

Defined results: a null or empty text has the empty set, which is equal to itself only; fewer than
five words give one shingle, the whole sequence; doc_id is as in `simhash`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, parts_for, renamed, rows, saved, slices
from .components import components, forest, roots
from .simhash import FEW, VISITS, WIDTH, first_of_each, likely_anchors, wide_marks

#: Bytes of a sketch, and hashes of a sample.
SKETCH, SAMPLE = WIDTH // 2, 512
#: Of a text's anchors the likeliest, which are gathered first.
FIRST = 32


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, in order, each once."""
    from xxhash import xxh64_intdigest as hashed

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    some = (hashed(b" ".join(words[k : k + size]), 42) for k in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter(some, np.uint64))


def sketch(found: np.ndarray) -> np.ndarray:
    """The wide print of a set, two bits and their steps a byte."""
    marks = wide_marks(found)
    return marks[::2] | marks[1::2] << np.uint8(4)


def visits(sketches: np.ndarray, n: np.ndarray, some: int = 128, most: int = VISITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, anchor) of sketches (rows) of sets of n hashes, `some` rows at a time; most: of a set the likeliest so many."""
    for k in range(0, len(n), some):
        own = sketches[k : k + some]
        marks = np.stack([own & np.uint8(15), own >> np.uint8(4)], axis=2).reshape(len(own), -1)
        row, at = likely_anchors(marks, n[k : k + some] <= (FEW if most == VISITS else -1), most)
        yield row + k, at


def reach(percent: int) -> int:
    """Bits in which prints of sets of this similarity may differ: 7.7 deviations over the mean, for ties in small sets."""
    p = math.acos(2 * percent / (100 + percent)) / math.pi
    return int(WIDTH * p + 7.7 * math.sqrt(WIDTH * p * (1 - p)))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, fp (names the set), n (its size) and sketch of every row of docs (doc_id, text)."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest as hashed

        for some in rows(batches, 1 << 22):
            fps, sizes, sketches = [], [], []
            for x in some:
                found = shingles(x[2], size)
                fps.append(hashed(found.tobytes(), 42))
                sizes.append(len(found))
                sketches.append(sketch(found).tobytes())
            ids, hashes = (pa.array([x[k] for x in some], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "fp", "n", "sketch"])

    own = renamed(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(make, "doc_id long, text_hash long, fp long, n long, sketch binary")


def placed(distinct: DataFrame) -> DataFrame:
    """fp, n and band: a row for each anchor that sets of distinct (fp, n, sketch) visit."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in slices(batches, 4096):
            fp, n = (some.column(c).to_numpy() for c in ("fp", "n"))
            for row, at in visits(np.frombuffer(b"".join(some.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH), n):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[row], n[row], at)], ["fp", "n", "band"])

    return distinct.select("fp", "n", "sketch").mapInArrow(make, "fp long, n long, band long")


def dealt(distinct: DataFrame, parts: int, each: int, most: int = VISITS) -> DataFrame:
    """part, and as arrays the visits of distinct (fp, n, sketch, label) to the anchors of the part; each: sets a task places."""

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in slices(batches, 2048):
            fp, n, label = (some.column(c).to_numpy() for c in ("fp", "n", "label"))
            rows_, at = (np.concatenate(x) for x in zip(*visits(np.frombuffer(b"".join(some.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH), n, most=most), strict=True))
            mixed = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = ((mixed ^ mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, rows_, at = part[order], rows_[order], at[order]
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            columns = [fp[rows_], n[rows_], label[rows_], (at & ((1 << 31) - 1)).astype(np.uint32), (at >> 31).astype(np.uint16)]
            packed = [pa.array([x.tobytes() for x in np.split(c, cut[1:])], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), *packed], ["part", "fp", "n", "label", "anchor", "block"])

    spread = distinct.select("fp", "n", "sketch", "label").repartition(parts_for(distinct.count(), each), "fp")
    return spread.mapInArrow(deal, "part long, fp binary, n binary, label binary, anchor binary, block binary")


def gathered(table, percent: int) -> tuple[np.ndarray, ...]:
    """fp, n and label of the visits of a part of dealt(), anchor by anchor; length and name of the anchors.

    Only anchors that two sets or more visit, those with the same visitors once; of two whose sizes are not alike none.
    """
    fp, n, label, anchor, block = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("fp", np.int64), ("n", np.int64), ("label", np.int64), ("anchor", np.uint32), ("block", np.uint16)))
    at = block.astype(np.int64) << 31 | anchor
    order = np.lexsort((fp, at))
    fp, n, label, at = fp[order], n[order], label[order], at[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    length = np.diff(np.append(start, len(at)))
    keep = length > 1
    two = np.flatnonzero(length == 2)
    x, y = n[start[two]], n[start[two] + 1]
    keep[two] = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
    # The name of a set of visitors: the sum of their mixed numbers, and how many they are.
    z = fp.view(np.uint64)
    z = (z ^ z >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    name = np.add.reduceat(z ^ z >> np.uint64(32), start) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if len(at) else z
    once = np.flatnonzero(keep)
    once = once[np.unique(name[once], return_index=True)[1]]
    start, length, name = start[once], length[once], name[once].view(np.int64)
    rows_ = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    return fp[rows_], n[rows_], label[rows_], length, name


def meeting(distinct: DataFrame, percent: int, each: int = 4_000, entries: int = 500_000) -> DataFrame:
    """fp, n and band of sets that meet; a band names all visitors of an anchor, met of them, of which least is the least.

    What placed() gives as rows moves here as arrays, by parts of the anchors.  Of two visitors whose sizes are not
    alike no rows come out.  each: sets that a task places, entries: visits that a task gathers, about.
    """

    def gather(table):
        import pyarrow as pa

        fp, n, _, length, name = gathered(table, percent)
        start = np.cumsum(length) - length
        out = [fp, n, *(np.repeat(x, length) for x in (name, length, fp[start], n[start]))]
        return pa.table([pa.array(c, pa.int64()) for c in out], ["fp", "n", "band", "met", "least", "least_n"])

    parts = parts_for(distinct.count() * VISITS, entries)
    met = dealt(distinct.withColumn("label", F.col("fp")), parts, each).groupBy("part").applyInArrow(gather, "fp long, n long, band long, met long, least long, least_n long")
    met = saved(met.dropDuplicates(["band", "fp"]), "meeting")
    far = saved(too_far(met, distinct, percent), "too-far")
    return met.join(far, "band", "left_anti")


def labels_meeting(labelled: DataFrame, percent: int, most: int, each: int = 4_000, entries: int = 500_000) -> DataFrame:
    """a, b, visits, x, y and least: which labels of labelled (fp, n, sketch, label) meet at the `most` likeliest anchors.

    Two sets x and y alone at anchors are a row, with their labels.  Of anchors with more visitors a part of them
    has one row for each label a, with b, the least label that it meets there directly or through others, and the
    least set that the set named a meets, if their sizes are alike.  visits: how many the row stands for.
    """

    def gather(table):
        import pyarrow as pa

        fp, n, label, length, _ = gathered(table, percent)
        start = np.cumsum(length) - length
        two = np.zeros(len(length), bool)
        two[length == 2] = (label[start[length == 2]] != label[start[length == 2] + 1])
        x = start[two]
        once, times = np.unique(np.stack([fp[x], fp[x + 1], label[x], label[x + 1]]), axis=1, return_counts=True)
        least, least_n = (np.repeat(c[start], length) for c in (fp, n))
        least_label = np.repeat(np.minimum.reduceat(label, start), length) if len(label) else label
        more = np.repeat(~two, length)
        fp, n, label, least, least_n, least_label = (c[more] for c in (fp, n, label, least, least_n, least_label))
        pairs = np.unique(np.stack([least_label, label]), axis=1)
        trees = forest(zip(*pairs[:, pairs[0] != pairs[1]].tolist(), strict=True))
        here, tally = np.unique(label, return_counts=True)
        first = np.full(len(here), np.iinfo(np.int64).max)
        star = (fp == label) & (fp != least) & (100 * np.minimum(n, least_n) >= percent * np.maximum(n, least_n))
        np.minimum.at(first, np.searchsorted(here, label[star]), least[star])
        none, absent = np.zeros(len(here), np.int64), np.ones(len(here), bool)
        columns = {
            "a": [pa.array(once[2]), pa.array(here)],
            "b": [pa.array(once[3]), pa.array([trees.get(v, v) for v in here.tolist()], pa.int64())],
            "visits": [pa.array(2 * times), pa.array(tally)],
            "x": [pa.array(once[0]), pa.array(none, mask=absent)],
            "y": [pa.array(once[1]), pa.array(none, mask=absent)],
            "least": [pa.array(once[0]), pa.array(first, mask=first == np.iinfo(np.int64).max)],
        }
        return pa.table({k: pa.chunked_array([c.cast(pa.int64()) for c in v], pa.int64()) for k, v in columns.items()})

    parts = parts_for(labelled.count() * most, entries)
    return dealt(labelled, parts, each, most).groupBy("part").applyInArrow(gather, "a long, b long, visits long, x long, y long, least long")


def pools(distinct: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """fp and label of all sets, where those that meet directly or through others have one label; label and visits; stars.

    The likeliest anchors are gathered first: they give most sets of a group of near copies one label, so that of
    all their other anchors a part has a row for the group and not one for each visit.  stars: a set b with
    another that it meets, a.
    """
    labels, stars = distinct.select("fp", F.col("fp").alias("label")), None
    for most in (FIRST, VISITS):
        labelled = distinct.select("fp", "n", "sketch").join(labels, "fp")
        met = saved(labels_meeting(labelled, percent, most), "labels-meeting")
        two = met.where("x is not null").groupBy("x", "y").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("visits").alias("visits"))
        two = saved(two.withColumn("pair", F.monotonically_increasing_id()), "two-alone")
        far = too_far(two.select(F.col("pair").alias("band"), F.lit(2).alias("met"), F.col("x").alias("least"), F.col("y").alias("fp")), distinct, percent)
        two = two.join(far.withColumnRenamed("band", "pair"), "pair", "left_anti")
        more = met.where("x is null")
        own = two.select("a", "b", "visits", F.col("y").alias("fp"), F.col("x").alias("least")).unionByName(more.select("a", "b", "visits", F.col("a").alias("fp"), "least"))
        own = saved(own, "labels-linked")
        tree = saved(roots(own.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "pools")
        name = lambda c, tree=tree: c.join(tree.withColumnRenamed("u", "label"), "label", "left").withColumn("label", F.coalesce("v", "label")).drop("v")
        labels = saved(name(labels), "labels")
        found = own.where("least is not null").select(F.col("least").alias("a"), F.col("fp").alias("b"))
        stars = found if stars is None else stars.unionByName(found)
    visited = name(own.select(F.col("a").alias("label"), "visits")).groupBy("label").agg(F.sum("visits").alias("visits"))
    return labels, visited, stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def bands(distinct: DataFrame, percent: int, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """fp, n and band, so that any two sets that meet are in a band together; and a star of links to be tried first.

    All that meets directly or through others is one band, as in pooled(), if that takes no more rows than it has visits.
    Only the others' anchors come out one by one.
    """
    labels, visited, stars = pools(distinct, percent)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("of")).where("of > 1").join(visited, "label", "left")
    sizes = saved(sizes.withColumn("whole", (F.col("of") <= block) | (F.col("of") * F.ceil(F.col("of") / block) <= F.coalesce("visits", F.lit(0)))), "pool-sizes")
    members = saved(labels.join(sizes.select("label", "whole"), "label").join(distinct.select("fp", "n"), "fp").select("fp", "n", F.col("label").alias("band"), "whole"), "pool-members")
    out = members.where("whole").drop("whole")
    if not (rest := members.where("not whole").select("fp")).isEmpty():
        out = out.unionByName(pooled(meeting(distinct.join(rest, "fp", "left_semi"), percent), block))
    return out, stars


def pooled(met: DataFrame, block: int = 1024) -> DataFrame:
    """fp, n and band of meeting(), where all that meets directly or through others is one band if that takes no more rows.

    Such a band's sets are compared each with each, in blocks, and bring as many rows as they have blocks; near copies
    that share hundreds of anchors, each with other visitors, bring fewer so.  No two that meet are taken apart.
    """
    # One link a set connects most; what a band still has apart is linked by its roots.
    stars = roots(met.where("fp != least").groupBy("fp").agg(F.min("least").alias("a")).select("a", F.col("fp").alias("b")))
    near = met.select("fp", "n", "band").join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "n", "band", F.coalesce("v", "fp").alias("root"))
    near = saved(near, "pools-near")
    apart_ = near.groupBy("band").agg(F.min("root").alias("a"), F.collect_set("root").alias("all")).where(F.size("all") > 1)
    pools = roots(apart_.select("a", F.explode("all").alias("b")).where("a != b").distinct())
    rooted = near.join(pools.withColumnRenamed("u", "root"), "root", "left").select("fp", "n", "band", F.coalesce("v", "root").alias("pool"))
    rooted = saved(rooted, "pools")
    members = rooted.groupBy("pool", "fp").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("visits"))
    sizes = members.groupBy("pool").agg(F.count(F.lit(1)).alias("of"), F.sum("visits").alias("visits"))
    fewer = saved(sizes.where(F.col("of") * F.ceil(F.col("of") / block) <= F.col("visits")).select("pool"), "pools-compared-whole")
    whole = members.join(fewer, "pool", "left_semi").select("fp", "n", F.col("pool").alias("band"))
    return rooted.join(fewer, "pool", "left_anti").select("fp", "n", "band").unionByName(whole)


def too_far(met: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """band of two sets of meeting() whose prints differ in more bits than sets of that similarity do."""

    def differ(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in "xy")
            yield pa.RecordBatch.from_arrays([some.column("band").filter(pa.array(differing(x, y) > reach(percent)))], ["band"])

    pairs = met.where("met = 2 and fp != least").select("band", "least", "fp")
    both = pairs.join(distinct.select("fp", F.col("sketch").alias("y")), "fp")
    both = both.join(distinct.select(F.col("fp").alias("least"), F.col("sketch").alias("x")), "least")
    return both.select("band", "x", "y").mapInArrow(differ, "band long")


def sets(docs: DataFrame, own: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """fp and the shingles of every fp of wanted, from one text each."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in rows(batches, 1 << 22):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([shingles(x[1], size).view(np.int64) for x in some], pa.list_(pa.int64()))], ["fp", "found"])

    one = own.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    one = one.select("fp", F.col("one.doc_id").alias("_doc_id"), F.col("one.text_hash").alias("_hash"))
    texts = carried(docs, ["doc_id", "text"]).drop("row").withColumn("hash", F.xxhash64("text"))
    met = texts.join(one, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_hash"))).select("fp", "text")
    return met.mapInArrow(make, "fp long, found array<long>").dropDuplicates(["fp"])


def linked(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets have a similarity of `percent` hundredths or more."""
    both = pairs.join(found.select(F.col("fp").alias("a"), F.col("found").alias("x")), "a").join(found.select(F.col("fp").alias("b"), F.col("found").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("k"))
    return both.where(100 * F.col("k") >= percent * (F.col("n") + F.col("m") - F.col("k"))).select("a", "b")


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the prints of the rows of two arrays of sketches differ."""
    words = (x.view(np.uint64) ^ y.view(np.uint64)) & np.uint64(0x8888888888888888)
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def shared(i: np.ndarray, j: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray, value: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of samples (i sorted, j): how many hashes both have, and how many either has up to the smaller end.

    A sample is the `length` hashes from `start` in value, ascending; number: the same hashes as small whole numbers;
    most: up to which hash a sample has all of its set.
    """
    common, either = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    marked = np.zeros(int(number.max()) + 1, bool)
    new = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for low, high in zip(new, np.append(new[1:], len(i)), strict=True):
        own, with_ = slice(start[i[low]], start[i[low]] + length[i[low]]), j[low:high]
        at = np.cumsum(length[with_]) - length[with_]
        places = np.arange(at[-1] + length[with_[-1]]) + np.repeat(start[with_] - at, length[with_])
        end = np.minimum(most[i[low]], most[with_])
        marked[number[own]] = True
        common[low:high] = np.add.reduceat(marked[number[places]], at, dtype=np.int64)
        marked[number[own]] = False
        other = np.add.reduceat(value[places] <= np.repeat(end, length[with_]), at, dtype=np.int64)
        either[low:high] = np.searchsorted(value[own], end, "right") + other - common[low:high]
    return common, either


def apart(here: DataFrame, distinct: DataFrame, found: DataFrame, percent: int, last: bool = False, block: int = 1024, each: int = 4_000) -> DataFrame:
    """Pairs (a, b) that meet in a band and are in different components; sure: of a forest of links, else they may be links.

    here: fp, n, band and root.  Of pairs that are not sure each set has the one whose prints differ least; `last`: all
    of these pairs and no others.  A band of more than `block` sets is cut into blocks that are compared two by two;
    `each`: sets that a task gets, about.
    """
    mixed = here.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("met"), F.max("n").alias("longest"))
    mixed = mixed.where("least != most").where(F.col("longest") > (SAMPLE if last else -1)).select("band", "met")
    left = here.join(mixed, "band").withColumn("of", F.ceil(F.col("met") / block))
    left = left.withColumn("block", F.pmod(F.xxhash64("fp"), "of")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of").cast("int") - 1)))
    left = left.select("fp", "n", "band", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    left = saved(left, "bands-apart")
    parts = parts_for(left.count(), each)
    brought = distinct.select("fp", "sketch").join(found.select("fp", F.slice("found", 1, SAMPLE).alias("some")), "fp")
    left = left.join(brought, "fp").withColumn("part", F.pmod(F.xxhash64("band", "low", "high"), F.lit(parts)))
    far = reach(percent)
    near = percent / 100 - 4.5 * (percent * (100 - percent) / SAMPLE) ** 0.5 / 100

    def compare(table):
        import pyarrow as pa

        fp, n, band, root, own, low, high = (table.column(c).to_numpy() for c in ("fp", "n", "band", "root", "block", "low", "high"))
        order = np.lexsort((fp, high, low, band))
        fp, n, band, root, own, low, high = (x[order] for x in (fp, n, band, root, own, low, high))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)[order]
        length = np.minimum(n, SAMPLE)
        samples = table.column("some")
        value = np.concatenate([x.flatten().to_numpy() for x in samples.chunks]).view(np.uint64)
        sizes = np.empty(len(n), np.int64)  # of the samples, in the table's own order
        sizes[order] = length
        start = (np.cumsum(sizes) - sizes)[order]
        number = np.unique(value, return_inverse=True)[1]
        most = np.full(len(n), ~np.uint64(0))
        most[n > SAMPLE] = value[(start + length - 1)[n > SAMPLE]]
        new = np.append(True, (band[1:] != band[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        end = np.append(np.flatnonzero(new)[1:], len(fp))[np.cumsum(new) - 1]
        sure, perhaps = [], []
        times = end - np.arange(len(fp)) - 1  # each set with those after it in its group
        at = 0
        while at < len(fp):
            to = max(at + 1, int(np.searchsorted(np.cumsum(times[at:]), 50_000, "right")) + at)
            i = np.repeat(np.arange(at, to), times[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(times[at:to]) - times[at:to], times[at:to])
            at = to
            some = (root[i] != root[j]) & ((low[i] == high[i]) | (own[i] != own[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if last:
                some &= np.maximum(n[i], n[j]) > SAMPLE
            i, j = i[some], j[some]
            apart_by = differing(sketches[i], sketches[j])
            some = apart_by <= far
            i, j, apart_by = i[some], j[some], apart_by[some]
            if not len(i):
                continue
            # Pairs that meet at several anchors are looked at once.
            first = np.sort(np.unique(np.stack([fp[i], fp[j]]), axis=1, return_index=True)[1])
            i, j, apart_by = i[first], j[first], apart_by[first]
            common, either = shared(i, j, start, length, number, value, most)
            whole = np.maximum(n[i], n[j]) <= SAMPLE
            some = whole & (100 * common >= percent * either)
            sure.append((fp[i[some]], fp[j[some]]))
            some = ~whole & (common >= near * either)
            i, j, apart_by = i[some], j[some], apart_by[some]
            if not last:
                by = np.lexsort((j, apart_by, i))
                by = by[np.append(True, i[by][1:] != i[by][:-1])[: len(by)]]
                i, j = i[by], j[by]
            perhaps.append((fp[i], fp[j]))
        a, b = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in sure)]) for k in (0, 1))
        trees = forest(zip(a.tolist(), b.tolist(), strict=True))
        a, b = (np.concatenate([np.empty(0, np.int64), *(x[k] for x in perhaps)]) for k in (0, 1))
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
        return pa.table({
            "a": pa.array([*trees.values(), *np.minimum(a, b).tolist()], pa.int64()),
            "b": pa.array([*trees, *np.maximum(a, b).tolist()], pa.int64()),
            "sure": pa.array([True] * len(trees) + [False] * len(a), pa.bool_()),
        })

    return left.groupBy("part").applyInArrow(compare, "a long, b long, sure boolean")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, text_hash, fp, root (names the component) and component_id of every row of docs; see the module."""
    own = saved(signatures(docs, size), "signatures")
    distinct = saved(own.groupBy("fp").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "distinct-sets")
    together, stars = bands(distinct, percent)
    together = saved(together, "bands")
    found = saved(sets(docs, own, together.select("fp").distinct(), size), "sets")
    links = saved(linked(stars, found, percent), "links")
    for last in (False, True):
        here = together.join(roots(links).withColumnRenamed("u", "fp"), "fp", "left").select("band", "fp", "n", F.coalesce("v", "fp").alias("root"))
        rest = saved(apart(saved(here, "bands-rooted"), distinct, found, percent, last), "pairs-apart")
        held = saved(linked(rest.where("not sure").select("a", "b").distinct(), found, percent), "links")
        links = links.unionByName(rest.where("sure").select("a", "b")).unionByName(held)
    classes = components(distinct.select("fp", "node"), "fp", "node", links)
    return own.select("doc_id", "text_hash", "fp").join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, once."""
    return first_of_each(docs, saved(near_duplicates(docs, percent, size), "classes"))
