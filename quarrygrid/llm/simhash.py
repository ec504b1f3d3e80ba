"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints: whole texts are lower-cased (A-Z), cut into words, and every 3-word shingle, repeats
included, is hashed by XXH64; a bit is set where more than half the hashes have it set.

Search: two fingerprints that differ in at most two of 64 bits differ in at most one bit of their
lower or of their upper half.  The first 31 bits of a half are covered by the perfect Hamming code
[31, 26]: its 2**26 code words are the anchors, its covering radius is 1, so every half has one
anchor within 1 (its home) and a partner with one more difference lies within 1 + 1 of that anchor.
A fingerprint is therefore replicated to every anchor within 2 of it: 1 + 15 a half, or 1 alone for
a code word.  Of two homes the smaller is enough, which halves the visits.  Pairs meet at an anchor
as home and visitor or as two homes, and only those that differ in at most two bits leave the join.
Each distinct fingerprint takes part once, whatever number of documents has it; a crowded anchor
is split by the skew handling of the join.

Components: connected components of the links, as in `components`.

Wide prints (`wide_marks`) are for texts that are alike but differ in more bits: `WIDTH` majority bits over
a set of hashes, and for each bit how far the majority is from a tie.  A bit near a tie is the one that a
near copy has otherwise.  The print is cut into blocks of 31 bits, in `WAYS` ways of dealing the bits
out, and every block has the same anchors within 2 as above; `likely_anchors` visits those whose bits to be
turned are nearest a tie, and of all blocks those that a near copy visits most likely as well.

Defined results: a null or empty text has no shingle and fingerprint zero, which links like any
other; fewer than three words give one shingle, the whole sequence; rows with equal doc_id take
part each by its own fingerprint; a null doc_id has its fingerprint's component, which is null only
if it holds no other doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, parts_for, renamed, rows, saved, unpacked
from .components import components

#: Bits of a wide print, ways of cutting it into blocks, steps of the distance from a tie, and their length in deviations.
WIDTH, WAYS, STEPS, STEP = 512, 16, 8, 0.25
#: Anchors a text visits, of a block at most, and up to how many hashes (ties are common there) it visits all of these.
VISITS, OF_BLOCK, FEW = 320, 4, 8


def fingerprint_bits(words: list[bytes], size: int) -> int:
    """The 64-bit fingerprint of a word sequence."""
    from xxhash import xxh64_intdigest as hashed

    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= size:
        return hashed(text, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), (ends - 1)[size - 1 :].tolist()
    bits = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        h = np.array([hashed(text[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * bits > len(starts), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed 64-bit number, of every row of docs (doc_id, text)."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for some in rows(batches, 1 << 23):
            ids, hashes = (pa.array([x[k] for x in some], pa.int64()) for k in (0, 1))
            fps = np.array([fingerprint_bits((x[2] or "").encode().lower().split(), size) for x in some], np.uint64)
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    own = renamed(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(make, "doc_id long, text_hash long, fp long")


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is it the home) of halves (unsigned 32-bit): homes, and smaller anchors within 2.

    Bit i - 1 is position i of the Hamming code; the exclusive or of the set positions is the
    syndrome, which is the position where a half departs from its home.
    """
    x = half & np.uint32((1 << 31) - 1)
    syndrome = np.zeros(len(x), np.uint32)
    for i in range(1, 32):
        syndrome ^= (x >> np.uint32(i - 1) & np.uint32(1)) * np.uint32(i)
    bit = np.append(np.uint32(0), np.uint32(1) << np.arange(31, dtype=np.uint32))
    home = x ^ bit[syndrome]
    row, at, own = [np.arange(len(x))], [home], [np.ones(len(x), bool)]
    for i in range(1, 32):
        j = syndrome ^ np.uint32(i)
        other = x ^ bit[i] ^ bit[j]
        hit = np.flatnonzero((syndrome > 0) & (i < j) & (other < home))
        row.append(hit), at.append(other[hit]), own.append(np.zeros(len(hit), bool))
    return np.concatenate(row), np.concatenate(at), np.concatenate(own)


def wide_marks(found: np.ndarray) -> np.ndarray:
    """For each bit of the wide print of a set of hashes: 8 if over half have it set, plus steps from a tie, up to 7."""
    spread = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    seeds = np.arange(1, WIDTH // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = np.zeros(WIDTH, np.int64)
    for k in range(0, len(found), 255):  # counts of 255 hashes at most fit into bytes, eight of which are added at once
        z = found[k : k + 255, None] + seeds
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        count += spread[z.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    over = 2 * count - len(found)
    steps = np.minimum(STEPS - 1, np.abs(over) / (STEP * math.sqrt(max(1, len(found)))))
    return (over > 0).astype(np.uint8) << np.uint8(3) | steps.astype(np.uint8)


def blocks() -> np.ndarray:
    """The 31 bits of a wide print that make each block, a row a block."""
    rng = np.random.default_rng(11)
    return np.concatenate([rng.permutation(WIDTH)[: WIDTH // 31 * 31].reshape(-1, 31) for _ in range(WAYS)])


def likely_anchors(marks: np.ndarray, few: np.ndarray, most: int = VISITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, block << 31 | anchor) of prints (rows of wide_marks); few: rows that visit all anchors of their blocks.

    most: how many anchors the other rows visit.

    An anchor's cost is minus the logarithm of the chance that a text at a similarity of 0.8 lies at it exactly.
    """
    turned = np.array([math.erfc((k + 0.5) * STEP * 1.94 / math.sqrt(2)) / 2 for k in range(STEPS)])
    turn, keep = (np.log((1 - turned) / turned)).astype(np.float32), (-np.log(1 - turned)).astype(np.float32)
    dealt, n = blocks(), len(marks)
    steps, set_ = (marks & np.uint8(7))[:, dealt], (marks >> np.uint8(3))[:, dealt]
    x = (set_.astype(np.uint32) << np.arange(31, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    syndrome = np.bitwise_xor.reduce(set_ * np.arange(1, 32, dtype=np.uint8), axis=2)
    price = np.zeros((n, len(dealt), 32), np.float32)
    price[:, :, 1:] = turn[steps]
    i = np.arange(32, dtype=np.uint8)
    j = (syndrome[:, :, None] ^ i).astype(np.int64)
    cost = price + np.take_along_axis(price, j, 2) + keep[steps].sum(axis=2)[:, :, None]
    # Bit 0 is none: the home turns the syndrome's bit alone, others two bits; a code word is its only anchor.
    cost[(i >= j) & (i > 0) | (i > 0) & (syndrome[:, :, None] == 0)] = np.inf
    least = np.argpartition(cost, OF_BLOCK - 1, axis=2)[:, :, :OF_BLOCK]
    bit = np.append(np.uint32(0), np.uint32(1) << np.arange(31, dtype=np.uint32))
    at = (x[:, :, None] ^ bit[least] ^ bit[np.take_along_axis(j, least, 2)]).astype(np.int64)
    at = (at | np.arange(len(dealt), dtype=np.int64)[:, None] << 31).reshape(n, -1)
    cost = np.take_along_axis(cost, least, 2).reshape(n, -1)
    visited = np.repeat(few[:, None], at.shape[1], axis=1)
    np.put_along_axis(visited, np.argpartition(cost, most - 1, axis=1)[:, :most], True, 1)
    row, place = np.nonzero(visited & np.isfinite(cost))
    return row, at[row, place]


def links(distinct: DataFrame, bits: int = 2, each: int = 20_000) -> DataFrame:
    """Pairs a < b of the distinct fingerprints (column fp) that differ in `bits` bits or fewer, at most 2.

    each: fingerprints that a task places, about.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the covering search is made for up to two differing bits")

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for half, x in enumerate(fp.view(np.uint32).reshape(-1, 2).T):
                row, at, own = anchors(np.ascontiguousarray(x))
                yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(at.astype(np.int64) << 1 | half), pa.array(own)], ["fp", "anchor", "home"])

    spread = distinct.select("fp").repartition(parts_for(distinct.count(), each), "fp")
    placed = saved(spread.mapInArrow(place, "fp long, anchor long, home boolean"), "anchors")
    at_home = placed.where("home").select(F.col("fp").alias("a"), "anchor")
    all_here = placed.select(F.col("fp").alias("b"), "anchor", "home")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits) & (~F.col("home") | (F.col("a") < F.col("b")))
    pairs = at_home.join(all_here, "anchor").where(near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, bits: int = 2, size: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, root (names the component) and component_id of every row of docs; see the module."""
    own = saved(fingerprints(docs, size), "fingerprints")
    distinct = saved(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    found = links(distinct.select("fp"), bits)
    classes = components(distinct, "fp", "node", found)
    return own.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, bits: int = 2, size: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, once."""
    return first_of_each(docs, saved(near_duplicates(docs, bits, size), "classes"))


def first_of_each(docs: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of docs that are first in their component; own: doc_id, text_hash, root and component_id of every row.

    Texts move once, to meet what goes; equal rows are looked for only where keys say there are some.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Only where a doc_id is repeated can several rows be first; the smallest text hash is, then.
    several = own.where(first).groupBy("root").agg(F.min("text_hash").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = own.where(first).join(several, "root").where("text_hash != least")
    go = own.where(~first).select("doc_id", "text_hash").unionByName(again.select("doc_id", "text_hash"))
    go = go.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_hash"))
    rows_ = carried(docs, ["doc_id", "text"]).withColumn("hash", F.xxhash64("text"))
    stay = rows_.join(go, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_hash")), "left_anti")
    if not own.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", "hash"])
    return unpacked(stay, docs.columns)
