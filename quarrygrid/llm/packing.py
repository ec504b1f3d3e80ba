"""Best-fit packing by the sum of squares.

Bins hold `capacity` tokens.  Let N(g) be how many open bins have a gap of g tokens.  A piece goes
into the open bin with room after which the sum of N(g) ** 2 is smallest: gaps that few bins have are
made, gaps that many have are used, and none piles up.  Full bins count no more.  A new bin is
opened where no open one has room: sequences are to be few, and with the longest pieces first an
early new bin is never needed.

Pieces are dealt to blocks of bounded size by a hash and packed there, longest first; bins that a
block leaves open give their pieces back to a second, smaller deal, and so on until one block is
left.  No task holds more than a block, whatever the corpus.

Documents: the tokens of the whole text and the end id; only longer ones than a bin are cut, into
full pieces and a last one.

Defined results: a null text is an empty one (only the end id); rows with equal doc_id are packed
each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, renamed, rows, saved
from .token_frames import encoder

#: row tells rows with equal doc_id apart: a hash of the text.
PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Every piece of docs (doc_id, text): PIECE, nth (a running number) and the ids if asked for."""
    schema = f"{PIECE}, nth long" + (", ids binary" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        tokens, nth = encoder(tokenizer, 500_000), TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for some in rows(batches, 1 << 21):
            out = []
            for (doc_id, text), found in zip(some, tokens.encode([t or "" for _, t in some]), strict=True):
                all_ids = np.append(found, np.uint32(end_id)).astype("<u4")
                row = xxhash.xxh64_intdigest(text or "") >> 1
                for k, at in enumerate(range(0, len(all_ids), capacity)):
                    own = all_ids[at : at + capacity].tobytes()
                    out.append((doc_id, row, k, at, len(own) // 4, zlib.crc32(own), nth, *([own] if ids else [])))
                    nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names)

    return renamed(docs, ["doc_id", "text"]).mapInArrow(make, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in the order given; bins are numbered from 0 as they are opened."""
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is never counted
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins, never = np.empty(len(lengths), np.int64), 0, np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            # From gap g to g - size the sum changes by 2 * (N(g - size) - N(g) + 1), and by 1 - 2 * N(g)
            # if that fills the bin; of equal changes the smallest gap is taken.
            change = 2 * (n[: capacity - size] - n[size:capacity] + 1)
            change[0] = 1 - 2 * n[size]
            change[n[size:capacity] == 0] = never
            if change[at := int(change.argmin())] < never:
                gap = at + size
        if gap < capacity:
            n[gap] -= 1
            own = open_[gap].pop()
        else:
            own, bins = bins, bins + 1
        out[k] = own
        if gap > size:
            n[gap - size] += 1
            open_[gap - size].append(own)
    return out


def pack(items: DataFrame, capacity: int = 2048, each: int = 50_000) -> DataFrame:
    """items (PIECE and nth) with sequence_id and offset.

    each: pieces of a block, about; every block is one task's work and memory.
    """
    columns = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "nth"]
    items = items.select(*columns)
    blocks, level, done = parts_for(items.count(), each), 0, None

    def in_block(key, table):
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        # Longest first; the rest makes the order the same in every run.
        order = np.lexsort([table.column("piece").to_numpy(), table.column("row").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -lengths])
        table, lengths = table.take(pa.array(order)), lengths[order]
        bins = sum_of_squares(lengths, capacity)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        starts = ends - lengths[by_bin]
        new = np.append(True, bins[by_bin][1:] != bins[by_bin][:-1])
        offset = np.empty(len(bins), np.int64)
        offset[by_bin] = starts - np.maximum.accumulate(np.where(new, starts, 0))
        fill = np.bincount(bins, lengths)
        block = key[0].as_py()
        for name, values in (("sequence_id", bins + (level << 56) + (block << 32)), ("offset", offset), ("open", fill[bins] < capacity)):
            table = table.append_column(name, pa.array(values))
        return table.drop_columns(["block"])

    schema = f"{PIECE}, nth long, sequence_id long, offset long, open boolean"
    while True:
        own = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "row", "piece", "nth"), F.lit(blocks)))
        found = own.groupBy("block").applyInArrow(in_block, schema)
        if blocks == 1:
            return (done.unionByName(found) if done else found).drop("open", "nth")
        found = saved(found, "packed")
        closed = found.where("not open")
        done = done.unionByName(closed) if done else closed
        items = found.where("open").select(*columns)
        blocks, level = max(1, min(blocks // 2, parts_for(items.count(), each))), level + 1


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs (doc_id, text)."""
    return pack(saved(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """sequence_id and ids (little-endian unsigned 32-bit, binary): the packed training sequences themselves.

    The pieces' ids are looked up again by document and piece; at most `capacity` ids meet in a row.
    """
    own = saved(pieces(docs, tokenizer, capacity, end_id, ids=True), "pieces")
    places = pack(own, capacity)
    # nth is not in places: equal pieces of equal rows are interchangeable, and numbered alike on both sides.
    from pyspark.sql.window import Window as W

    key = ["doc_id", "row", "piece"]
    number = lambda df, by: df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(by)))
    a, b = number(own.select(*key, "nth", "ids"), "nth"), number(places.select(*key, "sequence_id", "offset"), "sequence_id")
    both = a.join(b, [a[c].eqNullSafe(b[c]) for c in [*key, "_k"]]).select("sequence_id", "offset", "ids")
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))
