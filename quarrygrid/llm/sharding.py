"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle; a row's fractional rank is
(rank + 1/2) / rows of its source.  All rows are sorted by fractional rank and the sequence is cut
into shards of equal length, so every stretch of it, and with it every shard, holds each source in
the proportion of the whole (within one row a source and cut).  The law kept is `rows`: shard
counts are at most one apart.

Ranks need no task that sees a whole source: rows fall into even parts of the hash (then of the
fractional rank), each part is ranked on its own, and the sizes of earlier parts are added.  Only
keys are shuffled, never texts.

Defined results: a null text has size 8 and checksum 0; null sources form one stratum; rows with
equal doc_id are placed each on its own: the shuffle is by doc_id, checksum, size and, for rows equal in
these, a running number, so no key is hot; an empty table gives no rows; more shards than rows leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_source_rank, carried, even_parts, hex_bucket, renamed, saved, told_apart


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size")


def crc_of(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")


def interleaved(keys: DataFrame, group: str, shuffle: Column, tie: list[str], n: int | None = None) -> DataFrame:
    """keys with `position`: gapless from 0, every group spread evenly over the sequence.

    shuffle: a seeded hash as hexadecimal text; tie: columns that order equal hashes; n: rows of keys,
    counted here where not given.
    """
    n = keys.count() if n is None else n
    parts = even_parts(n)
    keys = keys.withColumn("_h", shuffle)
    ranked = by_source_rank(keys, [group], ["_h", *[F.col(c).asc_nulls_first() for c in tie]], hex_bucket("_h", parts), "_rank", "_of")
    ranked = ranked.withColumn("_f", (2 * F.col("_rank") + 1) / (2 * F.col("_of")))
    order = ["_f", F.col(group).asc_nulls_last(), "_rank"]
    out = by_source_rank(ranked, [], order, F.floor(F.col("_f") * parts), "position")
    return out.drop("_h", "_f", "_rank", "_of")


KEY = ["doc_id", "source", "size", "text_crc32"]


def placed(keys: DataFrame, shards: int, seed: int) -> DataFrame:
    """keys (KEY and number, see told_apart) with shard and slot."""
    n = keys.count()
    keys = told_apart(keys, KEY, "number", "nth")
    words = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "text_crc32", "size", "nth")]
    out = interleaved(keys, "source", F.md5(F.concat_ws(":", F.lit(seed), *words)), ["doc_id", "text_crc32", "size", "nth"], n)
    which = F.expr(f"cast(position * {shards} div {max(n, 1)} as int)")
    first = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return out.withColumn("shard", which).withColumn("slot", F.col("position") - first).drop("position", "nth")


def shard(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of docs (doc_id, text, source)."""
    keys = renamed(docs, ["doc_id", "text", "source"]).select("doc_id", "source", size_of("text"), crc_of("text"), F.monotonically_increasing_id().alias("number"))
    return placed(saved(keys, "shard-keys"), shards, seed).drop("number")


def write_shards(docs: DataFrame, folder: str, shards: int = 24, seed: int = 1) -> None:
    """The rows of docs with all their columns in folder/_shard=K, in slot order within files.

    Rows are numbered and written first; they find their slots by that number.
    """
    own = carried(docs, ["doc_id", "source", "text"]).select("row", "doc_id", "source", size_of("text"), crc_of("text"), F.monotonically_increasing_id().alias("number"))
    own = saved(own, "shard-rows")
    places = placed(own.drop("row"), shards, seed).select("number", F.col("shard").alias("_shard"), "slot")
    out = own.select("row", "number").join(places, "number").repartitionByRange("_shard", "slot").sortWithinPartitions("_shard", "slot")
    out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "_shard").write.partitionBy("_shard").parquet(folder)
