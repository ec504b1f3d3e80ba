"""A deterministic book of parcels, and a stream of readings over it, for demos and load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text columns, and how many values each has: `depot-0`, `depot-1` and so on.
KINDS = {"depot": 12, "carrier": 7, "country": 25, "service": 4, "status": 6, "size_class": 5, "customer": 400, "lane": 60}
#: Measures: least and greatest value, decimals.
MEASURES = {"weight": (0, 30, 3), "volume": (0, 2, 4), "distance": (1, 3000, 1), "fee": (2, 90, 2), "fuel": (0, 12, 2), "insured": (0, 5000, 0), "stops": (0, 40, 0), "delay": (-120, 600, 0), "temperature": (-20, 45, 1), "battery": (0, 100, 0)}
#: What a reading changes.
READ = ("distance", "fuel", "stops", "delay", "temperature", "battery")


def _uniform(seed: int, *by: Column) -> Column:
    """A number from 0 to 1 that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30)) / float(1 << 30)


def _measure(name: str, seed: int, *by: Column) -> Column:
    low, high, digits = MEASURES[name]
    return F.round(low + _uniform(seed, F.lit(name), *by) * (high - low), digits)


def parcel_id(n: Column) -> Column:
    return F.concat(F.lit("parcel-"), F.lpad(n.cast("string"), 9, "0"))


def parcels(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows keyed by `id`; the same for the same n and seed, made in parallel."""
    i = F.col("i")
    kind = lambda name, many: F.concat(F.lit(f"{name}-"), F.floor(_uniform(seed, F.lit(name), i) * many).cast("string")).alias(name)
    df = spark.range(n).withColumnRenamed("id", "i")
    return df.select(parcel_id(i).alias("id"), *[kind(k, many) for k, many in KINDS.items()], *[_measure(m, seed, i).alias(m) for m in MEASURES], F.date_add(F.lit("2024-01-01").cast("date"), F.floor(_uniform(seed, F.lit("day"), i) * 366).cast("int")).alias("posted"), (_uniform(seed, F.lit("signed"), i) < 0.5).alias("signed"))


def readings(spark: SparkSession, n: int, rows_per_second: int = 500, seed: int = 7) -> DataFrame:
    """A stream of partial rows over parcels(n): id and what is read, with seq in arrival order."""
    src = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    v = F.col("value")
    which = (_uniform(seed, F.lit("row"), v) * n).cast("long")
    return src.select(parcel_id(which).alias("id"), *[_measure(m, seed, v).alias(m) for m in READ], v.alias("seq"), F.col("timestamp").alias("ts"))
