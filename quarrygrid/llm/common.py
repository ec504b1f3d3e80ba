"""What the operators of this subpackage share."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: White space between words, in every contract here: 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


@functools.lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    """One temporary folder for each application; the setting itself cannot be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix=f"quarrygrid-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder takes its place if all of Spark runs in this process (master
    local or local[...]); a cluster without a shared folder is an error.
    """
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and the executors of {master} do not share a local folder")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, lost executors lose nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; the tokenizers are a parameter of what uses them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator, length: int = 256) -> Iterator:
    """Arrow batches cut short, so that few rows at a time become Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, length):
            yield batch.slice(k, length)


def rows(batches: Iterator, size: int = 1 << 25) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as tuples, in lists whose texts have about `size` characters at most."""
    some, held = [], 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            some.append(row)
            held += sum(len(x) for x in row if isinstance(x, (str, bytes))) + 64
            if held >= size:
                yield some
                some, held = [], 0
    if some:
        yield some


def by_source_rank(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], bucket: Column, rank: str, total: str | None = None) -> DataFrame:
    """df with the gapless rank (from 0) of each row in its group by `order`, a hot group spread out.

    `bucket` is a whole number that never falls along `order` and cuts every group into small parts:
    rows are ranked in their part, and the sizes of the parts before it are added.  `total` names a
    further column with the group's size.  Groups may be null.
    """
    df = df.withColumn("_part", bucket)
    sizes = df.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*[F.col(g) for g in groups]) if groups else W.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.sum("_n").over(before.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    if total:
        sizes = sizes.withColumn(total, F.sum("_n").over(before))
    keys = [*groups, "_part"]
    sizes = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before", *([total] if total else []))
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    ranked = df.withColumn("_row", F.row_number().over(W.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)))
    out = ranked.join(sizes, on).withColumn(rank, F.coalesce("_before", F.lit(0)) + F.col("_row") - 1)
    return out.drop("_part", "_row", "_before", *[f"_k{i}" for i in range(len(keys))])


def told_apart(rows_: DataFrame, key: Sequence[str], number: str, nth: str) -> DataFrame:
    """rows_ with `nth`, which numbers the rows that are equal in `key` from 0.

    number: a whole number that differs from row to row, as monotonically_increasing_id() makes and a written
    table keeps; its upper bits cut equal rows into parts of 2**20 at most, so that no task gathers a hot key.
    """
    if rows_.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return rows_.withColumn(nth, F.lit(0).cast("long"))
    return by_source_rank(rows_, key, [number], F.shiftright(F.col(number), 20), nth)


def hex_bucket(hexes: Column | str, parts: int) -> Column:
    """Which of `parts` even parts the hash falls in; hexes: lower-case hexadecimal digits of a hash, as text."""
    return F.floor(F.conv(F.substring(hexes, 1, 8), 16, 10).cast("double") * parts / float(1 << 32)).cast("long")


def even_parts(n: int) -> int:
    """Into how many parts to cut n rows that are to be ranked: as many parts as rows in each."""
    return max(1, math.isqrt(n))


def parts_for(n: int, each: int) -> int:
    return max(1, -(-n // each))


def carried(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns that an operator reads, and `row` with all of them: whatever df has stays apart."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`") for c in keep])


def unpacked(df: DataFrame, columns: Sequence[str], text: str | None = None) -> DataFrame:
    """The columns that carried() put into `row`; text: the column that takes the place of row's text."""
    return df.select(*[F.col(text).alias(c) if text and c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def renamed(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the columns that an operator reads: extra columns, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in keep])
