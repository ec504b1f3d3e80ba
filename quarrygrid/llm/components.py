"""Connected components of links, by alternating large-star and small-star rounds.

Every batch of links is first contracted to stars (union-find over what it holds), then each
round lets a node tell all its larger neighbours, and itself, its smallest neighbour.  A round is
an aggregation with map-side combine and a join whose crowded keys Spark splits; its result is
written to the shared folder, so lineage stays short and no executor's loss undoes it.  Nothing
but two totals a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node that is not its tree's smallest, with that smallest node."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(above)}


def contracted(edges: DataFrame) -> DataFrame:
    """u > v: stars that connect what each batch of edges (a, b) connects."""

    def local(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # As many links at a time as a dictionary holds well; the rounds connect what these leave apart.
        for batch in slices(batches, 200_000):
            trees = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"u": pa.array(list(trees), pa.int64()), "v": pa.array(list(trees.values()), pa.int64())})

    return edges.select("a", "b").mapInArrow(local, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """u, v for every node u of edges (a, b, both long) that is not the smallest of its component v."""
    stars = saved(contracted(edges).distinct(), "stars")
    before = _state(stars)
    for _ in range(rounds if before[0] else 0):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        out = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = saved(out.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _state(stars)
        if now == before:
            return stars
        before = now
    if before[0]:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return stars


def components(nodes: DataFrame, key: str, name: str, edges: DataFrame) -> DataFrame:
    """key, root and component_id, the smallest key and the smallest `name` of each node's component.

    nodes has one row a key.
    """
    tree = roots(edges)
    placed = nodes.join(tree.withColumnRenamed("u", key), key, "left").select(key, name, F.coalesce("v", key).alias("root"))
    placed = saved(placed, "rooted")
    linked = tree.select(F.col("v").alias("root")).distinct()
    names = placed.join(linked, "root", "left_semi").groupBy("root").agg(F.min(name).alias("least"))
    return placed.join(names, "root", "left").select(key, "root", F.coalesce("least", name).alias("component_id"))
