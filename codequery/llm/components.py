"""Distributed union-find over an edge table: local forests first, then alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (parent := up.get(root, root)) != root:
            root = parent
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.up.setdefault(a, a)
        self.up[b] = a
        return True

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    stars = forest.stars()
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], ["v", "r"])


def _stars(now: DataFrame) -> bool:
    """Whether every vertex has one edge and no root has any; rounds keep what is connected, so that is the end."""
    ends = now.select("v", F.lit(1).alias("edges"), F.lit(0).alias("root")).union(now.select("r", F.lit(0), F.lit(1)))
    ends = ends.groupBy("v").agg(F.sum("edges").alias("edges"), F.max("root").alias("root"))
    return ends.where("edges > 1 or edges > 0 and root > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(v, root): every vertex that some edge joins to a smaller one, with the smallest vertex it can reach.

    Roots themselves and isolated vertices have no row. Edges may repeat, run either way or be loops; edges
    with a null end are ignored. A partition's edges shrink to a forest before any shuffle, so a hot vertex
    costs a row per partition; each round is written; the minimum is the only thing gathered per vertex.
    """
    clean = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = stored(clean.mapInArrow(_local, "v long, r long"))
    for _ in range(max_rounds):
        if _stars(now):
            return now.select("v", F.col("r").alias("root"))
        both = now.union(now.select("r", "v"))
        # what is joined is written first: joins of plain tables are the ones whose hot keys Spark splits
        low = stored(both.groupBy("v").agg(F.least(F.min("r"), F.first("v")).alias("m")))
        large = stored(both.where("r > v").join(low, "v").select(F.col("r").alias("v"), F.col("m").alias("r")))
        least = stored(large.groupBy("v").agg(F.min("r").alias("m")))
        near = large.join(least, "v")
        small = near.select("v", F.col("m").alias("r")).union(near.where("r <> m").select(F.col("r").alias("v"), "m"))
        then = stored(small.distinct())
        dropped(now, low, large, least)
        now = then
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def classes(members: DataFrame, found: DataFrame, key: str, least: str) -> DataFrame:
    """members with root and class: their component's root by the components found over key, and its least value of a column.

    members: a row a vertex. Written, as are the minima, so that later joins can split a hot root or vertex.
    """
    rooted = stored(members.join(found.withColumnRenamed("v", key), key, "left").withColumn("root", F.coalesce("root", key)))
    first = stored(rooted.groupBy("root").agg(F.min(least).alias("class")))
    return stored(rooted.join(first, "root"))
