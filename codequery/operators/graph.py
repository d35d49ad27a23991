"""Graph operators over edge tables: bounded breadth-first search, capped expansion, ordered-candidate resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within so many directed hops of the starts (id), with the least; edges: source, target."""
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        near = front.join(edges, front["id"] == edges["source"]).select(F.col("target").alias("id")).distinct()
        front = near.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def expand(edges: DataFrame, seeds: DataFrame, hops: int, fan_out: int) -> DataFrame:
    """(id, hop) reached from the seeds (id) along edges (source, target, ord) either way, at most fan_out a node.

    The cap counts a node's edges before those to known nodes are dropped: out-edges first, then by ord.
    """
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), F.lit(0).alias("side"), "ord")
    both = both.unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), F.lit(1).alias("side"), "ord"))
    seen, front, found = seeds.select("id").distinct(), seeds.select("id").distinct(), None
    for hop in range(1, hops + 1):
        turn = Window.partitionBy("id").orderBy("side", "ord", "other")
        near = both.join(front, "id").withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= fan_out)
        front = near.select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        own = front.withColumn("hop", F.lit(hop))
        found = own if found is None else found.unionByName(own)
        seen = seen.unionByName(front)
    return found


def first_match(rows: DataFrame, key: str, candidates: Column, targets: DataFrame, target: str) -> DataFrame:
    """(key, target): the first of the ordered candidates that is among the targets; null without one."""
    tried = rows.select(key, F.posexplode(candidates).alias("_at", "_c"))
    hit = tried.join(targets.select(F.col(target).alias("_c")).distinct(), "_c").groupBy(key).agg(F.min_by("_c", "_at").alias(target))
    return rows.select(key).join(hit, key, "left")


def cascade(rules: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(target, rule) of the first rule whose target isn't null."""
    target = F.coalesce(*[t for _, t in rules])
    rule = reduce(lambda rest, r: F.when(r[1].isNotNull(), F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    return target, rule
