"""What a search tells beside ids: evidence, bounded excerpts, relationships, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.units import snippet

# Which list is what kind of evidence, in the order in which kinds are told.
EVIDENCE = (("lexical", "lexical"), ("semantic", "semantic"), ("semantic_rewrite", "semantic"), ("reranker", "reranker"), ("graph", "graph"), ("structural", "graph"))
RELATIONSHIPS = 8


def evidence(ranks: Column) -> Column:
    """Kinds of evidence of a map from list to rank; fusion itself is none."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.map_contains_key(ranks, name), F.lit(kind)) for name, kind in EVIDENCE])))


def ranks_of(ranked: DataFrame) -> Column:
    """Map from list to rank, of the columns rank_<list> that aren't null."""
    lists = [c.removeprefix("rank_") for c in ranked.columns if c.startswith("rank_")]
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in lists]), F.array(*[F.col(f"rank_{n}") for n in lists])) if lists else F.create_map().cast("map<string,int>")
    return F.map_filter(every, lambda _, rank: rank.isNotNull())


def unresolved_note(missing: DataFrame, keys: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """(unit_id, note): how many of a unit's calls nothing was found for, and the first three of them."""
    sites = F.slice(F.array_sort(F.collect_list(F.struct("line", "name"))), 1, 3)
    return missing.groupBy(*keys).agg(F.struct(F.lit("UNRESOLVED_CALLS").alias("type"), F.count("*").alias("count"), F.transform(sites, lambda s: s["name"]).alias("examples")).alias("note"))


def coverage_warnings(coverage: DataFrame) -> DataFrame:
    """(warning): what of a version was not parsed, of the one row of its coverage."""
    parse = F.when(F.col("failed") + F.col("partial") > 0, F.format_string("partial parse coverage: %d failed and %d partially parsed file(s)", "failed", "partial"))
    skip = F.when(F.col("skipped") > 0, F.format_string("%d file(s) skipped: %s", F.col("skipped"), F.to_json("skip_reasons")))
    return coverage.select(F.explode(F.array_compact(F.array(parse, skip))).alias("warning"))


def shaped(hits: DataFrame, ranks: Column, relationships: Column) -> DataFrame:
    """hits with rounded score, excerpt, evidence, at most eight relationships and warnings."""
    bounded = snippet(F.coalesce("source", F.lit("")), F.col("line_start"))
    stale = F.when(F.col("status") == "stale", F.array(F.lit("source differs from the indexed version"))).otherwise(F.array().cast("array<string>"))
    out = hits.withColumn("_s", bounded).withColumn("component_ranks", ranks)
    return out.withColumn("score", F.round("score", 6)).withColumn("evidence", evidence(F.col("component_ranks"))).withColumn("relationships", F.slice(relationships, 1, RELATIONSHIPS)).withColumn("warnings", F.concat(stale, F.coalesce("uncertainty", F.array().cast("array<string>")))).select("*", "_s.*").drop("_s")
