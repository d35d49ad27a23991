"""Ranking metrics over (query, id, rank) and (query, id) relevance, one row for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, units: DataFrame) -> DataFrame:
    """(query, label, unit_id): units that labels mean, by qualified name or path::qualified name; null where none does."""
    cut = F.regexp_extract("label", r"(?s)^(.*)::(.*)$", 1)
    wanted = labels.withColumn("_path", F.when(F.col("label").contains("::") & (cut != ""), cut)).withColumn("_name", F.element_at(F.split("label", "::"), -1))
    same = (F.col("_name") == F.col("qualified_name")) & (F.col("_path").isNull() | (F.col("_path") == F.col("path")))
    return wanted.join(units.select("path", "qualified_name", "unit_id"), same, "left").select("query", "label", "unit_id")


def report(metrics: DataFrame, results: DataFrame, mode: str, query: str, latency: str) -> DataFrame:
    """One row a mode: means of the metrics, latencies, the share of verified results and the queries missed at one.

    metrics: a row for each mode and query; results: a row for each result with status. Means are rounded to four places.
    """
    numbers = [c for c, t in metrics.dtypes if c not in (mode, query, latency) and t == "double"]
    nearest = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{latency}`)")
    out = metrics.groupBy(mode).agg(*[F.round(F.avg(c), 4).alias(c) for c in numbers], F.round(F.percentile(latency, F.lit(0.5)), 2).alias("latency_p50"), F.round(nearest, 2).alias("latency_p95"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("recall_1") == 0, F.col(query))))).alias("misses_at_1"))
    valid = results.groupBy(mode).agg(F.round(F.avg((F.col("status") == "verified").cast("double")), 4).alias("span_validity"))
    return out.join(valid, mode, "left")


def index_stats(units: DataFrame, retrievable: DataFrame) -> DataFrame:
    """One row: units, those that search returns, and bytes of their sources."""
    every = units.agg(F.count("*").alias("all_units"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("source_bytes"))
    return every.crossJoin(retrievable.agg(F.count("*").alias("retrievable_units")))


def weighted_score(retrieval: Column, dependency: Column, explanation: Column, citation: Column) -> Column:
    """The weighted mean of four accuracies; the weights are fixed values."""
    return F.round(0.3 * retrieval + 0.3 * dependency + 0.2 * explanation + 0.2 * citation, 4)


def rank_metrics(results: DataFrame, relevant: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """precision (by k and by the number returned), recall, reciprocal rank and nDCG at k, for each query with relevant rows."""
    top = results.where(F.col("rank") <= k)
    n = relevant.groupBy(query).agg(F.count("*").alias("n_rel"))
    returned = top.groupBy(query).agg(F.count("*").alias("n_ret"))
    hits = top.join(relevant, [query, key]).groupBy(query).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda a, x: a + x)
    rows = n.join(returned, query, "left").join(hits, query, "left").na.fill(0, ["hits", "n_ret", "dcg"])
    return rows.select(
        query,
        F.round(F.col("hits") / k, 6).alias("precision"),
        F.round(F.when(F.col("n_ret") > 0, F.col("hits") / F.col("n_ret")).otherwise(0.0), 6).alias("precision_returned"),
        F.round(F.col("hits") / F.col("n_rel"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )
