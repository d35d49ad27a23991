"""Retrieval: BM25 over an inverted index, dense top-k, reciprocal-rank fusion, bounded reranking.

by names the query's key where a frame holds many queries at once; without it there is one query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
FIRST_STAGE, POOL = 50, 30
MISSING = 10**9


def index(terms: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """postings (key, term, tf) and documents (key, dl)."""
    postings = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return postings, postings.groupBy(key).agg(F.sum("tf").alias("dl"))


def term_stats(postings: DataFrame, n: Column | DataFrame) -> DataFrame:
    """(term, df, idf); n: a one-row frame with the number of documents."""
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return df.select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def _over(by: str | None, *order):
    return Window.partitionBy(by).orderBy(*order) if by else Window.orderBy(*order)


def bm25(postings: DataFrame, corpus: DataFrame, query: DataFrame, key: str, k1: float = K1, b: float = B, by: str | None = None) -> DataFrame:
    """([by,] key, score) of all documents that hold a term of the query (rows of distinct terms).

    corpus: key and dl of every document, those without terms too. Only the query's postings are weighed; the
    statistics are one row. Scores are rounded to 9 places, as sums of doubles depend on their order.
    """
    stats = corpus.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    words = query.select("term").distinct()
    hit = postings.join(words if by else F.broadcast(words), "term")
    weighed = hit.join(term_stats(hit, stats.select("n")), "term").join(corpus, key).crossJoin(F.broadcast(stats.select("avgdl")))
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))))
    if by:
        weighed = weighed.select(key, "term", part.alias("_part")).join(query.select(by, "term").distinct(), "term")
        return weighed.groupBy(by, key).agg(F.round(F.sum("_part"), 9).alias("score"))
    return weighed.groupBy(key).agg(F.round(F.sum(part), 9).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(items: DataFrame, queries: DataFrame, key: str, by: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(by, key, score): of every query's dot products with all items, the k best of each block of items.

    Blocks of items meet blocks of queries, so a task holds block rows of each and no pair becomes a row unless it
    is among its block's k best. Keys are whole numbers; null vectors have no score.
    """

    def best(own: pa.Table, wanted: pa.Table) -> pa.Table:
        kinds = pa.schema([(by, pa.int64()), (key, pa.int64()), ("score", pa.float64())])
        if not len(own) or not len(wanted):
            return kinds.empty_table()
        own = own.sort_by(key)  # equal scores go by key
        ids = own[key].to_numpy()
        rows, asked = (np.array(t["_v"].to_pylist(), np.float64) for t in (own, wanted))
        out: list[list] = [[], [], []]
        for q, products in zip(wanted[by].to_pylist(), np.round(asked @ rows.T, 9), strict=True):
            at = np.argsort(-products, kind="stable")[:k]
            for column, values in zip(out, ([q] * len(at), ids[at].tolist(), products[at].tolist()), strict=True):
                column += values
        return pa.table(out, schema=kinds)

    best.__annotations__ = {"own": pa.Table, "wanted": pa.Table, "return": pa.Table}
    sides = [f.where(F.col(vector).isNotNull()).select(F.col(n).cast("long").alias(n), F.col(vector).alias("_v")) for f, n in ((items, key), (queries, by))]
    n = [max(1, -(-side.count() // block)) for side in sides]
    every = [F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in n]
    own = sides[0].withColumn("_i", F.pmod(F.xxhash64(key), F.lit(n[0])).cast("int")).withColumn("_q", every[1])
    wanted = sides[1].withColumn("_q", F.pmod(F.xxhash64(by), F.lit(n[1])).cast("int")).withColumn("_i", every[0])
    return own.groupBy("_i", "_q").cogroup(wanted.groupBy("_i", "_q")).applyInArrow(best, f"`{by}` long, `{key}` long, score double")


def ranked(scores: DataFrame, key: str, k: int, by: str | None = None) -> DataFrame:
    """The k best ([by,] key, score, rank); ties by key. The limit comes first, so that one task ranks k rows (of a query)."""
    if by:  # Spark limits each partition's groups to k rows before they are dealt out
        return scores.withColumn("rank", F.row_number().over(_over(by, F.col("score").desc(), key))).where(F.col("rank") <= k)
    top = scores.orderBy(F.col("score").desc(), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), key)))


def fused(lists: dict[str, DataFrame], key: str, k: int = RRF_K, order: tuple[str, ...] = ("semantic", "reranker", "graph", "lexical"), by: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion: ([by,] key, score, best, rank_<list>..., rank). Ties: best rank, then ranks by list in the given order."""
    union, keys = None, [by, key] if by else [key]
    for name, rows in lists.items():
        own = rows.select(*keys, "rank", F.lit(name).alias("_list"))
        union = own if union is None else union.unionByName(own)
    names = [n for n in order if n in lists] + sorted(set(lists) - set(order))
    ranks = [F.min(F.when(F.col("_list") == n, F.col("rank"))).alias(f"rank_{n}") for n in names]
    out = union.groupBy(*keys).agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best"), *ranks)
    turn = [F.col("score").desc(), F.col("best"), *[F.coalesce(F.col(f"rank_{n}"), F.lit(MISSING)) for n in names], F.col(key)]
    return out.withColumn("rank", F.row_number().over(_over(by, *turn)))


def overlap(postings: DataFrame, query: DataFrame, pool: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """A deterministic reranker: the share of the query's distinct terms that a document of the pool holds."""
    if by:
        q = query.select(by, "term").distinct()
        held = pool.select(by, key).join(postings.select(key, "term"), key).join(q, [by, "term"]).groupBy(by, key).agg(F.count("*").alias("_h"))
        asked = pool.select(by, key).join(held, [by, key], "left").join(q.groupBy(by).agg(F.count("*").alias("_q")), by, "left")
        return asked.select(by, key, (F.coalesce("_h", F.lit(0)) / F.greatest(F.coalesce("_q", F.lit(1)), F.lit(1))).alias("score"))
    q = query.select("term").distinct()
    hits = pool.select(key).join(postings.select(key, "term").join(F.broadcast(q), "term"), key, "left").groupBy(key).agg(F.count("term").alias("_h"))
    return hits.crossJoin(F.broadcast(q.agg(F.count("*").alias("_q")))).select(key, (F.col("_h") / F.greatest("_q", F.lit(1))).alias("score"))
