"""Retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, search
from .registry import frame, oracle_sql, query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_STEM = "CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND length(t) > {len(s) + 3} THEN left(t, length(t) - {len(s)}){chr(32) + '||' + chr(32) + chr(39) + 'y' + chr(39) if s in T.TO_Y else ''}" for s in T.SUFFIXES) + " ELSE t END"


def terms_sql(name: str, source: str) -> str:
    """CTEs that end in name (k, term) from a source with k and x."""
    return rf"""{name}_w AS (SELECT k, unnest(regexp_extract_all(x, '[A-Za-z0-9_$]+')) AS w FROM ({source})),
 {name}_p AS (SELECT k, w, regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') AS p FROM {name}_w),
 {name}_t AS (SELECT k, lower(unnest(CASE WHEN len(p) > 1 THEN list_concat([trim(w, '_$')], p) ELSE p END)) AS t FROM {name}_p),
 {name} AS (SELECT k, {_STEM} AS term FROM {name}_t WHERE length(t) > 1 AND t NOT IN ({_STOP}))"""


_DOCS = terms_sql("d", "SELECT doc_id AS k, text AS x FROM documents")
_QUERY = terms_sql("q", "SELECT item_id AS k, text AS x FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)")
_BM25 = f"""{_DOCS}, {_QUERY},
 post AS (SELECT k, term, count(*) AS tf FROM d GROUP BY ALL),
 dl AS (SELECT doc_id AS k, coalesce(dl, 0) AS dl FROM documents LEFT JOIN (SELECT k, sum(tf) AS dl FROM post GROUP BY k) ON doc_id = k),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 tdf AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
 lex AS (SELECT k, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
   FROM post JOIN tdf USING (term) JOIN dl USING (k), st GROUP BY k)"""


def spread(docs):
    """The documents' ids and texts; dealt out only where the scan has fewer splits than there are cores."""
    texts, cores = docs.select("doc_id", "text"), docs.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def corpus(spark, d):
    docs = frame(spark, d, "documents")
    postings, lengths = search.index(T.terms(spread(docs), "doc_id", "text"), "doc_id")
    every = docs.select("doc_id").join(lengths, "doc_id", "left").na.fill(0, ["dl"])
    return docs, postings, every


def first_item(spark, d):
    return frame(spark, d, "benchmark").orderBy("item_id").limit(1)


def lexical(spark, d, limit=search.FIRST_STAGE):
    _, postings, every = corpus(spark, d)
    return search.ranked(search.bm25(postings, every, T.terms(first_item(spark, d), "item_id", "text"), "doc_id"), "doc_id", limit)


def semantic(spark, d, limit=search.FIRST_STAGE):
    docs = spread(frame(spark, d, "documents"))
    q = T.hashed(first_item(spark, d), "item_id", "text").select("bucket", F.col("weight").alias("qw"))
    scores = T.hashed(docs, "doc_id", "text").join(F.broadcast(q), "bucket").groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("score"))
    return search.ranked(scores, "doc_id", limit)


@query("tokenize_docs", f"WITH {_DOCS} SELECT k AS doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM d GROUP BY k")
def tokenize_docs(spark, d):
    terms = T.terms(frame(spark, d, "documents"), "doc_id", "text")
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("doc_id").agg(F.sum("tf").alias("n_terms"), F.count("*").alias("n_distinct"))


_HASH = """{n}_t AS (SELECT k, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS t FROM ({s})),
 {n}_c AS (SELECT k, (strpos('0123456789abcdef', substr(md5(t), 31, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(t), 32, 1)) - 1 AS bucket, count(*) AS c FROM {n}_t GROUP BY ALL),
 {n} AS (SELECT k, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS w FROM {n}_c)"""
_HASHED = _HASH.format(n="hd", s="SELECT doc_id AS k, text AS x FROM documents")
_HASHED_Q = _HASH.format(n="hq", s="SELECT item_id AS k, text AS x FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)")


@query("hash_embed", f"WITH {_HASHED} SELECT k AS doc_id, CAST(bucket AS INT) AS bucket, round(w, 6) AS weight FROM hd")
def hash_embed(spark, d):
    return T.hashed(frame(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("term_stats", f"WITH {_BM25}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st ORDER BY df DESC, term LIMIT 100")
def term_stats(spark, d):
    docs, postings, every = corpus(spark, d)
    stats = search.term_stats(postings, every.agg(F.count("*").alias("n")))
    return stats.orderBy(F.col("df").desc(), "term").limit(100).withColumn("idf", F.round("idf", 6))


@query("bm25_topk", f"WITH {_BM25} SELECT k AS doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, k) AS INT) AS rank FROM lex ORDER BY lex.score DESC, k LIMIT 20")
def bm25_topk(spark, d):
    return lexical(spark, d, 20).withColumn("score", F.round("score", 6))


@query("bm25_lang_filter", f"WITH {_BM25} SELECT k AS doc_id, round(score, 6) AS score FROM lex JOIN documents ON k = doc_id WHERE lower(lang) = 'en' ORDER BY lex.score DESC, k LIMIT 20")
def bm25_lang_filter(spark, d):
    """The language filter comes after the corpus statistics and before the limit."""
    docs, postings, every = corpus(spark, d)
    scores = search.bm25(postings, every, T.terms(first_item(spark, d), "item_id", "text"), "doc_id")
    own = scores.join(docs.where(F.lower("lang") == "en").select("doc_id"), "doc_id", "left_semi")
    return search.ranked(own, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


_FIELDS = (("p_name", 3), ("p_type", 2), ("p_brand", 1))


@query("weighted_fields", "WITH " + terms_sql("d", " UNION ALL ".join(f"SELECT p_partkey AS k, {c} AS x FROM part, range({n})" for c, n in _FIELDS)) + " SELECT k AS p_partkey, term, count(*) AS tf FROM d GROUP BY ALL")
def weighted_fields(spark, d):
    part = frame(spark, d, "part")
    bags = [T.terms(part, "p_partkey", c).withColumn("w", F.lit(w)) for c, w in _FIELDS]
    return bags[0].union(bags[1]).union(bags[2]).groupBy("p_partkey", "term").agg(F.sum("w").alias("tf"))


@query("dense_topk", "SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) DESC, vec_id LIMIT 20")
def dense_topk(spark, d):
    e = frame(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    scores = e.crossJoin(F.broadcast(q)).select("vec_id", F.round(search.dot(F.col("embedding"), F.col("q")), 9).alias("score"))
    return search.ranked(scores, "vec_id", 20).select("vec_id", F.round("score", 6).alias("score"))


_LISTS = f"""WITH {_BM25}, {_HASHED}, {_HASHED_Q},
 sem AS (SELECT hd.k, round(sum(hd.w * hq.w), 9) AS score FROM hd JOIN hq USING (bucket) GROUP BY hd.k),
 l1 AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS rank FROM lex QUALIFY rank <= 50),
 l2 AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS rank FROM sem QUALIFY rank <= 50)"""


@query("hybrid_rrf", _LISTS + """, f AS (SELECT k, round(sum(1 / (60 + rank)), 12) AS score, min(rank) AS best, min(CASE WHEN l = 's' THEN rank END) AS rs, min(CASE WHEN l = 'l' THEN rank END) AS rl
 FROM (SELECT k, rank, 'l' AS l FROM l1 UNION ALL SELECT k, rank, 's' AS l FROM l2) GROUP BY k)
 SELECT k AS doc_id, round(score, 6) AS score, CAST(rs AS INT) AS rank_semantic, CAST(rl AS INT) AS rank_lexical FROM f ORDER BY f.score DESC, best, coalesce(rs, 1000000000), coalesce(rl, 1000000000), k LIMIT 10""")
def hybrid_rrf(spark, d):
    out = search.fused({"lexical": lexical(spark, d), "semantic": semantic(spark, d)}, "doc_id")
    return out.where("rank <= 10").select("doc_id", F.round("score", 6).alias("score"), "rank_semantic", "rank_lexical")


_STORED: dict[tuple[str, str], tuple] = {}


def stored_index(spark, d):
    """Postings, lengths and vectors of all documents, written once a session below the warehouse, in the order of their keys."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORED:
        place = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/index-{uuid.uuid4().hex}"
        docs, postings, every = corpus(spark, d)
        for name, rows, by in (("postings", postings, "term"), ("lengths", every, "doc_id"), ("vectors", T.hashed(spread(docs), "doc_id", "text"), "bucket")):
            rows.repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{place}/{name}")
        _STORED[key] = tuple(spark.read.parquet(f"{place}/{n}") for n in ("postings", "lengths", "vectors"))
    return _STORED[key]


@query("hybrid_stored", oracle_sql()["hybrid_rrf"])
def hybrid_stored(spark, d):
    """hybrid_rrf over a stored index: only the question's postings and buckets are read, by the order that they lie in."""
    postings, every, vectors = stored_index(spark, d)
    item = first_item(spark, d)
    asked, wanted = T.terms(item, "item_id", "text").select("term").distinct(), T.hashed(item, "item_id", "text").select("bucket", F.col("weight").alias("qw"))
    words, buckets = [r.term for r in asked.collect()], [r.bucket for r in wanted.collect()]  # of one question
    lex = search.bm25(postings.where(F.col("term").isin(*words)), every, asked, "doc_id")
    sem = vectors.where(F.col("bucket").isin(*buckets)).join(F.broadcast(wanted), "bucket").groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("score"))
    out = search.fused({"lexical": search.ranked(lex, "doc_id", search.FIRST_STAGE), "semantic": search.ranked(sem, "doc_id", search.FIRST_STAGE)}, "doc_id")
    return out.where("rank <= 10").select("doc_id", F.round("score", 6).alias("score"), "rank_semantic", "rank_lexical")


@query("rrf_ties", "SELECT * FROM (VALUES ('y', 1, 0.032522), ('x', 2, 0.032266), ('z', 3, 0.016129)) AS t(id, rank, score)")
def rrf_ties(spark, d):
    lists = {n: spark.createDataFrame([(x, i) for i, x in enumerate(xs, 1)], "id string, rank int") for n, xs in (("lexical", "xy"), ("semantic", "yzx"))}
    return search.fused(lists, "id").select("id", "rank", F.round("score", 6).alias("score"))


@query("rerank_overlap", f"""WITH {_BM25}, pool AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS rank FROM lex QUALIFY rank <= 30),
 h AS (SELECT pool.k, rank, count(qt.term) / (SELECT count(DISTINCT term) FROM q) AS s FROM pool LEFT JOIN (post JOIN (SELECT DISTINCT term FROM q) qt USING (term)) USING (k) GROUP BY ALL),
 r AS (SELECT k, rank, row_number() OVER (ORDER BY s DESC, rank) AS rr FROM h)
 SELECT k AS doc_id, round(1 / (60 + rr) + 1 / (60 + rank), 6) AS score, CAST(rr AS INT) AS rank_reranker FROM r ORDER BY round(1 / (60 + rr) + 1 / (60 + rank), 12) DESC, least(rank, rr), rr, k LIMIT 10""")
def rerank_overlap(spark, d):
    """The pool of 30, reranked by overlap (ties by first-stage rank) and fused with the first stage."""
    from pyspark.sql import Window

    _, postings, every = corpus(spark, d)
    q = T.terms(first_item(spark, d), "item_id", "text")
    pool = search.ranked(search.bm25(postings, every, q, "doc_id"), "doc_id", search.POOL)
    scored = search.overlap(postings, q, pool, "doc_id").join(pool.select("doc_id", F.col("rank").alias("_r")), "doc_id")
    again = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "_r")))
    out = search.fused({"reranker": again, "first_stage": pool}, "doc_id")
    return out.where("rank <= 10").select("doc_id", F.round("score", 6).alias("score"), "rank_reranker")


_CONTAINED = "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query("rank_metrics", f"""WITH rel AS ({_CONTAINED}), {_DOCS}, {terms_sql("q", "SELECT item_id AS k, text AS x FROM benchmark")},
 qd AS (SELECT DISTINCT k, term FROM q), s AS (SELECT qd.k AS item_id, d.k AS doc_id, count(DISTINCT term) AS s FROM (SELECT DISTINCT k, term FROM d) d JOIN qd USING (term) GROUP BY ALL),
 top AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
 n AS (SELECT item_id, count(*) AS n_rel FROM rel GROUP BY 1), ret AS (SELECT item_id, count(*) AS n_ret FROM top GROUP BY 1),
 h AS (SELECT item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM top JOIN rel USING (item_id, doc_id) GROUP BY 1)
 SELECT item_id, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(hits / n_ret, 0), 6) AS precision_returned, round(coalesce(hits, 0) / n_rel, 6) AS recall,
 round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
 FROM n LEFT JOIN ret USING (item_id) LEFT JOIN h USING (item_id)""")
def rank_metrics(spark, d):
    """All benchmark passages as queries at once; relevant are the documents that contain the passage."""
    from pyspark.sql import Window

    docs, items = frame(spark, d, "documents"), frame(spark, d, "benchmark")
    # a substring join: broadcast of the small fixed benchmark set
    relevant = docs.join(F.broadcast(items.select("item_id", F.col("text").alias("_p"))), F.col("text").contains(F.col("_p"))).select("item_id", "doc_id")
    scores = T.terms(spread(docs), "doc_id", "text").distinct().join(F.broadcast(T.terms(items, "item_id", "text").distinct()), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))
    results = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")))
    return evaluation.rank_metrics(results, relevant, "item_id", "doc_id", 10)


# The searches of a query set: every row whose id is divisible by 100, against all rows. The SQL above stays as it is.
EVERY = "item_id % 100 = 0"


def query_set(spark, d, where=EVERY):
    return frame(spark, d, "benchmark").where(where)


def lexical_set(spark, d, items, limit=search.FIRST_STAGE):
    _, postings, every = corpus(spark, d)
    return search.ranked(search.bm25(postings, every, T.terms(items, "item_id", "text"), "doc_id", by="item_id"), "doc_id", limit, "item_id")


def semantic_set(spark, d, items, limit=search.FIRST_STAGE):
    docs = spread(frame(spark, d, "documents"))
    q = T.hashed(items, "item_id", "text").withColumnRenamed("weight", "qw")
    scores = T.hashed(docs, "doc_id", "text").join(q, "bucket").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 9).alias("score"))
    return search.ranked(scores, "doc_id", limit, "item_id")


def bm25_set_sql(where=EVERY):
    """CTEs that end in lex (item_id, k, score)."""
    asked = terms_sql("q", f"SELECT item_id AS k, text AS x FROM benchmark WHERE {where}")
    return f"""{_DOCS}, {asked}, qd AS (SELECT DISTINCT k AS item_id, term FROM q),
 post AS (SELECT k, term, count(*) AS tf FROM d GROUP BY ALL),
 dl AS (SELECT doc_id AS k, coalesce(dl, 0) AS dl FROM documents LEFT JOIN (SELECT k, sum(tf) AS dl FROM post GROUP BY k) ON doc_id = k),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 tdf AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
 lex AS (SELECT item_id, k, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
   FROM post JOIN tdf USING (term) JOIN qd USING (term) JOIN dl USING (k), st GROUP BY item_id, k)"""


def lists_set_sql(where=EVERY):
    """CTEs that end in l1 (lexical) and l2 (semantic): item_id, k, rank."""
    asked = _HASH.format(n="hq", s=f"SELECT item_id AS k, text AS x FROM benchmark WHERE {where}")
    return f"""{bm25_set_sql(where)}, {_HASHED}, {asked},
 sem AS (SELECT hq.k AS item_id, hd.k, round(sum(hd.w * hq.w), 9) AS score FROM hd JOIN hq USING (bucket) GROUP BY hq.k, hd.k),
 l1 AS (SELECT item_id, k, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k) AS rank FROM lex QUALIFY rank <= 50),
 l2 AS (SELECT item_id, k, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k) AS rank FROM sem QUALIFY rank <= 50)"""


def bm25_topk_all_sql(where=EVERY):
    return f"WITH {bm25_set_sql(where)} SELECT item_id, k AS doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY lex.score DESC, k) AS INT) AS rank FROM lex QUALIFY rank <= 20"


@query("bm25_topk_all", bm25_topk_all_sql())
def bm25_topk_all(spark, d, where=EVERY):
    return lexical_set(spark, d, query_set(spark, d, where), 20).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_lang_filter_all_sql(where=EVERY):
    return f"WITH {bm25_set_sql(where)} SELECT item_id, k AS doc_id, round(score, 6) AS score FROM lex JOIN documents ON k = doc_id WHERE lower(lang) = 'en' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY lex.score DESC, k) <= 20"


@query("bm25_lang_filter_all", bm25_lang_filter_all_sql())
def bm25_lang_filter_all(spark, d, where=EVERY):
    docs, postings, every = corpus(spark, d)
    scores = search.bm25(postings, every, T.terms(query_set(spark, d, where), "item_id", "text"), "doc_id", by="item_id")
    own = scores.join(docs.where(F.lower("lang") == "en").select("doc_id"), "doc_id", "left_semi")
    return search.ranked(own, "doc_id", 20, "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


_DOT = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9)"


@query("dense_topk_all", f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, vec_id) <= 20")
def dense_topk_all(spark, d, block=4096):
    e = frame(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    scores = search.nearest(e, q, "vec_id", "query_id", "embedding", 20, block)
    return search.ranked(scores, "vec_id", 20, "query_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


def hybrid_rrf_all_sql(where=EVERY):
    return f"""WITH {lists_set_sql(where)}, f AS (SELECT item_id, k, round(sum(1 / (60 + rank)), 12) AS score, min(rank) AS best, min(CASE WHEN l = 's' THEN rank END) AS rs, min(CASE WHEN l = 'l' THEN rank END) AS rl
 FROM (SELECT item_id, k, rank, 'l' AS l FROM l1 UNION ALL SELECT item_id, k, rank, 's' FROM l2) GROUP BY item_id, k)
 SELECT item_id, k AS doc_id, round(score, 6) AS score, CAST(rs AS INT) AS rank_semantic, CAST(rl AS INT) AS rank_lexical FROM f
 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY f.score DESC, best, coalesce(rs, 1000000000), coalesce(rl, 1000000000), k) <= 10"""


@query("hybrid_rrf_all", hybrid_rrf_all_sql())
def hybrid_rrf_all(spark, d, where=EVERY):
    items = query_set(spark, d, where)
    out = search.fused({"lexical": lexical_set(spark, d, items), "semantic": semantic_set(spark, d, items)}, "doc_id", by="item_id")
    return out.where("rank <= 10").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank_semantic", "rank_lexical")


def rerank_overlap_all_sql(where=EVERY):
    return f"""WITH {bm25_set_sql(where)}, pool AS (SELECT item_id, k, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k) AS rank FROM lex QUALIFY rank <= 30),
 nq AS (SELECT item_id, count(*) AS nq FROM qd GROUP BY item_id), hit AS (SELECT item_id, k, count(*) AS h FROM post JOIN qd USING (term) GROUP BY item_id, k),
 h AS (SELECT pool.item_id, pool.k, rank, coalesce(h, 0) / nq AS s FROM pool JOIN nq USING (item_id) LEFT JOIN hit ON hit.item_id = pool.item_id AND hit.k = pool.k),
 r AS (SELECT item_id, k, rank, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, rank) AS rr FROM h)
 SELECT item_id, k AS doc_id, round(1 / (60 + rr) + 1 / (60 + rank), 6) AS score, CAST(rr AS INT) AS rank_reranker FROM r
 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(1 / (60 + rr) + 1 / (60 + rank), 12) DESC, least(rank, rr), rr, k) <= 10"""


@query("rerank_overlap_all", rerank_overlap_all_sql())
def rerank_overlap_all(spark, d, where=EVERY):
    from pyspark.sql import Window

    _, postings, every = corpus(spark, d)
    q = T.terms(query_set(spark, d, where), "item_id", "text")
    pool = search.ranked(search.bm25(postings, every, q, "doc_id", by="item_id"), "doc_id", search.POOL, "item_id")
    scored = search.overlap(postings, q, pool, "doc_id", by="item_id").join(pool.select("item_id", "doc_id", F.col("rank").alias("_r")), ["item_id", "doc_id"])
    again = scored.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "_r")))
    out = search.fused({"reranker": again, "first_stage": pool}, "doc_id", by="item_id")
    return out.where("rank <= 10").select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank_reranker")
