"""Graph and resolution queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import frame, query


def _edges(spark, d):
    """region -> nation -> customer -> order."""
    n, c, o = (frame(spark, d, t) for t in ("nation", "customer", "orders"))
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"))
    return link(n, "r", "n_regionkey", "n", "n_nationkey").union(link(c, "n", "c_nationkey", "c", "c_custkey")).union(link(o, "c", "o_custkey", "o", "o_orderkey"))


_EDGES = "e AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


@query("path_bfs", f"WITH RECURSIVE {_EDGES}, p AS (SELECT 'r0' AS id, 0 AS hop UNION SELECT t, hop + 1 FROM p JOIN e ON id = s WHERE hop < 5) SELECT hop, count(DISTINCT id) AS nodes FROM p GROUP BY hop")
def path_bfs(spark, d):
    starts = spark.createDataFrame([("r0",)], "id string")
    return graph.reach(_edges(spark, d), starts, 5).groupBy("hop").agg(F.count("*").alias("nodes"))


@query("impact", f"""WITH RECURSIVE {_EDGES}, p AS (SELECT 'n' || n_nationkey AS id, 0 AS hop FROM nation WHERE contains(lower(n_name), '1') UNION SELECT t, hop + 1 FROM p JOIN e ON id = s WHERE hop < 4),
 k AS (SELECT count(DISTINCT id) AS n FROM p) SELECT n AS reached, CASE WHEN n > 8 THEN 'high' WHEN n > 3 THEN 'medium' ELSE 'low' END AS severity, round(least(0.95, 0.4 + 0.05 * n), 6) AS confidence FROM k""")
def impact(spark, d):
    """Symbols by name, what they reach in four hops, and how grave that is."""
    starts = frame(spark, d, "nation").where(F.lower("n_name").contains("1")).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    n = graph.reach(_edges(spark, d), starts, 4).agg(F.count("*").alias("reached"))
    grade = F.when(F.col("reached") > 8, "high").when(F.col("reached") > 3, "medium").otherwise("low")
    return n.select("reached", grade.alias("severity"), F.round(F.least(F.lit(0.95), 0.4 + 0.05 * F.col("reached")), 6).alias("confidence"))


_PS = "ps AS (SELECT 'p' || l_partkey AS s, 's' || l_suppkey AS t, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY ALL), b AS (SELECT s AS id, t AS other, 0 AS side, ord FROM ps UNION ALL SELECT t, s, 1, ord FROM ps), c AS (SELECT id, other FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY side, ord, other) <= 8)"


@query("edge_expand", f"WITH {_PS}, h1 AS (SELECT DISTINCT other AS id FROM c WHERE id = 'p1'), h2 AS (SELECT DISTINCT other AS id FROM c JOIN h1 USING (id) WHERE other <> 'p1' AND other NOT IN (SELECT id FROM h1)) SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2")
def edge_expand(spark, d):
    li = frame(spark, d, "lineitem")
    edges = li.groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.expand(edges, spark.createDataFrame([("p1",)], "id string"), 2, 8)


_BASE = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '')"


@query("import_resolve", f"""WITH b AS (SELECT page_id, {_BASE} AS u FROM pages), t AS (SELECT DISTINCT u FROM b WHERE contains(u, '.html')),
 c AS (SELECT page_id, unnest([1, 2]) AS o, unnest([u || '.html', regexp_replace(u, '/$', '') || '.html']) AS c FROM b)
 SELECT b.page_id, min_by(c.c, o) AS target, CASE WHEN min(o) IS NULL THEN 'external' ELSE 'resolved' END AS status FROM b LEFT JOIN (SELECT c.* FROM c JOIN t ON c.c = t.u) c USING (page_id) GROUP BY b.page_id""")
def import_resolve(spark, d):
    """The first of a list of candidate names that exists; pages stand in for modules."""
    u = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    rows = frame(spark, d, "pages").select("page_id", u.alias("u"))
    targets = rows.where(F.col("u").contains(".html")).select(F.col("u").alias("target"))
    candidates = F.array(F.concat("u", F.lit(".html")), F.concat(F.regexp_replace("u", "/$", ""), F.lit(".html")))
    out = graph.first_match(rows, "page_id", candidates, targets, "target")
    return out.withColumn("status", F.when(F.col("target").isNull(), "external").otherwise("resolved"))


_CALLS = """WITH c AS (SELECT o.o_orderkey, c_nationkey, n_regionkey FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 s1 AS (SELECT s_nationkey AS nk, min(s_suppkey) AS same_nation FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
 s2 AS (SELECT n_regionkey AS rk, min(s_suppkey) AS same_region FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9500 GROUP BY 1),
 r AS (SELECT o_orderkey, coalesce(same_nation, same_region) AS target, CASE WHEN same_nation IS NOT NULL THEN 'same_nation' WHEN same_region IS NOT NULL THEN 'same_region' END AS resolution FROM c LEFT JOIN s1 ON c_nationkey = nk LEFT JOIN s2 ON n_regionkey = rk)"""


def _resolved(spark, d):
    o, c, n, s = (frame(spark, d, t) for t in ("orders", "customer", "nation", "supplier"))
    calls = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_nationkey", "n_regionkey")
    near = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("same_nation"))
    far = s.where("s_acctbal > 9500").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("same_region"))
    target, rule = graph.cascade([("same_nation", F.col("same_nation")), ("same_region", F.col("same_region"))])
    return calls.join(near, "c_nationkey", "left").join(far, "n_regionkey", "left").select("o_orderkey", target.alias("target"), rule.alias("resolution"))


@query("call_cascade", _CALLS + " SELECT o_orderkey, target, resolution FROM r WHERE target IS NOT NULL")
def call_cascade(spark, d):
    return _resolved(spark, d).where("target is not null")


