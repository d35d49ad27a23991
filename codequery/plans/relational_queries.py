"""Units, coverage, rules, risk, evaluation and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import risk
from .registry import frame, query



@query("line_split", r"SELECT doc_id, CAST(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS INT) AS n_lines, CAST(length(l[1]) AS INT) AS first_length FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents)")
def line_split(spark, d):
    ls = T.lines(F.col("text"))
    return frame(spark, d, "documents").select("doc_id", F.size(ls).alias("n_lines"), F.length(F.get(ls, F.lit(0))).alias("first_length"))


@query("snippet_bound", r"""WITH s AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents), x AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM s)
 SELECT doc_id, CASE WHEN len(l) >= 3 THEN md5(array_to_string(l[2:3], chr(10))) END AS excerpt_md5 FROM x""")
def snippet_bound(spark, d):
    return frame(spark, d, "documents").select("doc_id", F.md5(T.excerpt(F.col("text"), F.lit(2), F.lit(3))).alias("excerpt_md5"))


_RULES = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, '{p.replace(chr(39), chr(39) * 2)}' AS pattern" for r, s, p in risk.RULES)
_LINES = r"lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents))"


def _doc_lines(spark, d):
    return frame(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("no", "line")).withColumn("no", F.col("no") + 1)


@query("rule_scan", f"WITH r AS ({_RULES}), {_LINES} SELECT rule_id, count(doc_id) AS hits FROM r LEFT JOIN lines ON regexp_matches(line, pattern, 'i') GROUP BY rule_id")
def rule_scan(spark, d):
    """Hits of every rule, those without any too."""
    rules = spark.createDataFrame([(r,) for r, *_ in risk.RULES], "rule_id string")
    hits = risk.scan(_doc_lines(spark, d), "line").groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules.join(hits, "rule_id", "left").na.fill(0, ["hits"])


@query("finding_range_join", f"WITH {_LINES}, f AS (SELECT doc_id, no FROM lines WHERE contains(lower(line), 'token')), s AS (SELECT doc_id, unnest([1, 6]) AS first, unnest([5, 1000000]) AS last FROM documents) SELECT f.doc_id, CAST(s.first AS INT) AS first, count(*) AS findings FROM f JOIN s ON f.doc_id = s.doc_id AND f.no BETWEEN s.first AND s.last GROUP BY ALL")
def finding_range_join(spark, d):
    points = _doc_lines(spark, d).where(F.lower("line").contains("token")).select("doc_id", "no")
    spans = frame(spark, d, "documents").select("doc_id", F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((1, 5), (6, 1_000_000))])))
    return risk.within(points, spans, ["doc_id"], "no", "first", "last").groupBy("s.doc_id", "s.first").agg(F.count("*").alias("findings"))


_RISK = """WITH c AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS changes, count(DISTINCT o_custkey) AS authors, count_if(l_returnflag = 'R') AS findings FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
 x AS (SELECT p_partkey, p_size AS complexity, length(p_type) % 9 AS calls, coalesce(changes, 0) AS changes, coalesce(authors, 0) AS authors, CASE WHEN coalesce(findings, 0) > 12 THEN 1 ELSE 0 END AS findings FROM part LEFT JOIN c ON p_partkey = k),
 s AS (SELECT *, least(100.0, 4 * complexity + 3 * calls + 2 * changes + 2 * authors + 22 * findings) AS risk FROM x)"""


def _risks(spark, d):
    li, o, p = (frame(spark, d, t) for t in ("lineitem", "orders", "part"))
    c = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("p_partkey"))
    c = c.agg(F.count_distinct("l_orderkey").alias("changes"), F.count_distinct("o_custkey").alias("authors"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))
    x = p.join(c, "p_partkey", "left").na.fill(0, ["changes", "authors", "hits"])
    score, reasons = risk.function_risk(F.col("p_size"), F.length("p_type") % 9, F.col("changes"), F.col("authors"), F.when(F.col("hits") > 12, 1).otherwise(0))
    return x.select("p_partkey", score.alias("risk"), reasons.alias("reasons"))


@query("function_risk", _RISK + " SELECT p_partkey, CAST(risk AS DOUBLE) AS risk, CAST(greatest(1, CAST(complexity >= 8 AS INT) + CAST(calls >= 6 AS INT) + CAST(changes >= 5 AS INT) + CAST(authors >= 3 AS INT) + CAST(findings > 0 AS INT)) AS INT) AS n_reasons FROM s")
def function_risk(spark, d):
    return _risks(spark, d).select("p_partkey", "risk", F.size("reasons").alias("n_reasons"))


@query("repo_risk", _RISK + " SELECT round(avg(risk), 1) AS risk FROM s")
def repo_risk(spark, d):
    return _risks(spark, d).agg(F.round(F.avg("risk"), 1).alias("risk"))


@query("prompt_guard", "SELECT role, count(*) AS turns, CAST(count_if(regexp_matches(text, '" + "|".join(f"(?:{p})" for p in risk.INJECTIONS) + "', 'i')) AS BIGINT) AS flagged FROM conversations GROUP BY role")
def prompt_guard(spark, d):
    return frame(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_if(risk.instructs(F.col("text"))).alias("flagged"))


@query("normalize_ws", r"SELECT page_id, md5(trim(regexp_replace(html, '[ \t\r\n\f\v]+', ' ', 'g'))) AS normal FROM pages")
def normalize_ws(spark, d):
    return frame(spark, d, "pages").select("page_id", F.md5(F.trim(F.regexp_replace("html", r"[ \t\r\n\f\x0B]+", " "))).alias("normal"))


@query("latency_stats", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_stats(spark, d):
    """Median by interpolation, 95th percentile by nearest rank."""
    nearest = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return frame(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(nearest, 6).alias("p95"), F.count("*").alias("n"))


@query("split_sets", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM labels) SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'dev' ELSE 'test' END AS part FROM r")
def split_sets(spark, d):
    """80/10/10 in a seeded order; the two cuts are found by counting prefixes of the hash, never by one sort."""
    labels = frame(spark, d, "labels").select("doc_id", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))).alias("h"))
    n = labels.count()
    train, dev = (_at(labels, int(n * share)) for share in (0.8, 0.9))
    return labels.select("doc_id", F.when(F.col("h") < train, "train").when(F.col("h") < dev, "dev").otherwise("test").alias("part"))


def _at(rows, place: int, few: int = 10_000) -> str:
    """The hash at a place, from 0, of all hashes in order; empty where there is none. Three more hex digits tell the next bucket."""
    prefix = ""
    while True:
        rows = rows.where(F.col("h").startswith(prefix))
        counts = sorted(rows.groupBy(F.substring("h", 1, len(prefix) + 3).alias("p")).count().collect())
        for p, n in counts:
            if place < n:
                break
            place -= n
        else:
            return ""
        if n <= few:
            return sorted(r.h for r in rows.where(F.col("h").startswith(p)).select("h").collect())[place]
        prefix = p
